"""Keywords against a plain evaluation, and the choice of those that overlap least."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import pytest

from trustgrain.functions.text import TERM_STOP_WORDS
from trustgrain.operators import keywords as K


def plain(reviews, passes=K.PASSES, kept=K.KEPT):
    uses = {}
    for product, text in reviews:
        words = [w for w in re.findall(r"\w{2,}", (text or "").lower()) if w not in TERM_STOP_WORDS]
        if (text or "").strip():
            own = uses.setdefault(product, Counter())
            own.update(" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    uses = {p: c for p, c in uses.items() if c}
    spread = Counter(phrase for c in uses.values() for phrase in c)
    out = {}
    for product, own in uses.items():
        most = max(own.values())
        scores = {g: round(n / most * (math.log((len(uses) + 1) / (spread[g] + 1)) + 1), 4) for g, n in own.items()}
        best = {}
        for p in passes:
            listed = sorted((g for g in own if p.shortest <= g.count(" ") + 1 <= p.longest), key=lambda g: (-scores[g], g))[: p.candidates]
            if p.candidates and len(listed) > p.kept:
                least = min(
                    itertools.combinations(range(len(listed)), p.kept),
                    key=lambda c: (sum(K.alike(listed[a], listed[b]) for a, b in itertools.combinations(c, 2)), c),
                )
                listed = [listed[i] for i in least]
            best.update({g: scores[g] for g in listed})
        out[product] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:kept]
    return {p: best for p, best in out.items() if best}


def found(df, **kwargs):
    got = {}
    for r in K.keywords(df, **kwargs).orderBy("product_id", "keyword_rank").collect():
        got.setdefault(r["product_id"], []).append((r["keyword"], r["score"]))
    return got


@pytest.fixture(scope="module")
def reviews():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["the", "battery", "life", "screen"]
    weights = [1 / (i + 1) for i in range(len(words))]
    rows = [(f"p{rng.randrange(6)}", " ".join(rng.choices(words, weights, k=rng.randrange(0, 14)))) for _ in range(150)]
    return [*rows, ("few", "battery life"), ("none", "the of"), ("p1", None), ("p1", " "), ("p2", "battery life screen " * 20)]


SMALL = (K.Pass(1, 2, 9, 6), K.Pass(2, 3, 8, 5))


def test_keywords_equal_plain_evaluation(spark, reviews):
    df = spark.createDataFrame(reviews, "product_id string, text string")
    assert found(df, passes=SMALL) == plain(reviews, SMALL)


def test_all_phrases_without_limits(spark, reviews):
    df = spark.createDataFrame(reviews, "product_id string, text string")
    every = (K.Pass(1, 3, None),)
    assert found(df, passes=every, kept=None) == plain(reviews, every, None)


def test_three_word_phrases_alone(spark, reviews):
    df = spark.createDataFrame(reviews, "product_id string, text string")
    only = (K.Pass(3, 3, 7, 4),)
    assert found(df, passes=only) == plain(reviews, only)


def test_least_alike():
    assert K.alike("battery life", "battery") == 707106 and K.alike("a1 b1", "c1 d1") == 0
    assert K.least_alike(["aa bb", "aa", "bb", "cc"], 3) == [1, 2, 3]
    assert K.least_alike(["aa", "bb", "cc"], 2) == [0, 1]  # of equals the better
    assert K.least_alike(["aa"], 2) == [0]
    with pytest.raises(ValueError, match="ways to keep"):
        K.least_alike([f"w{i}" for i in range(40)], 20)
