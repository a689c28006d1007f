"""The Jaccard join against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustgrain.llm import jaccard, neardup, queries


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def plain(docs, similarity=80):
    """(size of the set, smallest id reachable) by id, over all pairs; rows of one id are one node."""
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in sets if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_shingle = {}
    for k, (i, s) in enumerate(sets):
        for x in s if i is not None else ():
            by_shingle.setdefault(x, []).append(k)
    pairs = {}
    for own in by_shingle.values():
        for x, a in enumerate(own):
            for b in own[x + 1 :]:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    for (a, b), both in pairs.items():
        if 100 * both >= similarity * (len(sets[a][1]) + len(sets[b][1]) - both):
            x, y = find(sets[a][0]), find(sets[b][0])
            parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def found(df, **kwargs):
    return sorted((tuple(r) for r in jaccard.similar_classes(df, **kwargs).collect()), key=str)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_every_document(spark, folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op11_jaccard_join(spark, folder).collect()), key=str)
    assert got == plain(docs)
    assert len({r[2] for r in got}) < len(got)


def groups(seed, n_groups=24):
    """Groups around a text that is not the first of its group: members are near the limit of similarity."""
    rng = random.Random(seed)
    texts = []
    for _ in range(n_groups):
        n = rng.choice([6, 9, 20, 60, 150, 400])
        base = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
        for _ in range(rng.choice([3, 8, 25, 60])):
            words = list(base)
            for _ in range(rng.randrange(max(2, n // 28))):
                words[rng.randrange(len(words))] = f"z{rng.randrange(10**9)}"
            texts.append(" ".join(words))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "block"), [(4, 512), (5, 7)])
def test_groups_near_the_limit(spark, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    docs = groups(seed)
    assert found(spark.createDataFrame(docs, "doc_id long, text string")) == plain(docs)


def test_full_sets_decide_what_sketches_cannot(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "odd_bits", lambda elements, bits=64: bytes(bits // 8))  # rules nothing out
    docs = groups(6, 10)
    assert found(spark.createDataFrame(docs, "doc_id long, text string").repartition(1)) == plain(docs)


def test_odd_rows(odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    assert found(odd_docs) == plain(docs)
    assert jaccard.similar_classes(no_docs).count() == 0


@pytest.mark.parametrize("similarity", [70, 80, 95])
def test_similar_sets_share_a_signature(similarity):
    rng = np.random.default_rng(3)
    signer = jaccard.Signer(similarity)
    for size in [*range(4, 60, 3), 80, 150, 300, 900, 3000]:
        for _ in range(12):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            gone = int(rng.integers(0, size + 1))
            more = (100 * (size - gone) - similarity * size) // similarity
            if more < 0:
                continue
            b = np.concatenate([a[gone:], rng.integers(0, 2**63, more).astype(np.uint64)])
            if len(a) == len(b) == size - gone:
                continue
            assert neardup.similar(np.sort(a), np.sort(b), similarity)
            keys = [signer.sign(np.sort(x), np.array([len(x)]))[0] for x in (a, b)]
            assert len(np.intersect1d(*keys)), (size, gone, more)


def test_adversarial_differences_share_a_signature():
    """Differences that are put into as many partitions as possible."""
    band = next(i for i, (_, high) in enumerate(jaccard.bands(400)) if high >= 300)
    low, high = jaccard.bands(400)[band]
    p = jaccard.plan(band, low, high)
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 200_000).astype(np.uint64)
    place = ((jaccard._mix(pool, 1) >> np.uint64(32)) * np.uint64(p.first)) >> np.uint64(32)
    common = rng.choice(pool, low, replace=False)
    # left_out + 1 differences in each partition, as far as they go.
    spread = np.concatenate([pool[place == i][: p.left_out + 1] for i in range(p.first)])[: p.different]
    a, b = np.unique(common), np.unique(np.concatenate([common, spread]))
    size = [np.array([len(x)]) for x in (a, b)]
    keys = []
    for x, n in zip((a, b), size, strict=True):
        owner = np.zeros(len(x), dtype=np.int64)
        keys.append(jaccard.signatures(x, jaccard._mix(x, 1), owner, 1, p, p.subsets)[1])
    assert len(np.setxor1d(a, b)) <= p.different and len(np.intersect1d(*keys)) > p.spare


def test_odd_bits_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (5, 100, 3000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 9 :], rng.integers(0, 2**63, n // 7).astype(np.uint64)]))
        x, y = jaccard.odd_bits(a), jaccard.odd_bits(b)
        size = min(len(x), len(y))
        least = int(np.bitwise_count(jaccard._folded(x, size) ^ jaccard._folded(y, size)).sum())
        assert least <= len(np.setxor1d(a, b))


def test_a_signature_that_all_have_is_one_row_per_batch(spark):
    docs = spark.range(400).select(F.col("id"), F.lit("a b c d e f g h i j k l m n o p").alias("text")).coalesce(1)
    rows = jaccard._signed(docs, docs.select("id"), 64, 5, 80).filter("leaders IS NULL").collect()
    assert sum(len(r["keys"]) // 6 for r in rows) == len({k for r in rows for k in [r["keys"][i : i + 6] for i in range(0, len(r["keys"]), 6)]})
