"""Importance resampling against a plain evaluation of its rule."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from trustgrain.llm import importance, queries

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, target, n=1, buckets=10_000, seed=2024, percent=10):
    def features(text):
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        runs = [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
        return len(words), Counter(zlib.crc32(r.encode()) % buckets for r in runs)

    own = [(i, *features(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, found in own:
        s.update(found)
    for text in target:
        t.update(features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))

    rows = []
    for i, words, found in own:
        weight = sum(gain(b) * k for b, k in found.items())
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, words, sum(found.values()), weight, score))
    drawn = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = Counter()
    for place, r in enumerate(drawn[: percent * len(drawn) // 100], 1):
        ranks[r[0], r[2], r[4], place] += 1
    return rows, ranks


def check(got, rows, ranks):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r[0], r[1], r[2], r[3]) for r in got), key=key) == sorted(((i, n, w, s) for i, _, n, w, s in rows), key=key)
    assert Counter((r[0], r[1], r[3], r[4]) for r in got if r[4] is not None) == ranks


def test_every_document(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    check([tuple(r) for r in queries.op13_importance(spark, FOLDER).collect()], *plain(docs, target))


@pytest.mark.parametrize("n", [2, 3])
def test_longer_features(spark, n):
    docs = [(1, "a b a b c"), (2, "B a"), (3, "x"), (4, None), (5, "ü-b a9 Ü b" * 8), (6, "a b " * 30), (7, "c b a " * 9)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    target = spark.createDataFrame([("a b c",), (None,), ("b a",)], "words string")
    got = importance.resample(df, target, target_text="words", max_n=n, buckets=50, percent=60, least_words=20).collect()
    check([tuple(r) for r in got], *plain(docs, ["a b c", None, "b a"], n, 50, percent=60))


def test_chained_checksums():
    found = importance.hashed_features([b"a", b"b", b"a"], 3)
    assert found == Counter([zlib.crc32(x) for x in (b"a", b"b", b"a", b"a b", b"b a", b"a b a")])


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    check([tuple(r) for r in importance.resample(odd_docs, no_docs, percent=50).collect()], *plain(docs, [], percent=50))
    assert importance.resample(no_docs, odd_docs).count() == 0


def test_ranks_over_many_ranges(spark):
    df = spark.range(1000).selectExpr("id AS doc_id", "id % 7 AS score")
    from pyspark.sql import functions as F

    got = importance.ranked(df, [F.desc("score"), F.asc("doc_id")], 100, 1000, part_rows=37).filter("rank IS NOT NULL").collect()
    want = sorted(range(1000), key=lambda i: (-(i % 7), i))[:100]
    assert {r["doc_id"]: r["rank"] for r in got} == {i: k for k, i in enumerate(want, 1)}
