"""Importance resampling towards a target: hashed n-gram counts of both sides, log-ratio weights, Gumbel top-k.

After Xie et al., "Data Selection for Language Models via Importance Resampling" (2023).
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import fresh, small_batches, tidy

#: Words of the longest feature, buckets, seed of the noise, and the contract's draw: percent of the documents with
#: enough words.
MAX_N = 1
BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
#: Rows that one task numbers.
PART_ROWS = 1_000_000

#: What each byte of UTF-8 becomes: A-Z their lower case, other letters and digits themselves, all other ASCII a blank.
TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a text in UTF-8; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


def hashed_features(words: list[bytes], max_n: int = MAX_N) -> Counter[int]:
    """How often each CRC-32 of a run of 1 to ``max_n`` words, joined by a blank, occurs.

    The checksum of a run is the seed from which that of the run with one more word goes on, so a run is never put
    together. Equal words are counted before they are hashed.
    """
    if max_n == 1:
        found: Counter[int] = Counter()
        for word, n in Counter(words).items():
            found[zlib.crc32(word)] += n
        return found
    found = Counter()
    ends = [zlib.crc32(w) for w in words]
    found.update(ends)
    for n in range(1, max_n):
        # ends[i] is the checksum of the run of n words from word i on.
        ends = [zlib.crc32(w, zlib.crc32(b" ", seed)) for seed, w in zip(ends, words[n:], strict=False)]
        found.update(ends)
    return found


def bucket_counts(texts: DataFrame, text: str = "text", max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: features of all whole texts by bucket, for the buckets that have any.

    A task counts what it reads into ``buckets`` numbers and gives one row per bucket, so the shuffle holds at most
    tasks times buckets rows, whatever the texts repeat. An empty table gives an empty table.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for t in batch["text"]:
                found = hashed_features(words_of(t), max_n)
                at = np.fromiter(found.keys(), dtype=np.int64, count=len(found)) % buckets
                np.add.at(totals, at, np.fromiter(found.values(), dtype=np.int64, count=len(found)))
        some = np.nonzero(totals)[0]
        yield pd.DataFrame({"bucket": some, "n": totals[some]})

    small_batches(texts.sparkSession)
    each = texts.select(F.col(text).alias("text")).mapInPandas(tidy(count), "bucket long, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket in thousandths: the floored logarithm of the ratio of its smoothed share in ``target`` to
    that in ``raw`` (both as ``bucket_counts`` gives them).

    One number per bucket and side comes to the driver.
    """
    s, t = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
    for counts, side in ((raw, s), (target, t)):
        for r in counts.collect():
            side[r["bucket"]] = r["n"]
    every_s, every_t = float(s.sum() + buckets), float(t.sum() + buckets)
    ratios = ((float(y) + 1) * every_s / ((float(x) + 1) * every_t) for x, y in zip(s, t, strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], dtype=np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """Noise of a document in thousandths, from a hash of its id alone, so that reruns agree; a null id hashes as ''."""
    own = "" if doc_id is None else int(doc_id)
    h = int(hashlib.sha256(f"{seed}:{own}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gains: np.ndarray, doc_id: str = "doc_id", text: str = "text", max_n: int = MAX_N, seed: int = SEED) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score)`` of every row, computed where its text is read."""
    kind = "doc_id long, n_words long, n_features long, weight long, score long"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, t in zip(batch["doc_id"], batch["text"], strict=True):
                words = words_of(t)
                found = hashed_features(words, max_n)
                at = np.fromiter(found.keys(), dtype=np.int64, count=len(found)) % len(gains)
                times = np.fromiter(found.values(), dtype=np.int64, count=len(found))
                weight = int(gains[at] @ times)
                own = None if i is None or i != i else int(i)
                rows.append((own, len(words), int(times.sum()), weight, weight + gumbel(own, seed)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")]).astype({"doc_id": "Int64"})

    small_batches(docs.sparkSession)
    # The id goes as a string: a column of numbers with nulls would reach pandas as rounded doubles.
    named = docs.select(F.col(doc_id).cast("long").cast("string").alias("doc_id"), F.col(text).alias("text"))
    return named.mapInPandas(tidy(score), kind)


def ranked(rows: DataFrame, order: list[Column], number: int, total: int, part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` with ``rank``: 1 to ``number`` for the first ones under ``order``, else null.

    Rows are dealt into ranges of the order and sorted inside them, then shifted by the rows of the ranges before, of
    which there is one count per range. No task sees more than its range. Rows that are equal in ``order`` are ranked
    as they come.
    """
    parts = max(1, -(-total // part_rows))
    place = fresh(rows, "place")
    dealt = written(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()),
        "ranges",
    )
    # The id that Spark numbers rows with holds the partition above bit 33 and the row below it.
    part, row = F.shiftright(F.col(place), 33), F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()  # one row per ``part_rows`` rows
    before, upto = {}, 0
    for r in sorted(sizes):
        before[r["part"]] = upto
        upto += r["n"]
    shifts = rows.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "rank_part long, rank_shift long")
    joined = dealt.join(F.broadcast(shifts), part == F.col("rank_part"))
    rank = F.col("rank_shift") + row + 1
    return joined.select(*rows.columns, F.when(rank <= number, rank).alias("rank"))


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    max_n: int = MAX_N,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` of every document: how much its words look like those of ``target``.

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased; features are all runs of 1 to
    ``max_n`` words. The weight of a document is the sum of its features' gains (see ``bucket_gains``), its score the
    weight plus Gumbel noise from its id: taking the highest scores draws documents without replacement with chances in
    proportion to the exponential of their weight. Of the documents with at least ``least_words`` words, ``percent``
    percent (rounded down) are drawn and ranked from 1, ties to the smaller id, null ids last; all others have a null
    rank.

    Null and empty texts have no features and the weight 0. Rows that repeat an id are documents of their own with the
    same noise, ranked as they come where they are equal. Other columns are ignored, whatever their names. An empty
    ``docs`` gives an empty result; an empty ``target`` leaves only the smoothing, so rare words weigh most.

    Texts are read twice, and neither they nor their words are shuffled.
    """
    gains = bucket_gains(
        bucket_counts(docs, text, max_n, buckets), bucket_counts(target, target_text, max_n, buckets), buckets
    )
    weighed = written(weigh(docs, gains, doc_id, text, max_n, seed), "weights")
    enough = F.col("n_words") >= least_words
    sums = weighed.agg(F.count("*").alias("total"), F.count_if(enough).alias("enough")).first()
    order = [F.desc(F.coalesce(enough, F.lit(False))), F.desc("score"), F.asc_nulls_last("doc_id")]
    out = ranked(weighed, order, percent * sums["enough"] // 100, sums["total"])
    return out.select("doc_id", "n_features", "weight", "score", "rank")
