"""Approximate nearest neighbours: lists of near vectors, scanned by column blocks with early abandoning.

Rotation and hypothesis test follow Gao and Long, "High-Dimensional Approximate Nearest Neighbor Search: with Reliable
and Efficient Distance Comparison Operations" (SIGMOD 2023).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import top_k
from ..session import written
from .common import tidy

#: Vectors of the sample that the index is fitted on, and of those, how many act as queries to choose the lists probed.
SAMPLE = 20_000
SAMPLE_QUERIES = 100
#: Share of the sample queries' true neighbours in other lists than their own that a search is to reach.
RECALL = 0.97
#: The nearest of so many lists is searched before the others.
NEAR_SHARE = 8
#: Columns of a block; factor of the test's tolerance; vectors of a list, and queries, that meet in one task.
COLUMNS = 16
TOLERANCE = 2.1
BLOCK = 2048


@dataclass(frozen=True)
class Index:
    """Centroids of the lists, the rotation, and the sample vectors that calibrate the search."""

    centroids: np.ndarray
    rotation: np.ndarray
    asked: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Distance of each vector to each centroid."""
        d = (x**2).sum(1)[:, None] + (self.centroids**2).sum(1)[None] - 2 * x @ self.centroids.T
        return np.sqrt(np.maximum(d, 0))

    def nearest_list(self, x: np.ndarray) -> np.ndarray:
        return self.distances(x).argmin(1)


def least_distance(d: np.ndarray, radius: np.ndarray, cosine: float) -> np.ndarray:
    """The least distance at which a list can hold a vector, given the distance of its centroid.

    Members are within ``radius`` of the centroid and the angle between them and the query, seen from there, has at
    most this ``cosine``. With a cosine of 1 this is the triangle inequality.
    """
    towards = np.minimum(cosine * d, radius)
    return np.sqrt(np.maximum(d**2 + towards**2 - 2 * cosine * d * towards, 0))


def valid_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(id, v)`` of the rows that take part: id not null, components finite and not null, not all zero, and as many
    as the most frequent vector length (the longer one of equally frequent lengths)."""
    v = F.col("v")
    sound = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).filter(
        F.col("id").isNotNull()
        & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    usual = sound.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return sound.filter(F.size("v") == (usual["dim"] if usual else 0))


def fit_index(
    vectors: DataFrame, sample: int = SAMPLE, queries: int = SAMPLE_QUERIES, seed: int = 7
) -> Index | None:
    """Fit lists on at most ``sample`` vectors (those with the smallest hash of id and vector); None without vectors.

    The number of lists follows the square root of the number of all vectors, at most a sixteenth of the sample.
    """
    total = vectors.count()
    rows = vectors.orderBy(F.xxhash64("id", "v"), "id").limit(sample).select("v").collect()
    if not rows:
        return None
    x = np.array([r["v"] for r in rows])
    rng = np.random.default_rng(seed)
    lists = int(max(1, min(len(x) // 16, total**0.5 / 2)))
    c = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(10):
        own = Index(c, x[:0], x[:0]).nearest_list(x)
        sums, n = np.zeros_like(c), np.bincount(own, minlength=lists)
        np.add.at(sums, own, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    rotation = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    return Index(c, rotation, x[:queries])


def calibrated(rows: DataFrame, index: Index, radius: np.ndarray, k: int, recall: float) -> float:
    """The least cosine (see ``least_distance``) with which the ``k`` nearest of the index's sample vectors among all
    ``rows(id, v, list)``, as far as they are in other lists, are found with the asked ``recall``.

    The true neighbours come from one scan of all rows, in which a task keeps ``k`` rows per sample vector. Where few of
    them are in other lists the cosine is 1, which misses none.
    """
    asked = index.asked

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in (batch.iloc[at : at + 4096] for at in range(0, len(batch), 4096)):
                x, own = np.array(part["v"].tolist()), part["list"].to_numpy()
                d = np.maximum((x**2).sum(1)[None] + (asked**2).sum(1)[:, None] - 2 * asked @ x.T, 0)
                best = np.argsort(d, axis=1)[:, : k + 1]
                score = np.sqrt(np.take_along_axis(d, best, 1))
                query = np.repeat(np.arange(len(asked)), best.shape[1])
                yield pd.DataFrame({"query": query, "id": part["id"].to_numpy()[best].ravel(), "list": own[best].ravel(), "score": score.ravel()})

    found = rows.select("id", "v", "list").mapInPandas(tidy(nearest), "query int, id long, list int, score double")
    order = [F.asc("score"), F.asc("id")]
    # The first one is the sample vector itself.
    best = top_k(found, ["query"], order, k + 1, ["id"]).filter("rank > 1").select("query", "list", "score").toPandas()
    to, own = index.distances(asked), index.nearest_list(asked)
    query, lists = best["query"].to_numpy(dtype=np.int64), best["list"].to_numpy(dtype=np.int64)
    other = lists != own[query]
    if other.sum() < 10 * k:
        return 1.0
    bound = np.zeros(len(asked))
    np.maximum.at(bound, query, best["score"].to_numpy())
    query, lists = query[other], lists[other]
    needed = np.ones(len(query))
    for cosine in np.linspace(1, 0, 101):
        enough = least_distance(to[query, lists], radius[lists], cosine) <= bound[query] * (1 + 1e-9)
        needed = np.where(enough, cosine, needed)
    return float(np.quantile(needed, recall, method="higher"))


def scan(q: np.ndarray, x: np.ndarray, bound: np.ndarray, own: np.ndarray, rotation: np.ndarray, columns: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) whose distance may be below the query's squared ``bound``.

    Both sides are rotated, so every block of columns holds a random share of the squared distance. After ``d`` of
    ``D`` columns a candidate is abandoned when its partial squared distance, scaled by ``D / d``, exceeds the bound
    times ``(1 + tolerance / sqrt(d)) ** 2``. ``own`` marks pairs that are left out from the start.
    """
    q, x = q @ rotation, x @ rotation
    dim = q.shape[1]
    at_q, at_x = np.nonzero(~own)
    # What rounding can add to a distance of zero.
    rounding = 1e-9 * ((q**2).sum(1).max(initial=0) + (x**2).sum(1).max(initial=0))
    partial = np.zeros(len(at_q))
    for start in range(0, dim, columns):
        a, b = q[:, start : start + columns], x[:, start : start + columns]
        if start == 0:
            block = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T
            partial = block[at_q, at_x]
        else:
            partial = partial + ((a[at_q] - b[at_x]) ** 2).sum(1)
        done = min(start + columns, dim)
        slack = (1 + tolerance / done**0.5) ** 2 if done < dim else 1 + 1e-9
        stays = partial * (dim / done) <= bound[at_q] * slack + rounding
        at_q, at_x, partial = at_q[stays], at_x[stays], partial[stays]
    return at_q, at_x


def _searched(candidates: DataFrame, queries: DataFrame, index: Index, k: int, columns: int, tolerance: float) -> DataFrame:
    """The ``k`` nearest candidates of each query in each block in which both are: ``(query_id, vec_id, score)``."""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            x, ids = np.array(left["v"].tolist()), left["id"].to_numpy()
            for at in range(0, len(right), 256):
                part = right.iloc[at : at + 256]
                q, qids = np.array(part["v"].tolist()), part["id"].to_numpy()
                own = qids[:, None] == ids[None]
                at_q, at_x = scan(q, x, part["bound"].to_numpy() ** 2, own, index.rotation, columns, tolerance)
                score = np.sqrt(((q[at_q] - x[at_x]) ** 2).sum(1))
                order = np.lexsort((ids[at_x], score, at_q))
                at_q, at_x, score = at_q[order], at_x[order], score[order]
                first = np.searchsorted(at_q, at_q, side="left")
                best = np.arange(len(at_q)) - first < k
                out.append(pd.DataFrame({"query_id": qids[at_q[best]], "vec_id": ids[at_x[best]], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    keys = ["list", "block", "query_block"]
    return candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(
        meet, "query_id long, vec_id long, score double"
    )


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column | None = None,
    k: int = 10,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    columns: int = COLUMNS,
    tolerance: float = TOLERANCE,
    block: int = BLOCK,
    recall: float = RECALL,
    **fitting,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest found for each query row of ``vectors``.

    Queries are the rows for which ``is_query`` (over the column ``id``) holds; candidates are all rows with another
    id. Nearness is the Euclidean distance in double precision on the vectors as they are; ties go to the smaller id.
    Rows without a usable vector (see ``valid_vectors``) take no part. Of rows that repeat an id and vector, each is a
    candidate, and a repeated query is searched once per vector. Other columns are ignored; without usable vectors the
    result is empty.

    Every vector is in the list of its nearest centroid. A query first searches the nearest lists that together hold
    enough vectors. Its k-th distance there is the bound with which it goes on to those of the nearest ``NEAR_SHARE`` of
    lists that can hold a nearer one (``least_distance``, as ``calibrated``), and, with the bound found by then, to any
    other list that can. So a query far from everything searches as many lists as it takes and gets ``k`` results. Lists
    are cut into blocks of about ``block`` vectors, the queries of a list likewise, and a pair of blocks is one task's
    work: a list that holds a third of all rows is spread over many tasks, and a list is copied only as often as its
    own queries fill blocks.
    """
    own = valid_vectors(vectors, vec_id, embedding)
    index = fit_index(own, **fitting)
    spark = vectors.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    @F.pandas_udf("list int, away double")
    def listed(v: pd.Series) -> pd.DataFrame:
        d = index.distances(np.array(v.tolist())) if len(v) else np.zeros((0, len(index.centroids)))
        own = d.argmin(1) if len(v) else np.zeros(0, dtype=np.int32)
        return pd.DataFrame({"list": own.astype(np.int32), "away": d[np.arange(len(d)), own]})

    rows = written(own.select("id", "v", listed("v").alias("at")).select("id", "v", "at.list", "at.away"), "listed")
    sizes, radius = np.zeros(len(index.centroids), dtype=np.int64), np.zeros(len(index.centroids))
    # One row per list, and there are at most a sixteenth of the sample.
    for r in rows.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect():
        sizes[r["list"]], radius[r["list"]] = r["n"], r["radius"] * (1 + 1e-9)
    cosine = calibrated(rows, index, radius, k, recall)
    near_lists = -(-len(sizes) // NEAR_SHARE)

    @F.pandas_udf("array<int>")
    def to_probe(v: pd.Series, bound: pd.Series, step: pd.Series) -> pd.Series:
        """The lists that a query searches in the first step, among the near lists, and among the others."""
        out = []
        for at in range(0, len(v), 1024):
            part = slice(at, at + 1024)
            d = index.distances(np.array(v.iloc[part].tolist()))
            order = np.argsort(d, axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1) - sizes[order]
            first = held <= k  # one of these vectors may be the query itself
            near = np.arange(len(sizes))[None] < near_lists
            place = np.where(first, 0, np.where(near, 1, 2))
            best = bound.iloc[part].to_numpy(dtype=float)[:, None] * (1 + 1e-9)
            can = first | (least_distance(np.take_along_axis(d, order, 1), radius[order], cosine) <= best)
            wanted = (place == step.iloc[part].to_numpy()[:, None]) & can & (sizes[order] > 0)
            out += [o[w].astype(np.int32) for o, w in zip(order, wanted, strict=True)]
        return pd.Series(out, dtype=object)

    asked = rows.filter(is_query if is_query is not None else F.col("id").isNotNull()).select("id", "v").distinct()

    def search(probes: DataFrame, name: str) -> DataFrame:
        """The ``k`` nearest in the lists of ``probes(id, v, bound, list)``, for each pair of blocks in which both are."""
        probes = written(probes, "probes")
        counted = {r["list"]: r["n"] for r in probes.groupBy("list").agg(F.count("*").alias("n")).collect()}
        shape = [(i, int(-(-sizes[i] // block)), int(-(-n // block))) for i, n in counted.items()]
        # One row per list that is searched.
        blocks = F.broadcast(spark.createDataFrame(shape, "list int, blocks int, query_blocks int"))

        def every(n: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

        def one_of(n: str, salt: int) -> Column:
            return F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")

        candidates = rows.select("list", "id", "v").join(blocks, "list")
        candidates = candidates.withColumn("block", one_of("blocks", 0)).withColumn("query_block", every("query_blocks"))
        queries = probes.join(blocks, "list").withColumn("query_block", one_of("query_blocks", 1)).withColumn("block", every("blocks"))
        drop = ["blocks", "query_blocks"]
        return written(_searched(candidates.drop(*drop), queries.drop(*drop), index, k, columns, tolerance), name)

    order = [F.asc("score"), F.asc("vec_id")]
    best = None
    for step in range(3):
        bounded = asked.withColumn("bound", F.lit(float("inf")))
        if best is not None:
            worst = best.groupBy(F.col("query_id").alias("id")).agg(
                F.when(F.count("*") >= k, F.max("score")).otherwise(float("inf")).alias("bound")
            )
            bounded = asked.join(worst, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        lists = F.explode(to_probe("v", "bound", F.lit(step)))
        found = search(bounded.select("id", "v", "bound", lists.alias("list")), "neighbours")
        found = found if best is None else best.drop("rank").union(found)
        best = top_k(found, ["query_id"], order, k, ["vec_id"])
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
