"""Connected components of a similarity graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import discard, written


def _minima(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return pairs.groupBy(*keys, "u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node in its neighbourhood."""
    both = edges.union(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minima(both, keys).select(*keys, "u", F.least("u", "m").alias("m"))
    return (
        both.filter(F.col("v") > F.col("u"))
        .join(least, [*keys, "u"])
        .select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )


def _small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = edges.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _minima(down, keys)
    moved = down.join(least, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(*keys, "u", F.col("m").alias("v"))).filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, keys: list[str], src: str = "a", dst: str = "b") -> DataFrame:
    """Smallest node of the component for every node that has an edge: ``(*keys, node, component)``.

    Alternates the large-star and small-star steps of Kiveris et al., "Connected Components in MapReduce and Beyond"
    (2014) until the edges no longer change; then every edge points at the smallest node of its component. Each round
    is written to the shared folder, and the change test is read off that same write.
    """
    current = edges.select(*keys, F.col(src).alias("u"), F.col(dst).alias("v")).filter(F.col("u") != F.col("v"))
    previous = None
    while True:
        seen = Observation()
        digest = F.xxhash64(*keys, "u", "v").cast("decimal(38,0)")
        step = _small_star(_large_star(current, keys), keys).observe(
            seen, F.count(F.lit(1)).alias("n"), F.sum(digest).alias("digest")
        )
        last, current = current, written(step, "components")
        if previous is not None:
            discard(last)
        state = (seen.get["n"], seen.get["digest"])
        if state == previous or state[0] == 0:
            break
        previous = state
    leaves = current.select(*keys, F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(*keys, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(roots)
