"""Joins and rankings that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread_over(df: DataFrame) -> int:
    """Parts that a hot key is spread over: as many as a shuffle of the session has."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt over all parts of a shuffle, ahead of work that takes long per row.

    A stored table of many short rows comes in as few parts as it has row groups, however much is then made of a row.
    """
    return df.repartition(spread_over(df))


def join_facts(
    rows: DataFrame, facts: DataFrame, on: list[str], spread: str, how: str = "inner", salts: int | None = None
) -> DataFrame:
    """Join many rows with few facts (one row per key) without sending a hot key to one task.

    Rows of a key are spread over ``salts`` join keys by a hash of ``spread``, and each fact is repeated once per salt: by
    default the square root of the shuffle's partitions, at least 16, which is what repeating the facts is worth. Beyond
    that adaptive execution splits what is still uneven. The planner may broadcast the facts when it measures them small
    enough; nothing here forces it to.
    """
    salts = salts or max(16, math.isqrt(spread_over(rows)))
    if how not in ("inner", "left"):
        raise ValueError(how)
    salted_rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    salted_facts = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_rows.join(salted_facts, [*on, "_salt"], how).drop("_salt")


def top_k(
    df: DataFrame, by: list[str], order: list[Column], k: int, spread: list[str], rank: str = "rank", salts: int | None = None
) -> DataFrame:
    """First ``k`` rows of each group under a total order, ranked from 1.

    A group is first ranked in ``salts`` parts, by default as many as a shuffle has; only ``k`` rows of each part reach the
    final ranking, so no task sees a whole hot group. With a total order the answer is exact.
    """
    salts = salts or spread_over(df)
    part = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    local = Window.partitionBy(*by, "_part").orderBy(*order)
    final = Window.partitionBy(*by).orderBy(*order)
    return (
        df.withColumn("_part", part)
        .withColumn("_r", F.row_number().over(local))
        .filter(F.col("_r") <= k)
        .drop("_part", "_r")
        .withColumn(rank, F.row_number().over(final))
        .filter(F.col(rank) <= k)
    )
