"""Stored requests and sign-in attempts against the limits of a service.

Rows of a busy client are summed per period before anything is ordered, so a window sees at most one row per client and
period, however many attempts there were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Requests per minute for anonymous and signed-in clients.
ANONYMOUS_PER_MINUTE = 20
SIGNED_IN_PER_MINUTE = 60

# Failures until an address or an account is locked, and seconds after which an address is forgotten.
IP_FAILURES, IP_MEMORY_S = 10, 300
ACCOUNT_FAILURES = 4

MICROS = 1_000_000


def client_key(user: Column, ip: Column, authenticated: Column) -> Column:
    return F.when(authenticated, F.concat(F.lit("user:"), user.cast("string"))).otherwise(F.concat(F.lit("ip:"), ip))


def request_limit(authenticated: Column) -> Column:
    return F.when(authenticated, F.lit(SIGNED_IN_PER_MINUTE)).otherwise(F.lit(ANONYMOUS_PER_MINUTE))


def requests_per_minute(visits: DataFrame, ts: str = "created_at") -> DataFrame:
    """Requests of each client and minute with the client's limit and the number of requests beyond it.

    Visits without a time, or without the user or address that names their client, belong to no client's minute.
    """
    client = client_key(F.col("user_id"), F.col("ip_address"), F.col("authenticated"))
    known = visits.select(
        client.alias("client"), ts, request_limit(F.col("authenticated")).alias("allowed")
    ).dropna(subset=["client", ts])
    excess = F.greatest(F.col("requests") - F.col("allowed"), F.lit(0))
    return (
        known.groupBy("client", F.window(ts, "1 minute").alias("span"), "allowed")
        .agg(F.count(F.lit(1)).alias("requests"))
        .select("client", F.col("span.start").alias("minute"), "allowed", "requests", excess.alias("excess"))
    )


def failure_runs(
    attempts: DataFrame,
    key: str,
    failed: str,
    limit: int,
    memory_s: int | None = None,
    ts: str = "created_at",
    tie: str = "id",
    period_s: int = 60,
) -> DataFrame:
    """Failures in a row per key: first and last of them, their number, and whether they reach ``limit``.

    A success ends a run; with ``memory_s``, a pause of more than that between two attempts does so, too. Attempts are
    ordered inside periods only; what connects the periods of a key is one row of each. Null keys form a key of their
    own, attempts without a time take no part, a null outcome counts as a success.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = attempts.select(
        F.col(key).alias("k"), us.alias("t"), F.col(tie).alias("tie"), F.coalesce(failed, F.lit(False)).alias("failed")
    ).filter("t IS NOT NULL")
    rows = rows.withColumn("period", F.floor(F.col("t") / (period_s * MICROS)))

    def paused(before: Column, now: Column) -> Column:
        return F.lit(False) if memory_s is None else F.coalesce(now - before > memory_s * MICROS, F.lit(False))

    inside = Window.partitionBy("k", "period").orderBy("t", "tie")
    ends = ~F.col("failed") | paused(F.lag("t").over(inside), F.col("t"))
    local = rows.withColumn("ends", ends.cast("long")).withColumn("local_run", F.sum("ends").over(inside))
    parts = local.groupBy("k", "period", "local_run").agg(
        F.min("t").alias("start"),
        F.max("t").alias("end"),
        F.count_if("failed").alias("failures"),
        F.min(F.when(F.col("failed"), F.col("t"))).alias("first"),
        F.max(F.when(F.col("failed"), F.col("t"))).alias("last"),
    )
    in_order = Window.partitionBy("k").orderBy("period")
    periods = (
        parts.groupBy("k", "period")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("local_run").alias("inner"))
        .withColumn("jump", paused(F.lag("end").over(in_order), F.col("start")).cast("long"))
        .withColumn("base", F.sum(F.col("inner") + F.col("jump")).over(in_order) - F.col("inner"))
        .select(F.col("k").alias("pk"), F.col("period").alias("pp"), "base")
    )
    same = F.col("k").eqNullSafe(F.col("pk")) & (F.col("period") == F.col("pp"))
    return (
        parts.filter("failures > 0")
        .join(periods, same)
        .groupBy("k", (F.col("base") + F.col("local_run")).alias("run"))
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("failures").alias("failures"))
        .select(
            F.col("k").alias(key),
            F.timestamp_micros("first").alias("first_failure"),
            F.timestamp_micros("last").alias("last_failure"),
            "failures",
            (F.col("failures") >= limit).alias("locked"),
        )
    )
