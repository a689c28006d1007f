"""Attempts against limits, stored and arriving, and other streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustgrain.operators import attempts
from trustgrain.plans import derive
from trustgrain.sources.tables import load
from trustgrain.session import work_path
from trustgrain.streaming import sinks, streams

from .base import query

MINUTES_SQL = f"""
SELECT client, minute, allowed, requests, greatest(requests - allowed, 0) AS excess FROM (
  SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'user:' || user_id ELSE 'ip:ip' || user_id END AS client, date_trunc('minute', ts) AS minute,
    CAST(CASE WHEN event_type IN ('purchase', 'signup') THEN {attempts.SIGNED_IN_PER_MINUTE} ELSE {attempts.ANONYMOUS_PER_MINUTE} END AS INTEGER) AS allowed,
    COUNT(*) AS requests
  FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL)
"""


def runs_sql(limit: int, memory_s: int | None, success: bool = True) -> str:
    """Failures in a row, ended by a success (where those are read) or by a pause."""
    paused = f"coalesce(us - before > {memory_s} * CAST(1000000 AS BIGINT), false)" if memory_s else "false"
    kinds = "'error', 'click'" if success else "'error'"
    return f"""
WITH a AS (SELECT user_id, event_id, ts, epoch_us(ts) AS us, event_type = 'error' AS failed,
    lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type IN ({kinds}) AND ts IS NOT NULL),
r AS (SELECT *, SUM(CASE WHEN NOT failed OR {paused} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a)
SELECT user_id, MIN(ts) AS first_failure, MAX(ts) AS last_failure, COUNT(*) AS failures, COUNT(*) >= {limit} AS locked
FROM r WHERE failed GROUP BY user_id, run
"""


def sign_ins(df):
    """Errors as failed sign-ins, clicks as successful ones."""
    kept = df.filter(F.col("event_type").isin("error", "click"))
    return kept.select(
        F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"), (F.col("event_type") == "error").alias("failed")
    )


def without_zone(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("rate_limit_audit", MINUTES_SQL)
def rate_limit_audit(spark, d):
    return without_zone(attempts.requests_per_minute(derive.site_visits(spark, d)), "minute")


@query("lockout_audit", runs_sql(attempts.IP_FAILURES, attempts.IP_MEMORY_S))
def lockout_audit(spark, d):
    found = sign_ins(load(spark, d, "events"))
    runs = attempts.failure_runs(found, "user_id", "failed", attempts.IP_FAILURES, attempts.IP_MEMORY_S)
    return without_zone(runs, "first_failure", "last_failure")


@query("account_lockout_audit", runs_sql(attempts.ACCOUNT_FAILURES, None))
def account_lockout_audit(spark, d):
    runs = attempts.failure_runs(sign_ins(load(spark, d, "events")), "user_id", "failed", attempts.ACCOUNT_FAILURES)
    return without_zone(runs, "first_failure", "last_failure")


def arriving(spark, d, name, job, *types):
    """What a job appends for the events of a table that arrive in several files, with a restart in between."""
    events = load(spark, d, "events").filter("ts IS NOT NULL")
    return streams.replay(events.filter(F.col("event_type").isin(*types)) if types else events, name, job)


@query("rate_limit_stream", MINUTES_SQL)
def rate_limit_stream(spark, d):
    minutes = arriving(spark, d, "rate-limit", lambda e: streams.stream_request_minutes(derive.as_visits(e)))
    return without_zone(minutes, "minute")


@query("lockout_stream", runs_sql(attempts.IP_FAILURES, attempts.IP_MEMORY_S, success=False))
def lockout_stream(spark, d):
    def bursts(events):
        return streams.stream_failure_bursts(sign_ins(events), "user_id", attempts.IP_FAILURES, attempts.IP_MEMORY_S)

    return without_zone(arriving(spark, d, "lockout", bursts, "error"), "first_failure", "last_failure")


@query("lockout_runs_stream", runs_sql(attempts.IP_FAILURES, attempts.IP_MEMORY_S))
def lockout_runs_stream(spark, d):
    arrived = arriving(spark, d, "sign-ins", sign_ins, "error", "click")
    last = load(spark, d, "events").agg(F.max("ts").cast("timestamp").alias("last"))
    runs = attempts.failure_runs(
        arrived.filter(F.col("created_at") <= last.scalar()), "user_id", "failed", attempts.IP_FAILURES, attempts.IP_MEMORY_S
    )
    return without_zone(runs, "first_failure", "last_failure")


def as_reviews(events):
    return events.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("product_id"),
        F.lit("").alias("review_id"),
        F.col("event_type").alias("text"),
        F.lit(5.0).alias("rating"),
        F.col("ts").alias("created_at"),
    )


DEDUPED = "SELECT DISTINCT 'u' || user_id AS product_id, event_type AS text FROM events"


@query("stream_dedupe", DEDUPED)
def stream_dedupe(spark, d):
    kept = arriving(spark, d, "dedupe", lambda e: streams.stream_dedupe(as_reviews(e), "created_at", "40 days"))
    return kept.select("product_id", "text")


@query("stream_dedupe_for_good", DEDUPED)
def stream_dedupe_for_good(spark, d):
    """Repeats come weeks after the first; only what is seen outside of the stream's state knows them."""
    events = load(spark, d, "events").filter("ts IS NOT NULL")
    folder, path, state = (work_path(spark, f"for-good-{x}") for x in ("arrivals", "table", "state"))
    first = F.unix_timestamp(F.col("ts").cast("timestamp")) < events.agg(F.avg(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("t")).scalar()
    for i, part in enumerate((first & (F.col("event_id") % 2 == 0), first & (F.col("event_id") % 2 == 1), ~first)):
        streams.write_arrivals(events.filter(part), folder, i)
        arrived = as_reviews(streams.read_events(spark, folder, events.schema, files_per_trigger=1))
        kept = streams.dedupe_for_good(arrived, path, state)
    return kept.select("product_id", "text")


@query(
    "stream_visit_counts",
    "SELECT date_trunc('hour', ts) AS period_start, '/' || event_type AS endpoint, COUNT(*) AS visits FROM events GROUP BY ALL",
)
def stream_visit_counts(spark, d):
    def counts(events):
        visits = events.select(F.concat(F.lit("/"), "event_type").alias("endpoint"), F.col("ts").alias("created_at"))
        return streams.stream_visit_counts(visits)

    return without_zone(arriving(spark, d, "visit-counts", counts), "period_start")


@query(
    "stream_visitors",
    "SELECT date_trunc('week', ts) AS period_start, '/' || event_type AS endpoint, COUNT(*) AS visits, COUNT(DISTINCT user_id) AS visitors, TRUE AS close "
    "FROM events GROUP BY ALL",
)
def stream_visitors(spark, d):
    """Sketches that a stream stored by the hour, merged to weeks; ``close`` holds them against exact numbers."""
    sketches = arriving(spark, d, "visitors", lambda e: streams.stream_visitor_sketches(derive.as_visits(e)))
    about = streams.merged_visitors(sketches, "week").withColumnRenamed("visitors", "about")
    exact = (
        derive.site_visits(spark, d)
        .groupBy(F.date_trunc("week", F.col("created_at").cast("timestamp")).alias("period_start"), "endpoint")
        .agg(F.countDistinct("ip_address").alias("visitors"))
    )
    close = F.abs(F.col("about") - F.col("visitors")) <= F.col("visitors") * 0.05 + 1
    found = about.join(exact, ["period_start", "endpoint"], "full").withColumn("close", F.coalesce(close, F.lit(False))).drop("about")
    return without_zone(found, "period_start")


@query("append_batches", "SELECT event_type, COUNT(*) AS n FROM events GROUP BY ALL")
def append_batches(spark, d):
    """Batches of an event table, one of which is written twice and one of which never ended."""
    events, path = load(spark, d, "events"), work_path(spark, "event-batches")
    for batch in (0, 1, 2, 1):
        sinks.write_batch(events.filter(F.pmod("event_id", F.lit(3)) == batch), path, batch)
    events.limit(10).write.parquet(f"{path}/data/{sinks.BATCH}=3")
    return sinks.read_batches(spark, path, events.schema).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
