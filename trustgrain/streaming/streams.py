"""Structured Streaming jobs.

Counts are appended once their period is closed: when the watermark has passed it, its state is dropped and its row never
changes again. ``closing`` tells a stream that ends, such as a replay of stored events, that no more will come.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.attempts import requests_per_minute
from ..operators.reviews import identity_key
from ..session import work_path
from .seen import SeenKeys
from .sinks import read_batches, run_batches


def read_events(spark: SparkSession, folder: str, schema, files: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    """Event files of a folder as a stream; ``files`` is a pattern for their names.

    Zone-less time columns are read as instants, which is what event time and watermarks need.
    """
    options = {"maxFilesPerTrigger": files_per_trigger, "pathGlobFilter": files, "recursiveFileLookup": "true"}
    stream = spark.readStream.schema(schema).options(**options).parquet(folder)
    plain = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in plain})


def write_arrivals(events: DataFrame, folder: str, part: int, ts: str = "ts") -> None:
    """One file of arriving events, as a collector would drop it: ``part`` says after which others."""
    events.sortWithinPartitions(ts).coalesce(1).write.mode("overwrite").parquet(f"{folder}/part={part:06}")


def closing(events: DataFrame, ts: str = "ts", after: str = "1 year") -> DataFrame:
    """The last event once more, far later: it moves the watermark and so closes all periods before. Its own period stays
    open, so it is never counted."""
    return events.orderBy(F.desc_nulls_last(ts)).limit(1).withColumn(ts, F.col(ts) + F.expr(f"INTERVAL {after}"))


def stream_request_minutes(visits: DataFrame, ts: str = "created_at", delay: str = "1 day") -> DataFrame:
    """Requests per client and minute as they arrive, by the same rule as the batch operator."""
    return requests_per_minute(visits.withWatermark(ts, delay), ts)


def stream_failure_bursts(failures: DataFrame, key: str, limit: int, memory_s: int, ts: str = "created_at", delay: str = "1 day") -> DataFrame:
    """Arriving failures of a key with pauses of at most ``memory_s`` between them: when, how many, locked or not.

    A session needs no more state than its bounds and its count, so a busy key costs what a quiet one does.
    """
    return (
        failures.withWatermark(ts, delay)
        .groupBy(key, F.session_window(ts, f"{memory_s} seconds").alias("burst"))
        .agg(F.min(ts).alias("first_failure"), F.max(ts).alias("last_failure"), F.count(F.lit(1)).alias("failures"))
        .select(key, "first_failure", "last_failure", "failures", (F.col("failures") >= limit).alias("locked"))
    )


def stream_dedupe(stream: DataFrame, ts: str, delay: str = "1 day") -> DataFrame:
    """Arriving reviews without repeats inside the watermark, by the same key as the batch operator."""
    keyed = stream.withColumn("_key", F.to_json(identity_key()))
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["product_id", "_key"]).drop("_key")


def stream_visit_counts(stream: DataFrame, ts: str = "created_at", span: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Visits per endpoint and period."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, span), "endpoint")
        .agg(F.count(F.lit(1)).alias("visits"))
        .select(F.col("window.start").alias("period_start"), "endpoint", "visits")
    )


def stream_visitor_sketches(stream: DataFrame, ts: str = "created_at", span: str = "1 hour", delay: str = "1 day", log2_size: int = 12) -> DataFrame:
    """Visits and a sketch of the visitors (``ip_address``) per endpoint and period.

    Sketches of a period's parts merge into that of the whole (``merged_visitors``), which distinct counts do not.
    """
    return (
        stream.withWatermark(ts, delay)
        .groupBy(F.window(ts, span), "endpoint")
        .agg(F.count(F.lit(1)).alias("visits"), F.hll_sketch_agg("ip_address", F.lit(log2_size)).alias("visitors"))
        .select(F.col("window.start").alias("period_start"), "endpoint", "visits", "visitors")
    )


def merged_visitors(sketches: DataFrame, period: str, by: tuple[str, ...] = ("endpoint",)) -> DataFrame:
    """Visits and about how many visitors per ``period`` (such as ``day``, ``week`` or ``month``), from stored sketches.

    With the default size of 2 ** 12 the error is below 5 % with more than 99 % probability.
    """
    return sketches.groupBy(F.date_trunc(period, "period_start").alias("period_start"), *by).agg(
        F.sum("visits").alias("visits"), F.hll_sketch_estimate(F.hll_union_agg("visitors")).alias("visitors")
    )


def dedupe_for_good(reviews: DataFrame, path: str, state: str) -> DataFrame:
    """Run a stream of reviews into the table at ``path`` without repeats of any age, and return that table.

    A repeat has the product and the identity of an earlier review (the key of the batch operator). The keys seen are
    kept in ``SeenKeys`` next to the table, not in the state of the stream, so no watermark forgets them. Of repeats in
    one micro-batch the earliest stays, of equals any.
    """
    spark = reviews.sparkSession
    keyed = reviews.withColumn("_key", F.sha2(F.concat_ws("\u0000", F.coalesce("product_id", F.lit("")), F.to_json(identity_key())), 256))
    seen = SeenKeys(spark, f"{path}/seen")

    def new_rows(batch: DataFrame, batch_id: int) -> DataFrame:
        new = seen.add_new(batch, "_key", batch_id).withColumnRenamed("key", "_key")
        rows = [c for c in batch.columns if c != "_key"]
        first = batch.groupBy("_key").agg(F.min_by(F.struct(*rows), F.struct("created_at", *rows)).alias("row"))
        return first.join(new, "_key", "left_semi").select("row.*")

    run_batches(keyed, f"{path}/rows", state, new_rows)
    return read_batches(spark, f"{path}/rows", reviews.schema)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now and return the table of the rows that it appended, in the shared folder."""
    spark = stream.sparkSession
    target, state = work_path(spark, name), work_path(spark, f"{name}-state")
    run_batches(stream, target, state)
    return read_batches(spark, target, stream.schema)


def replay(events: DataFrame, name: str, job: Callable[[DataFrame], DataFrame], files: int = 4, ts: str = "ts", late: str = "6 hours") -> DataFrame:
    """What a streaming ``job`` appends when stored events arrive in several files, in order of time but for delays of up
    to ``late``, one file per micro-batch, with a stop and a restart halfway and all periods closed at the end."""
    spark = events.sparkSession
    folder, target, state = (work_path(spark, f"{name}-{x}") for x in ("arrivals", "rows", "state"))
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp")) + F.pmod(F.xxhash64(*events.columns), F.unix_seconds(F.expr(f"TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {late}")))
    ends = events.agg(F.min(seconds).alias("first"), F.max(seconds).alias("last")).first()
    span = max(1, (ends["last"] or 0) - (ends["first"] or 0) + 1)
    part = F.coalesce(F.floor((seconds - F.lit(ends["first"] or 0)) * files / span), F.lit(0))
    halves = [range(files // 2), range(files // 2, files)]
    for half in halves:
        for i in half:
            write_arrivals(events.filter(part == i), folder, i, ts)
        if files - 1 in half:
            write_arrivals(closing(events, ts), folder, files, ts)
        out = job(read_events(spark, folder, events.schema, files_per_trigger=1))
        run_batches(out, target, state)
    return read_batches(spark, target, out.schema)
