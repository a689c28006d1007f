"""Review files: CSV exports, JSON request bodies, appended event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
#: How raw exports mark a null; a text of just these characters is read as null.
NULL = r"\N"


def plain_rating(rating: Column) -> Column:
    """Whole ratings without ``.0``."""
    whole = F.round(rating)
    return F.when(F.abs(rating - whole) < 1e-9, whole.cast("int").cast("string")).otherwise(rating.cast("string"))


def raw_csv_rows(df: DataFrame) -> DataFrame:
    """``review_text, rating, date`` as they are written to a raw export."""
    return df.select(
        F.col("text").alias("review_text"),
        plain_rating(F.col("rating")).alias("rating"),
        F.coalesce(F.col("date_raw"), F.lit("")).alias("date"),
    )


def analysis_csv_rows(df: DataFrame) -> DataFrame:
    """The seven columns of an analysis export, with three and one decimals."""
    return df.select(
        "text",
        plain_rating(F.col("rating")).alias("rating"),
        "sentiment",
        F.format_string("%.3f", F.col("confidence")).alias("confidence"),
        F.col("predicted_rating").alias("predicted_rating"),
        F.format_string("%.3f", F.col("ai_probability")).alias("ai_probability"),
        F.format_string("%.1f", F.col("authenticity_score").cast("double")).alias("authenticity"),
    )


def write_reviews_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a raw export. An empty text is written as ``""``, a null one as ``NULL``, so both come back as they were."""
    raw_csv_rows(df).write.mode(mode).options(**CSV, nullValue=NULL).csv(path)


def write_analysis_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    analysis_csv_rows(df).write.mode(mode).options(**CSV, emptyValue="").csv(path)


def read_reviews_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw exports as ``text, rating, date_raw``. Quoted line breaks stay part of the text."""
    rows = spark.read.schema(schemas.RAW_REVIEW_CSV).options(**CSV, multiLine=True, nullValue=NULL).csv(path)
    return rows.select(
        F.col("review_text").alias("text"),
        F.col("rating").try_cast("double").alias("rating"),
        F.coalesce("date", F.lit("")).alias("date_raw"),
    )


def read_reviews_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Request bodies ``{"product_id"?, "reviews": [...]}``, one row per review with its position as ``review_idx``."""
    schema = f"product_id STRING, {schemas.REVIEW_BODY}"
    bodies = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    return explode_bodies(bodies)


def explode_bodies(bodies: DataFrame) -> DataFrame:
    return bodies.select("product_id", F.posexplode("reviews").alias("review_idx", "r")).select(
        "product_id",
        F.col("review_idx").cast("long").alias("review_idx"),
        F.col("r.text").alias("text"),
        F.col("r.rating").alias("rating"),
        F.col("r.date").alias("date_raw"),
        F.col("r.sentiment").alias("sentiment"),
        F.col("r.confidence").alias("confidence"),
        F.col("r.predictedRating").alias("predicted_rating"),
        F.col("r.aiGeneratedProbability").alias("ai_probability"),
        F.col("r.authenticityScore").alias("authenticity_score"),
    )


def append_events(df: DataFrame, path: str, partition_by: str | None = "day") -> None:
    """Append to an event table, in folders by day so that period counts read only their days."""
    writer = df.write.mode("append")
    if partition_by:
        if partition_by not in df.columns:
            writer = df.withColumn(partition_by, F.to_date("created_at")).write.mode("append")
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def visit_rows(requests: DataFrame, widths: dict[str, int] | None = None) -> DataFrame:
    """Requests as rows of the visit table. Texts stay whole; ``widths`` cuts columns for a table that needs it."""
    return requests.withColumns({name: F.substring(name, 1, n) for name, n in (widths or {}).items()})
