"""Tables that streams write batch by batch, so that a batch that is run again changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

BATCH = "batch_id"


def _data(path: str) -> str:
    return f"{path}/data"


def _manifest(path: str) -> str:
    return f"{path}/manifest"


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one batch of an event table: its rows in a folder of its own, then its line in the manifest.

    Running a batch again replaces what an earlier run left, whether that ended or not. Readers go by the manifest, so
    they never see part of a batch.
    """
    df.write.mode("overwrite").parquet(f"{_data(path)}/{BATCH}={batch_id}")
    done = df.sparkSession.range(1).select(F.lit(batch_id).cast("long").alias(BATCH))
    done.write.mode("overwrite").parquet(f"{_manifest(path)}/part={batch_id}")


def finished_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{BATCH} long, part long").parquet(_manifest(path)).select(BATCH)


def read_batches(spark: SparkSession, path: str, schema, keep_batch: bool = False) -> DataFrame:
    """The rows of all finished batches of a table; ``schema`` is that of the rows."""
    columns = [f.name for f in schema.fields]
    stored = StructType([*schema.fields, *([StructField(BATCH, LongType())] if BATCH not in columns else [])])
    rows = spark.read.schema(stored).parquet(_data(path))
    done = rows.join(finished_batches(spark, path), BATCH, "left_semi")
    return done.select(*columns, *([BATCH] if keep_batch else []))


def run_batches(stream: DataFrame, path: str, state: str, each: Callable[[DataFrame, int], DataFrame] | None = None, mode: str = "append") -> None:
    """Run a stream over what has arrived since its last run into the table at ``path``; ``state`` is its checkpoint.

    ``each`` may change a micro-batch, knowing its number. A run that was broken off is taken up where it stopped, and
    the batch that it was in is written anew.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(each(batch, batch_id) if each else batch, path, batch_id)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    writer.foreachBatch(write).start().awaitTermination()
