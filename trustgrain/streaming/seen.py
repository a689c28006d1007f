"""Keys that a stream has seen, kept without end outside of its state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import BATCH

#: Parts of the key store, bits of the filter before it as a power of two, and the bits that each key sets.
BUCKETS = 64
FILTER_BITS = 27
HASHES = 3
#: Bits of one slice of the filter, as ``bitmap_construct_agg`` makes them.
_SLICE = 32_768


def _place(key: str, salt: int) -> Column:
    """Bits and slices are counted from 1."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << FILTER_BITS)) + 1


def _bit(bits: Column, position: Column) -> Column:
    """Whether the bit at ``position`` (from 0) of a bitmap is set, lowest bit of a byte first."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


class SeenKeys:
    """A set of string keys in a folder: keys by bucket and batch, and a Bloom filter of them by batch.

    Nothing is ever dropped, so a key is known however late it comes again. A batch asks the filter first, which has a
    fixed size; only keys that it may hold are looked up in the store, in the buckets that they fall into. What a batch
    adds is written under its number: running it again replaces that, and it never sees its own keys.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _read(self, part: str, schema: str, before: int) -> DataFrame | None:
        if before <= 0:
            return None
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}").filter(F.col(BATCH) < before)

    def _filter(self, before: int) -> DataFrame | None:
        """One row per slice: at most ``2 ** FILTER_BITS / 32768`` rows of 4 KB."""
        found = self._read("filter", f"slice long, bits binary, {BATCH} long", before)
        return None if found is None else found.groupBy("slice").agg(F.bitmap_or_agg("bits").alias("bits"))

    def maybe_seen(self, keys: DataFrame, key: str, batch_id: int) -> DataFrame | None:
        """The ``keys`` that the filter of earlier batches cannot rule out; None before the first batch."""
        slices = self._filter(batch_id)
        if slices is None:
            return None
        found = keys
        for salt in range(HASHES):
            place = _place(key, salt)
            at = F.bitmap_bucket_number(place)
            here = slices.select(F.col("slice").alias("_slice"), F.col("bits").alias("_bits"))
            found = found.join(here, at == F.col("_slice")).filter(_bit(F.col("_bits"), F.bitmap_bit_position(place))).drop("_slice", "_bits")
        return found

    def add_new(self, keys: DataFrame, key: str, batch_id: int) -> DataFrame:
        """The distinct ``keys(key)`` of a batch that no earlier batch had; they are in the store from then on."""
        own = keys.select(F.col(key).alias("key")).distinct()
        maybe = self.maybe_seen(own, "key", batch_id)
        if maybe is not None:
            bucket = F.pmod(F.xxhash64("key", F.lit(HASHES)), F.lit(self.buckets)).cast("int")
            stored = self._read("keys", f"key string, bucket int, {BATCH} long", batch_id)
            known = maybe.withColumn("bucket", bucket).join(stored.select("bucket", "key"), ["bucket", "key"], "left_semi")
            own = own.join(known.select("key"), "key", "left_anti")
        self._write(own, batch_id)
        return self.spark.read.schema("key string, bucket int").parquet(f"{self.path}/keys/{BATCH}={batch_id}").select("key")

    def _write(self, own: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64("key", F.lit(HASHES)), F.lit(self.buckets)).cast("int")
        target = f"{self.path}/keys/{BATCH}={batch_id}"
        own.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(target)
        keys = self.spark.read.schema("key string, bucket int").parquet(target)
        places = keys.select(F.explode(F.array(*[_place("key", salt) for salt in range(HASHES)])).alias("place"))
        bits = places.groupBy(F.bitmap_bucket_number("place").alias("slice")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
        )
        bits.write.mode("overwrite").parquet(f"{self.path}/filter/{BATCH}={batch_id}")
