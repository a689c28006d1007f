"""Changes to stored tables, as rewrites: insert, update, purge, erase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.urls import host
from .skew import spread_over


def insert_if_absent(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Existing rows, and new rows whose key is not there yet."""
    return existing.unionByName(new.join(existing.select(*key), key, "left_anti"))


def update_where(df: DataFrame, condition: Column, changes: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})


def revoke_tokens(tokens: DataFrame, users: DataFrame) -> DataFrame:
    """Mark all tokens of the given users as revoked. ``users(user_id)`` must not repeat a user."""
    marked = tokens.join(users.select("user_id", F.lit(True).alias("_hit")), "user_id", "left")
    return marked.withColumn("revoked", F.col("revoked") | F.coalesce("_hit", F.lit(False))).drop("_hit")


def purge_tokens(tokens: DataFrame, as_of: Column) -> DataFrame:
    """Keep tokens that are neither expired nor revoked."""
    return tokens.filter(~((F.col("expires_at") < as_of) | F.col("revoked")))


def erase_users(tables: dict[str, DataFrame], erased: DataFrame, key: str = "user_id") -> dict[str, DataFrame]:
    """Every table without the rows of the erased users."""
    return {name: df.join(erased.select(key), key, "left_anti") for name, df in tables.items()}


#: Bits of the map of users that a data file has, as a power of two, and of one slice of it.
FILE_BITS = 20
_SLICE = 32_768


def _place(key: str) -> Column:
    """Bits and slices are counted from 1."""
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << FILE_BITS)) + 1


class UserFiles:
    """A stored table with a bitmap of the users in each of its data files, so that erasing users reads and rewrites only
    files that may hold one of them.

    The index is a table ``(file, slice, bits)``, at most 128 KB per data file. Erasing writes what is left of the files
    concerned into a new folder, and then a new list of the files that make up the table, so a run that is broken off
    leaves the table as it was. ``drop_replaced`` deletes the old files.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "user_id", version: int = 0):
        self.spark, self.path, self.schema, self.key, self.version = spark, path, schema, key, version

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str = "user_id", files: int | None = None) -> UserFiles:
        """Store a table in ranges of ``key``, so that a user is in few files; as many as a shuffle has parts, or ``files``."""
        table = cls(df.sparkSession, path, df.schema, key)
        table._list(table._added(df.repartitionByRange(files or spread_over(df), key), 0), 0)
        return table

    def _added(self, df: DataFrame, version: int) -> DataFrame:
        """Write rows to a folder of their own; returns the index of its files."""
        df.write.mode("overwrite").parquet(f"{self.path}/data/{version}")
        rows = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{version}")
        # Distinct places first: a bitmap is built of sorted rows, and a file has fewer users than rows.
        placed = rows.select(F.col("_metadata.file_path").alias("file"), _place(self.key).alias("place")).distinct()
        return placed.groupBy("file", F.bitmap_bucket_number("place").alias("slice")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")
        )

    def _list(self, index: DataFrame, version: int) -> None:
        index.write.mode("overwrite").parquet(f"{self.path}/files/{version}")
        self.version = version

    def files(self) -> DataFrame:
        """``(file, slice, bits)`` of the data files that make up the table."""
        return self.spark.read.schema("file string, slice long, bits binary").parquet(f"{self.path}/files/{self.version}")

    def read(self, files: list[str] | None = None) -> DataFrame:
        """The rows of the table, or of some of its files. Only names of files come to the driver, as for any scan."""
        if files is None:
            files = [r["file"] for r in self.files().select("file").distinct().collect()]
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def concerned(self, erased: DataFrame) -> list[str]:
        """The files that may hold one of the ``erased`` users."""
        places = erased.select(_place(self.key).alias("place")).distinct()
        asked = places.select(F.bitmap_bucket_number("place").alias("slice"), F.bitmap_bit_position("place").alias("at"))
        byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        held = self.files().join(asked, "slice").filter(F.getbit(byte, (F.col("at") % 8).cast("int")) == 1)
        return sorted(r["file"] for r in held.select("file").distinct().collect())

    def erase(self, erased: DataFrame) -> list[str]:
        """Drop all rows of the ``erased`` users; returns the files that were replaced."""
        hit = self.concerned(erased)
        if hit:
            left = self.read(hit).join(erased.select(self.key).distinct(), self.key, "left_anti").select(*self.schema.names)
            index = self._added(left, self.version + 1)
            names = self.spark.createDataFrame([(f,) for f in hit], "file string")
            self._list(self.files().join(names, "file", "left_anti").unionByName(index), self.version + 1)
        return hit

    def drop_replaced(self, files: list[str]) -> None:
        """Delete files that ``erase`` has replaced, so that the erased rows are gone from the disk."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for file in files:
            path = jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(conf).delete(path, False)


def save_summary(requests: DataFrame) -> DataFrame:
    """Requests to store a product summary as rows of the link-analysis table; missing numbers become 0."""
    zero = lambda c, t: F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c)
    return requests.select(
        "user_id",
        F.trim("product_url").alias("product_url"),
        host(F.trim("product_url")).alias("domain"),
        zero("total_reviews", "int"),
        *[
            zero(c, "double")
            for c in (
                "positive_percentage",
                "negative_percentage",
                "neutral_percentage",
                "average_predicted_rating",
                "ai_generated_percentage",
            )
        ],
        F.coalesce("languages_detected", F.lit("")).alias("languages_detected"),
    )


def summary_events(saved: DataFrame) -> DataFrame:
    """One analysis record per language of a stored summary."""
    return saved.select(
        F.lit("PRODUCT_LINK").alias("analysis_type"),
        F.col("user_id").isNotNull().alias("authenticated"),
        "user_id",
        "domain",
        F.explode(F.array_distinct(F.split("languages_detected", r",\s*"))).alias("detected_language"),
    )
