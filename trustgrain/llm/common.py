"""Small helpers of the operators in this subpackage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import BATCH_BYTES, small_batches  # noqa: F401

#: A word is a run of anything but space and the control characters from tab to carriage return. ``bytes.split()``
#: cuts UTF-8 text at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hand_back() -> None:
    """Give memory that this Python worker no longer uses back to the machine.

    Workers outlive their tasks, and what their allocators keep counts against the executor until they end.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


Batches = Iterator[pd.DataFrame]


def tidy(fn: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``fn`` for ``mapInPandas``, handing memory back when a task's rows are done."""

    def run(batches: Batches) -> Batches:
        yield from fn(batches)
        hand_back()

    return run


def fresh(df: DataFrame | Iterable[str], name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called so (column names do not differ by case alone)."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    while name.lower() in taken:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def content_key(*columns: Column) -> Column:
    """32 hexadecimal digits that depend on the values of a row alone, so that reruns agree; nulls are allowed."""
    return F.md5(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))


def same(left: Column, right: Column) -> Column:
    """Equality in which null equals null."""
    return left.eqNullSafe(right)
