"""Reading JSON of unknown shape as VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIST = "array<variant>"


def parse(text: Column) -> Column:
    return F.try_parse_json(text)


def path(*keys: str) -> str:
    return "$" + "".join(f'["{k}"]' for k in keys)


def get(v: Column, *keys: str, type: str = "string") -> Column:  # noqa: A002
    return F.try_variant_get(v, path(*keys), type)


def kind(v: Column) -> Column:
    """Shape of a value: ``OBJECT``, ``ARRAY``, ``STRING``, a number type, ``VOID``; null where there is no value."""
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)


def string(v: Column, *keys: str) -> Column:
    """Value only where it is a JSON string."""
    found = get(v, *keys, type="variant")
    return F.when(kind(found) == "STRING", F.try_variant_get(found, "$", "string"))


def scalar_text(v: Column, *keys: str) -> Column:
    """Text of a string, number or boolean; null for objects, lists and missing values."""
    found = get(v, *keys, type="variant")
    return F.when(~kind(found).isin("OBJECT", "ARRAY", "VOID"), F.try_variant_get(found, "$", "string"))


def one_or_many(v: Column) -> Column:
    """A list as it is, a single value as a list of one, nothing as null."""
    return F.coalesce(F.try_variant_get(v, "$", LIST), F.when(v.isNotNull(), F.array(v)))
