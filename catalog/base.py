from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: ``documents`` read as reviews; the twin of ``trustgrain.plans.derive.reviews``.
REVIEWS_SQL = """
b AS (SELECT *, MOD(doc_id, 20) AS k, CAST(FLOOR(doc_id / 20) AS BIGINT) AS seq FROM documents),
reviews AS (
  SELECT source AS product_id, doc_id AS review_idx, text,
    CAST(CASE MOD(k, 4)
      WHEN 0 THEN CASE MOD(seq, 10) WHEN 1 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 6 THEN 2 WHEN 7 THEN 4
                                    WHEN 9 THEN 1 ELSE 5 END
      WHEN 1 THEN CASE WHEN MOD(seq, 10) IN (1, 3, 6) THEN 1 WHEN MOD(seq, 10) = 8 THEN 3 ELSE 5 END
      WHEN 2 THEN CASE WHEN MOD(seq, 20) = 0 THEN 4 ELSE 5 END
      ELSE 1 + MOD(seq, 5) END AS DOUBLE) AS rating,
    CAST(DATE '2024-01-01' + CAST(CASE WHEN MOD(k, 3) = 0 AND MOD(seq, 10) < 7 THEN 10 + MOD(seq, 3)
                                  ELSE MOD(seq, 90) END AS INTEGER) AS DATE) AS review_date,
    CASE WHEN MOD(n_chars, 7) < 4 THEN 'positive' WHEN MOD(n_chars, 7) < 6 THEN 'negative' ELSE 'neutral' END
      AS sentiment,
    CAST(50 + MOD(n_chars, 50) AS DOUBLE) / 100 AS confidence,
    CAST(MOD(n_chars, 101) AS DOUBLE) / 100 AS ai_probability,
    CAST(1 + MOD(n_chars, 5) AS INTEGER) AS predicted_rating,
    lang
  FROM b)
"""


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, the statement with the same result."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def plain(view: str) -> str:
    """A shared SQL view with its table names as they are."""
    return view.replace("{", "").replace("}", "")
