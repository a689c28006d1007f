"""The library's functions for SQL text: scalar functions and a table function, registered on a session."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .functions import lang, text, urls
from .operators.extract.embedded import _reviews_in

#: Scalar functions by the name that SQL calls them by. Each is a SQL function with the library's own expression as its
#: body, so that it is optimised like any other.
FUNCTIONS = {
    "clean_text": (text.clean_text, "STRING"),
    "parse_rating": (text.parse_rating, "DOUBLE"),
    "parse_review_date": (text.parse_review_date, "DATE"),
    "text_fingerprint": (text.fingerprint, "STRING"),
    "detect_language": (lang.detect_language, "STRING"),
    "url_host": (urls.host, "STRING"),
}


def expression(column: Column, spark: SparkSession, **arguments: str) -> str:
    """A column over ``arguments`` (name: type) as SQL text, as Spark itself writes it."""
    empty = spark.createDataFrame([], T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in arguments.items()]))
    plan = empty.select(column.alias("result"))._jdf.queryExecution().analyzed()
    return plan.expressions().head().child().sql()


class ReviewsIn:
    """``reviews_in(TABLE(documents), 'doc')``: review-like objects anywhere in the JSON documents of a column.

    The result has the other columns of the table as they are, then ``pos``, ``text`` and ``rating``; documents that
    cannot be read give no row.
    """

    def __init__(self) -> None:
        self.names: list[str] | None = None

    @staticmethod
    def analyze(documents: AnalyzeArgument, doc: AnalyzeArgument) -> AnalyzeResult:
        if not documents.isTable or not doc.isConstantExpression:
            raise ValueError("reviews_in takes a table and the name of its column of documents")
        if doc.value not in documents.dataType.names:
            raise ValueError(f"no column {doc.value}")
        rest = [f for f in documents.dataType.fields if f.name != doc.value]
        found = [T.StructField("pos", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("rating", T.StringType())]
        return AnalyzeResult(schema=T.StructType([*rest, *found]))

    def eval(self, row, doc: str) -> Iterator[tuple]:
        if self.names is None:
            self.names = [n for n in row.__fields__ if n != doc]
        try:
            found = _reviews_in(json.loads(row[doc] or ""), 1)
        except (ValueError, RecursionError):
            return
        for pos, review in enumerate(found):
            yield (*[row[n] for n in self.names], pos, review["text"], review["rating"])


def register(spark: SparkSession) -> None:
    """Make ``FUNCTIONS`` and ``reviews_in`` known to the session's SQL, as temporary functions."""
    for name, (build, kind) in FUNCTIONS.items():
        body = expression(build(F.col("x")), spark, x="string")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body}")
    spark.udtf.register("reviews_in", F.udtf(ReviewsIn, useArrow=True))


def query(spark: SparkSession, statement: str, **tables: DataFrame) -> DataFrame:
    """Run SQL text with the library's functions over some tables."""
    register(spark)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(statement)
