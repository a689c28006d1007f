"""A training corpus from ``documents``: five stages, each written as Parquet and read again as the next one's input.

All stages take rows of any kind: null or empty texts count as empty, null ids, sources and languages are values of their
own, repeated rows and several rows of one id are documents of their own, columns beyond ``COLUMNS`` are dropped, and an empty
table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustgrain.llm import lines, mixing, neardup, packing, quality, queries
from trustgrain.llm.common import fresh, table
from trustgrain.session import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject; it learns from the labels of the given documents.

    A null text is scored as an empty one. Without labels of one kind nothing, or everything, is rejected.
    """
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source and passages repeated on any pages.

    ``n_chars`` follows the text. A null text stays null.
    """
    cleaned = lines.drop_boilerplate(docs, long_words=lines.LONG_WORDS)
    return cleaned.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates; rows without an id stay.

    Of rows that repeat a kept id, all stay: the operator decides about ids. Texts without words are near no other.
    """
    dropped = (
        neardup.near_duplicates(docs)
        .filter("doc_id <> component_id")
        .select(F.col("doc_id").alias(key := fresh(docs, "dropped_id")))
        .distinct()
    )
    return docs.join(dropped, docs["doc_id"] == F.col(key), "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Documents without words have no size, so whether they stay does not change the mix; rows without a source are a source.
    """
    return mixing.mix(docs).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece with its ids and its place. A text that is null or empty is the end mark alone."""
    pieces = packing.token_pieces(docs, queries.TOKENIZER, queries.PATTERN, tokens=True)
    return packing.pack(written(pieces, "pieces"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]

#: Trained dictionaries, sketches and tokens are beyond SQL; tests hold each stage against a plain evaluation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
