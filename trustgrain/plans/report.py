"""The product trust report: six detectors, one weighted score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..operators import bursts, duplicates, phrases, ratings
from ..operators.similarity import MIN_WORDS
from ..operators.words import worded

# Share of each detector in the trust score, in summing order.
WEIGHTS = (
    ("review_burst", 0.20),
    ("rating_distribution", 0.20),
    ("duplicate_content", 0.20),
    ("rating_sentiment_mismatch", 0.15),
    ("phrase_repetition", 0.15),
    ("length_uniformity", 0.10),
)


def product_profile(reviews: DataFrame) -> DataFrame:
    """Everything the sum detectors and the burst detector need, from one scan.

    Rows are first reduced to one per product and day, which is where a product with very many reviews shrinks, and
    then to one per product. The burst window runs over days.
    """
    n_words = F.col("n_words") if "n_words" in reviews.columns else F.coalesce(word_count(F.col("text")), F.lit(0))
    measured = reviews.select(
        "product_id",
        F.col("review_date").alias("day"),
        F.col("rating").cast("int").alias("stars"),
        ratings.contradiction().alias("contradicts"),
        n_words.cast("long").alias("words"),
        (n_words >= MIN_WORDS).alias("valid"),
    )
    by_day = measured.groupBy("product_id", "day").agg(*ratings.additive(), F.count_if("valid").alias("n_valid"))
    dated = F.col("day").isNotNull()
    windowed = by_day.withColumn("n_day", F.when(dated, F.col("n"))).withColumn(
        "n_window", F.when(dated, bursts.window_sum())
    )
    sums = [F.sum(c).alias(c) for c in [*ratings.ADDITIVE_NAMES, "n_valid"]]
    return windowed.groupBy("product_id").agg(*sums, *bursts.worst_window())


def trust_score(scores: dict[str, Column]) -> Column:
    """Weighted mean of the detector scores, ties to even."""
    parts = [scores[name] * F.lit(weight) for name, weight in WEIGHTS]
    return F.bround(reduce(lambda a, b: a + b, parts), 0).cast("int")


def trust_label(score: Column) -> Column:
    return (
        F.when(score >= 80, "High Trust")
        .when(score >= 60, "Moderate Trust")
        .when(score >= 40, "Low Trust")
        .otherwise("Very Low Trust")
    )


def trust_report(reviews: DataFrame, min_reviews: int = 3, threshold: float = 0.75) -> DataFrame:
    """One row per product with at least ``min_reviews`` reviews.

    Each detector is a struct of fixed size. The flagged reviews themselves, which may be many, are rows of
    :func:`flagged_reviews`. Texts are read once.
    """
    reviews = worded(reviews.select("product_id", "review_idx", "review_date", "rating", "sentiment", "confidence", "text"))
    profile = product_profile(reviews).filter((F.col("n") >= min_reviews) & F.col("product_id").isNotNull())
    dup = duplicates.duplicate_facts(duplicates.cluster_sizes(duplicates.clustered_bags(reviews, threshold)))
    kept = phrases.kept_phrases(reviews).drop("n")
    judged = (
        profile.join(dup, "product_id", "left")
        .join(kept, "product_id", "left")
        .select(
            "product_id",
            F.col("n").alias("total_reviews"),
            bursts.burst_verdict().alias("review_burst"),
            ratings.rating_verdict().alias("rating_distribution"),
            ratings.mismatch_verdict().alias("rating_sentiment_mismatch"),
            duplicates.duplicate_verdict().alias("duplicate_content"),
            ratings.length_verdict().alias("length_uniformity"),
            phrases.phrase_verdict().alias("phrase_repetition"),
            ratings.rating_map().alias("distribution"),
            ratings.rounded_length_stats().alias("length_stats"),
            F.transform("repeated", lambda p: p.getField("phrase")).alias("repeated_phrases"),
        )
    )
    score = trust_score({name: F.col(f"{name}.score") for name, _ in WEIGHTS})
    issues = reduce(lambda a, b: a + b, [F.col(f"{name}.detected").cast("int") for name, _ in WEIGHTS])
    return judged.withColumn("trust_score", score).select(
        "product_id",
        "total_reviews",
        "trust_score",
        trust_label(F.col("trust_score")).alias("trust_label"),
        issues.alias("issues_found"),
        *[name for name, _ in WEIGHTS],
        "distribution",
        "length_stats",
        "repeated_phrases",
    )


def flat_report(reviews: DataFrame, min_reviews: int = 3) -> DataFrame:
    """The report with plain columns only: severity, score and details of each detector."""
    report = trust_report(reviews, min_reviews)
    columns = [
        F.col(f"{name}.{part}").alias(f"{name}_{part}") for name, _ in WEIGHTS for part in ("severity", "score", "details")
    ]
    return report.select("product_id", "total_reviews", "trust_score", "trust_label", "issues_found", *columns)


def flagged_reviews(reviews: DataFrame, every_phrase: bool = False) -> DataFrame:
    """Every review that some detector points at, one row per detector: ``(product_id, detector, review_idx)``.

    Phrases are those that the report lists, or, with ``every_phrase``, all that are in enough reviews.
    """
    repeated = phrases.repeated_phrase_reviews if every_phrase else phrases.phrase_reviews
    pick = lambda df, name: df.select("product_id", F.lit(name).alias("detector"), "review_idx")
    return (
        pick(bursts.burst_reviews(reviews), "review_burst")
        .union(pick(ratings.mismatched_reviews(reviews), "rating_sentiment_mismatch"))
        .union(pick(duplicates.duplicate_reviews(reviews), "duplicate_content"))
        .union(pick(repeated(reviews).select("product_id", "review_idx").distinct(), "phrase_repetition"))
    )


def flagged_arrays(flagged: DataFrame, span: int = 4096) -> DataFrame:
    """Flagged reviews as arrays of bounded length: one row per product, detector and block of ``span`` indices."""
    return (
        flagged.groupBy("product_id", "detector", F.floor(F.col("review_idx") / span).alias("block"))
        .agg(F.array_sort(F.collect_list("review_idx")).alias("review_indices"))
    )
