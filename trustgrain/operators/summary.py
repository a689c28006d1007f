"""Per-product summary of scored reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up
from .scoring import authenticity_label


def _share(hits: Column) -> Column:
    return round_half_up(F.count_if(hits).cast("double") / F.count(F.lit(1)) * 100.0, 1)


def product_summary(df: DataFrame, by: list[str] | None = None, other_is_neutral: bool = True) -> DataFrame:
    """Counts, sentiment shares, means and languages of usable rows (``error`` null), rounded to one decimal.

    ``other_is_neutral`` decides whether labels outside the three known ones count as neutral.
    """
    rows = df.filter(F.col("error").isNull()) if "error" in df.columns else df
    feeling = F.lower("sentiment")
    positive, negative = feeling == "positive", feeling == "negative"
    neutral = ~positive & ~negative if other_is_neutral else feeling == "neutral"
    authenticity = F.avg("authenticity_score")
    label = authenticity_label(authenticity)
    return rows.groupBy(*(by or ["product_id"])).agg(
        F.count(F.lit(1)).alias("total_reviews"),
        _share(positive).alias("positive_percentage"),
        _share(negative).alias("negative_percentage"),
        _share(neutral).alias("neutral_percentage"),
        round_half_up(F.avg("predicted_rating"), 1).alias("average_predicted_rating"),
        round_half_up(F.avg("ai_probability") * 100.0, 1).alias("ai_generated_percentage"),
        round_half_up(authenticity, 1).alias("average_authenticity_score"),
        label.alias("authenticity_label"),
        F.array_sort(F.collect_set(F.nullif("language", F.lit("")))).alias("languages_detected"),
    )
