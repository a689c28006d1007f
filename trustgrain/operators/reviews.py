"""Row-level review operators: validation, filters, removal of repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pages import is_boilerplate
from ..functions.text import fingerprint, is_blank, search_any, strip
from .skew import top_k


def validate_reviews(df: DataFrame, min_len: int = 10, max_len: int = 5000, url: str | None = None) -> DataFrame:
    """Add ``error``: null for usable rows. Rows are marked, not dropped; split with ``filter(error IS [NOT] NULL)``."""
    size = F.length("text")
    error = F.when(is_blank(F.col("text")), "Review text is required").when(
        ~size.between(min_len, max_len), f"Review text must be between {min_len} and {max_len} characters"
    )
    if url:
        error = error.when(~F.coalesce(F.col(url).rlike("^https?://.*"), F.lit(False)), "URL must be http or https")
    return df.withColumn("error", error)


def mark_empty(scored: DataFrame) -> DataFrame:
    """Rows without text keep their place but carry no result: sentiment ``unknown``, zeros, label ``Skipped``."""
    empty = is_blank(F.col("text"))
    blank = {
        "sentiment": F.lit("unknown"),
        "confidence": F.lit(0.0),
        "predicted_rating": F.lit(0),
        "ai_probability": F.lit(0.0),
        "authenticity_score": F.lit(0),
        "authenticity_label": F.lit("Skipped"),
        "language": F.lit(""),
    }
    filled = {c: F.when(empty, v).otherwise(F.col(c)) for c, v in blank.items() if c in scored.columns}
    old_error = F.col("error") if "error" in scored.columns else F.lit(None).cast("string")
    return scored.withColumns({**filled, "error": F.when(empty, "Empty review text").otherwise(old_error)})


def usable(df: DataFrame) -> DataFrame:
    return df.filter(F.col("error").isNull())


def drop_blank(df: DataFrame, column: str = "text") -> DataFrame:
    return df.filter(~is_blank(F.col(column)))


def drop_boilerplate(df: DataFrame, column: str = "text") -> DataFrame:
    return df.filter(~is_boilerplate(F.col(column)))


def filter_reviews(df: DataFrame, kind: str = "all") -> DataFrame:
    """``all``, ``ai`` (probability above one half), or a sentiment."""
    if kind == "all":
        return df
    if kind == "ai":
        return df.filter(F.col("ai_probability") > 0.5)
    return df.filter(F.lower(F.coalesce("sentiment", F.lit(""))) == kind)


def search(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    return df.filter(search_any(query, *columns))


def since(df: DataFrame, column: str, as_of: Column, interval: str, inclusive: bool) -> DataFrame:
    """Rows of the last ``interval`` before ``as_of``. Analyses count strictly after its start, visits from it on."""
    start = as_of - F.expr(f"INTERVAL {interval}")
    return df.filter(F.col(column) >= start if inclusive else F.col(column) > start)


def identity_key() -> Column:
    """What makes two reviews the same: their id, or else fingerprint and rating. The two kinds never meet."""
    has_id = F.coalesce(F.col("review_id"), F.lit("")) != ""
    return F.struct(
        F.when(has_id, F.col("review_id")).alias("id"),
        F.when(~has_id, fingerprint(F.col("text"))).alias("fp"),
        F.when(~has_id, F.col("rating")).alias("stars"),
    )


def dedupe_reviews(df: DataFrame, order_by: list[str], by: list[str] | None = None) -> DataFrame:
    """Keep the first of equal reviews under ``order_by``, which tells any two of them apart; of rows equal in it, too, one.

    What is compared is a digest of the identity and the order alone. The first of each is found by an aggregate that
    every task starts on its own rows, so a review copied a billion times reaches the shuffle once per task, and texts
    are not sorted.
    """
    keys = list(by or [])
    digest = F.xxhash64(F.sha2(F.to_json(identity_key()), 256)).alias("_digest")
    order = F.struct(*order_by)
    first = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], digest).agg(F.min(order).alias("_order"))
    same = F.col("_digest") == F.col("_own_digest")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    own = df.withColumn("_own_digest", digest).withColumn("_own_order", order)
    found = own.join(first, same & (F.col("_own_order") == F.col("_order")), "left_semi")
    return found.dropDuplicates([*keys, "_own_digest", *order_by]).select(*df.columns)


def page_yield(df: DataFrame, order_by: list[str], by: list[str], page: str = "page_no") -> DataFrame:
    """Reviews found, new and repeated per page, where a review counts as new on the first page that shows it."""
    found = df.groupBy(*by, page).agg(F.count(F.lit(1)).alias("found"))
    fresh = dedupe_reviews(df, order_by, by).groupBy(*by, page).agg(F.count(F.lit(1)).alias("fresh"))
    return found.join(fresh, [*by, page], "left").select(
        *by,
        page,
        "found",
        F.coalesce("fresh", F.lit(0).cast("long")).alias("fresh"),
        (F.col("found") - F.coalesce("fresh", F.lit(0))).alias("repeated"),
    )


def drop_contained(found: Column) -> Column:
    """Of the reviews of one page, drop those whose text is part of a longer one on that page.

    Works on the page's own array, so nothing is shuffled and no group can grow beyond a page.
    """
    flat = F.transform(found, lambda r: F.lower(strip(r.getField("text"))))
    marked = F.zip_with(
        F.zip_with(found, flat, lambda r, t: F.struct(r.alias("r"), t.alias("t"))),
        F.array_repeat(flat, F.size(found)),
        lambda x, all_texts: F.when(
            ~F.exists(
                all_texts,
                lambda o: (F.length(o) > F.length(x.getField("t"))) & F.contains(o, x.getField("t")),
            ),
            x.getField("r"),
        ),
    )
    return F.filter(marked, lambda r: r.isNotNull())


def max_reviews(df: DataFrame, by: list[str], order: list[Column], k: int, spread: list[str]) -> DataFrame:
    """The session cap: the first ``k`` reviews of each product."""
    return top_k(df, by, order, k, spread).drop("rank")


def languages(df: DataFrame, by: list[str], column: str = "language") -> DataFrame:
    """Distinct languages per group, sorted."""
    present = df.filter(F.coalesce(F.col(column), F.lit("")) != "")
    return present.groupBy(*by).agg(F.array_sort(F.collect_set(column)).alias("languages"))
