"""Usage analytics: counts over users, analyses, visits and messages, listings and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions.crypto import decrypt
from ..session import ROW_GROUP
from .scoring import authenticity_label
from .skew import spread_over


def _ago(as_of: Column, interval: str) -> Column:
    return as_of - F.expr(f"INTERVAL {interval}")


def usage_metrics(metrics: DataFrame) -> DataFrame:
    """Analyses in all, by signed-in state and by type, in one pass."""
    return metrics.agg(
        F.count(F.lit(1)).alias("total_analyses"),
        F.count_if("authenticated").alias("by_authenticated"),
        F.count_if(~F.col("authenticated")).alias("by_anonymous"),
        F.count_if(F.col("analysis_type") == "INDIVIDUAL_REVIEW").alias("individual_reviews"),
        F.count_if(F.col("analysis_type") == "PRODUCT_LINK").alias("link_analyses"),
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Row count by value, most frequent first, nulls left out; equal counts in order of the value."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc(column))
    )


def rolling_counts(metrics: DataFrame, as_of: Column) -> DataFrame:
    """Analyses in all, of the last day, week and 30 days (start excluded), and by type, in one pass."""
    at = F.col("created_at")
    return metrics.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(at > _ago(as_of, "24 HOURS")).alias("last_24_hours"),
        F.count_if(at > _ago(as_of, "7 DAYS")).alias("last_7_days"),
        F.count_if(at > _ago(as_of, "30 DAYS")).alias("last_30_days"),
        F.count_if(F.col("analysis_type") == "INDIVIDUAL_REVIEW").alias("individual_reviews"),
        F.count_if(F.col("analysis_type") == "PRODUCT_LINK").alias("link_analyses"),
    )


def visit_metrics(visits: DataFrame, as_of: Column, approximate: bool = False) -> DataFrame:
    """Visits and distinct addresses over the usual periods (start included).

    Exact distinct counts come from one row per address: addresses are grouped first, with their sums and their last
    visit, so no task has to hold a set of addresses. ``approximate`` uses sketches in a single pass.
    """
    at = F.col("created_at")
    day, week, month = (_ago(as_of, i) for i in ("24 HOURS", "7 DAYS", "30 DAYS"))
    sums = {
        "total_visits": F.count(F.lit(1)),
        "visits_last_24_hours": F.count_if(at >= day),
        "visits_last_7_days": F.count_if(at >= week),
        "visits_last_30_days": F.count_if(at >= month),
        "authenticated_visits": F.count_if("authenticated"),
        "anonymous_visits": F.count_if(~F.col("authenticated")),
    }
    if approximate:
        return visits.agg(
            *[c.alias(n) for n, c in sums.items()],
            F.approx_count_distinct(F.when(at >= day, F.col("ip_address"))).alias("unique_last_24_hours"),
            F.approx_count_distinct(F.when(at >= week, F.col("ip_address"))).alias("unique_last_7_days"),
        )
    by_ip = visits.groupBy("ip_address").agg(*[c.alias(n) for n, c in sums.items()], F.max(at).alias("last_visit"))
    seen = lambda start: F.count_if(F.col("ip_address").isNotNull() & (F.col("last_visit") >= start))
    return by_ip.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums],
        seen(day).alias("unique_last_24_hours"),
        seen(week).alias("unique_last_7_days"),
    )


def user_counts(users: DataFrame) -> DataFrame:
    return users.agg(
        F.count(F.lit(1)).alias("users"),
        F.count_if(F.col("role") == "ADMIN").alias("admins"),
        F.count_if("enabled").alias("enabled"),
    )


def active_tokens(tokens: DataFrame, as_of: Column) -> DataFrame:
    """Tokens per user that are neither revoked nor expired."""
    live = ~F.col("revoked") & (F.col("expires_at") > as_of)
    return tokens.groupBy("user_id").agg(F.count_if(live).alias("active_tokens"))


def message_counts(messages: DataFrame, as_of: Column) -> DataFrame:
    return messages.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("user_id").isNotNull()).alias("from_users"),
        F.count_if(F.col("user_id").isNull()).alias("anonymous"),
        F.count_if(F.col("created_at") >= _ago(as_of, "7 DAYS")).alias("this_week"),
    )


def users_with_activity(users: DataFrame, reviews: DataFrame, links: DataFrame) -> DataFrame:
    """Users with the number of their analyses.

    Each fact table is counted per user before it is joined, so rows never multiply and a very busy user is one row.
    """
    counted = lambda df, name: df.groupBy("user_id").agg(F.count(F.lit(1)).alias(name))
    return (
        users.join(counted(reviews, "reviews"), "user_id", "left")
        .join(counted(links, "links"), "user_id", "left")
        .withColumn("total_analyses", F.coalesce("reviews", F.lit(0)) + F.coalesce("links", F.lit(0)))
        .drop("reviews", "links")
    )


def with_user(facts: DataFrame, users: DataFrame, columns: list[str]) -> DataFrame:
    """Facts with columns of their user; facts of unknown users drop out. The planner sizes up the user side."""
    return facts.join(users.select("user_id", *columns), "user_id")


def page_size(size: int) -> int:
    """The reference size of a page: sizes outside 1..100 are pulled in."""
    return min(max(size, 1), 100)


def paginate(df: DataFrame, page: int, size: int, order: list[Column]) -> DataFrame:
    """One page, counted from 0, of a totally ordered listing; for pages far back see :class:`PageIndex`."""
    size = page_size(size)
    return df.orderBy(*order).offset(page * size).limit(size)


#: Parts of a stored listing, where the session's shuffles have fewer.
MOST_PARTS = 200


class PageIndex:
    """A stored listing in order, of which any page is read alone.

    The rows are sorted by range into parts of about ``rows_per_part`` rows, at most ``MOST_PARTS`` or as many as a shuffle
    of the session has: what comes to the driver, one count per part, does not grow with the listing. Rows of a part are stored in
    order with their place in it, so a page reads the rows of its places from the one or two parts that it is in, and
    skips what else is stored there by the places that a stored block of rows has. No task ever holds the rows before it.
    """

    def __init__(self, df: DataFrame, order: list[Column], path: str, rows_per_part: int = 1_000_000):
        self.spark, self.order, self.path, self.columns = df.sparkSession, order, path, df.columns
        total = df.count()
        parts = min(max(1, -(-total // rows_per_part)), max(MOST_PARTS, spread_over(df)))
        ranges = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        # The lower 33 bits of the id count the rows of a task.
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        ranges = ranges.withColumns({"_part": F.spark_partition_id(), "_place": place})
        ranges.write.option("parquet.block.size", ROW_GROUP).partitionBy("_part").parquet(path)
        self.schema = df.schema
        #: (part, rows) in order.
        counts = self._rows().groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
        self.parts = [(r["_part"], r["n"]) for r in counts]

    def _rows(self) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField("_place", LongType()), StructField("_part", IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)

    def page(self, page: int, size: int) -> DataFrame:
        """The rows of one page, counted from 0, in order."""
        size = page_size(size)
        first, before, wanted = page * size, 0, F.lit(False)
        for part, n in self.parts:
            if before + n > first and before < first + size:
                wanted = wanted | ((F.col("_part") == part) & F.col("_place").between(first - before, first + size - before - 1))
            before += n
        return self._rows().filter(wanted).orderBy("_part", "_place").select(*self.columns)


def page_info(df: DataFrame, page: int, size: int) -> DataFrame:
    """One row: ``page, size, total_elements, total_pages, last``."""
    size = page_size(size)
    pages = F.ceil(F.col("total_elements") / size).cast("int")
    return df.agg(F.count(F.lit(1)).alias("total_elements")).select(
        F.lit(page).alias("page"),
        F.lit(size).alias("size"),
        "total_elements",
        pages.alias("total_pages"),
        (F.lit(page) >= pages - 1).alias("last"),
    )


def newest_first(df: DataFrame, id_column: str = "id") -> DataFrame:
    return df.orderBy(F.desc("created_at"), F.asc(id_column))


def history(reviews: DataFrame, links: DataFrame, kind: str | None = None) -> DataFrame:
    """Both kinds of analyses as one table. ``kind`` is ``REVIEW``, ``LINK`` or nothing; columns of the other are null.

    Encrypted columns are passed on as they are: decrypt the page that is shown, after :func:`paginate`.
    """
    kind = (kind or "").upper()
    tagged_reviews = reviews.withColumns(
        {
            "analysis_type": F.lit("INDIVIDUAL_REVIEW"),
            "authenticity_label": authenticity_label(F.col("authenticity_score")),
        }
    )
    tagged_links = links.withColumn("analysis_type", F.lit("PRODUCT_LINK"))
    both = tagged_reviews.unionByName(tagged_links, allowMissingColumns=True)
    wanted = {"": None, "REVIEW": "INDIVIDUAL_REVIEW", "LINK": "PRODUCT_LINK"}
    if kind not in wanted:
        return both.limit(0)
    return both if wanted[kind] is None else both.filter(F.col("analysis_type") == wanted[kind])


def user_history(
    reviews: DataFrame,
    links: DataFrame,
    user_id,
    page: int = 0,
    size: int = 20,
    kind: str | None = None,
    secret: str | None = None,
    encrypted: tuple[str, ...] = ("review_text",),
) -> DataFrame:
    """One page of a user's history, newest first, ties to the smaller kind and id.

    The user's rows are chosen before the two kinds are put together. With ``secret``, the ``encrypted`` columns are
    decrypted, and only those of the page that is shown.
    """
    own = lambda df: df.filter(F.col("user_id") == user_id)
    both = history(own(reviews), own(links), kind)
    shown = paginate(both, page, size, [F.desc("created_at"), F.asc("analysis_type"), F.asc("id")])
    if secret is None:
        return shown
    return shown.withColumns({c: decrypt(F.col(c), secret) for c in encrypted if c in shown.columns})
