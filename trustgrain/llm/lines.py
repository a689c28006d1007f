"""Line deduplication by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import WORD, fresh, same

#: Share of a site's pages above which a line is boilerplate, and the number of pages it must be on at least.
RATIO = 0.05
MIN_PAGES = 5
#: Words from which a line is a passage of its own, for which the number of pages alone decides.
LONG_WORDS = 50


def _line(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\r"))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: _line(x) != "")


def _page(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD))


def boilerplate(
    pages: DataFrame,
    site: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    long_words: int | None = None,
) -> DataFrame:
    """Lines on more than ``ratio`` of the pages of their site and on at least ``min_pages`` of them.

    Returns ``(site, line_key, pages, site_pages)``. Lines are cut at ``\\n`` and compared without surrounding spaces,
    tabs and carriage returns; lines without anything else are no lines. Pages of a site with the same text count as
    one page, so that a page copied a thousand times does not turn into boilerplate. A null site is a site of its own,
    a null text a page without lines. Lines are compared by a 64-bit hash inside their site.

    The text stays where it is read: only hashes are shuffled, and a line or site that holds a large part of all rows
    is counted in partial sums before it meets in one task.

    With ``long_words`` the ratio of a line falls with its words, to nothing at ``long_words``; lines of that many words
    are left to ``passages``.
    """
    base = pages.select(F.col(site).alias("site"), _page(F.col(text)).alias("page"), F.col(text).alias("text"))
    totals = base.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("site_pages"))
    found = _lines(F.col("text"))
    key, least = ["line_key"], F.lit(float(ratio))
    if long_words is None:
        keys = F.array_distinct(F.transform(found, lambda x: F.xxhash64(_line(x))))
        cut = base.select("site", "page", F.explode(keys).alias("line_key"))
    else:
        keys = F.array_distinct(
            F.transform(found, lambda x: F.struct(F.xxhash64(_line(x)).alias("line_key"), _words(x).alias("words")))
        )
        cut = base.select("site", "page", F.inline(keys)).filter(F.col("words") < long_words)
        key, least = ["line_key", "words"], least * (long_words - F.col("words")) / long_words
    counts = (
        cut.distinct().groupBy("site", *key).agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    )
    right = totals.withColumnRenamed("site", "_site")
    return (
        counts.join(right, same(F.col("site"), F.col("_site")))
        .filter(F.col("pages") > least * F.col("site_pages"))
        .select("site", "line_key", "pages", "site_pages")
    )


def passages(pages: DataFrame, text: str = "text", min_pages: int = MIN_PAGES, long_words: int = LONG_WORDS) -> DataFrame:
    """Lines of at least ``long_words`` words on at least ``min_pages`` distinct pages, whatever the site.

    Returns ``(page, keys)`` for each page that holds some: the hash of its text and those of the lines. There is no
    bound on how many lines a corpus repeats, so they are listed by page, where they are fewer than the page's lines.
    """
    found = F.filter(_lines(F.col("text")), lambda x: _words(x) >= long_words)
    keys = F.array_distinct(F.transform(found, lambda x: F.xxhash64(_line(x))))
    cut = written(
        pages.select(_page(F.col(text)).alias("page"), F.col(text).alias("text"))
        .select("page", F.explode(keys).alias("line_key"))
        .distinct(),
        "long-lines",
    )
    often = cut.groupBy("line_key").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages).select("line_key")
    return cut.join(often, "line_key").groupBy("page").agg(F.collect_set("line_key").alias("keys"))


def drop_boilerplate(
    pages: DataFrame,
    site: str = "source",
    text: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    long_words: int | None = None,
) -> DataFrame:
    """``pages`` with the boilerplate lines of each site removed from ``text``, plus ``n_lines`` and ``n_dropped``.

    Every row stays, in the same columns; a page of boilerplate alone keeps an empty text, a null text stays null with
    0 lines. Columns of these two names that ``pages`` may have are replaced. An empty table gives an empty table.

    A site has fewer boilerplate lines than its lines per page divided by ``ratio``, so they fit into one array per
    site. These arrays, one row per site, are written before they are joined with the pages, so the planner knows their
    size: it broadcasts them when they are small, and the texts are not shuffled; beyond that adaptive execution splits
    a site that holds many pages.

    With ``long_words``, lines of that many words go from every site where they are on ``min_pages`` pages of all sites
    together (see ``passages``), and the ratio falls with a line's words. A site then has at most ``long_words`` times as
    many lines in its array.
    """
    own = fresh(pages, "boiler_site")
    drop = fresh(pages, "boiler_keys")
    per_site = written(
        boilerplate(pages, site, text, ratio, min_pages, long_words).groupBy("site").agg(F.collect_set("line_key").alias("keys")),
        "boilerplate",
    ).toDF(own, drop)
    joined = pages.join(per_site, same(F.col(site), F.col(own)), "left")
    lines = F.split(F.col(text), "\n", -1)

    def without(lines: Column, drop: str) -> Column:
        return F.when(
            F.col(drop).isNotNull(),
            F.filter(lines, lambda x: (_line(x) == "") | ~F.array_contains(F.col(drop), F.xxhash64(_line(x)))),
        ).otherwise(lines)

    left = without(lines, drop)
    if long_words is not None:
        page, long = fresh(pages, "boiler_page"), fresh(pages, "boiler_passages")
        per_page = written(passages(pages, text, min_pages, long_words), "passages").toDF(page, long)
        joined = joined.join(per_page, _page(F.col(text)) == F.col(page), "left")
        left = without(left, long)
    kept = fresh(pages, "kept_lines")
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_kept = F.when(F.col(text).isNull(), 0).otherwise(F.size(kept)).cast("long")
    out = joined.withColumn(kept, left).withColumn("n_lines", n).withColumn("n_dropped", n - n_kept)
    names = [*[c for c in pages.columns if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped"]
    return out.withColumn(text, F.array_join(kept, "\n")).select(*names)
