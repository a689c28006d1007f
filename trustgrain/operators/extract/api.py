"""Reviews in stored bodies of marketplace review services, with built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.text import clean_text, epoch_or_iso_date, parse_rating, strip
from ...session import written
from ..reviews import identity_key
from . import variants as V
from .embedded import deep_reviews, objects


@dataclass(frozen=True)
class ApiRule:
    """Keys of a service's answer, each list in the order tried."""

    lists: tuple[str, ...]
    wrappers: tuple[str, ...]
    text: tuple[str, ...]
    rating: tuple[str, ...]
    ids: tuple[str, ...]
    dates: tuple[str, ...]
    min_text: int
    title: bool
    nested_rating: bool
    page_size: int
    totals: tuple[str, ...]
    more_lists: tuple[tuple[str, ...], ...] = ()


# Key names per service. A service without lists nests its reviews anywhere.
RULES = {
    "flipkart": ApiRule(
        lists=(),
        wrappers=(),
        text=(),
        rating=(),
        ids=(),
        dates=(),
        min_text=1,
        title=False,
        nested_rating=False,
        page_size=10,
        totals=("totalCount", "totalPages", "total"),
    ),
    "ajio": ApiRule(
        lists=("productReviews", "reviews", "reviewData", "data", "results", "items"),
        wrappers=("reviewData", "response", "result", "data", "body"),
        text=("reviewText", "review", "description", "text", "body", "content", "comment", "reviewBody"),
        rating=("rating", "overallRating", "stars", "ratingValue", "score"),
        ids=("id", "reviewId", "review_id", "_id"),
        dates=("createdDate", "createdAt", "createdOn", "date", "posted", "postedDate"),
        min_text=2,
        title=True,
        nested_rating=False,
        page_size=20,
        totals=("totalReviews", "totalCount", "total", "reviewCount"),
    ),
    "myntra": ApiRule(
        lists=("reviews", "data", "results", "items", "userReviews", "ratings"),
        wrappers=("response", "result", "body", "payload"),
        text=(
            "text", "reviewText", "description", "body", "content", "review", "comment", "reviewBody", "reviewContent",
            "value",
        ),
        rating=("rating", "userRating", "overallRating", "stars", "ratingValue", "starRating", "score"),
        ids=("id", "reviewId", "review_id", "uid"),
        dates=("createdAt", "date", "reviewDate", "created", "timestamp", "postedOn", "createdOn"),
        min_text=10,
        title=False,
        nested_rating=True,
        page_size=12,
        totals=("reviewsCount", "totalCount"),
    ),
    "myntra_page": ApiRule(
        lists=("reviews",),
        wrappers=("reviewsData",),
        text=("review", "reviewText", "text", "description", "content"),
        rating=("userRating", "rating", "overallRating", "stars"),
        ids=("id", "reviewId", "review_id"),
        dates=("timestamp", "updatedAt", "createdAt", "date", "createdOn"),
        min_text=2,
        title=False,
        nested_rating=False,
        page_size=12,
        totals=("reviewsCount", "totalCount"),
        more_lists=(("pdpData", "ratings", "reviewInfo", "topReviews"),),
    ),
    "nykaa": ApiRule(
        lists=("reviewData", "reviews", "data", "results", "items", "userReviews", "reviewList"),
        wrappers=("response", "result", "data", "payload", "body"),
        text=("description", "text", "reviewText", "body", "content", "review", "comment", "reviewBody", "reviewContent"),
        rating=("rating", "userRating", "overallRating", "stars", "ratingValue", "starRating", "score"),
        ids=("id", "reviewId", "review_id", "_id"),
        dates=("createdAt", "createdOn", "date", "reviewDate", "created_at"),
        min_text=10,
        title=True,
        nested_rating=True,
        page_size=20,
        totals=("reviewCount", "totalCount", "total", "totalReviews"),
    ),
}


# Where answers keep totals, product facts and page numbers.
TOTAL_WRAPPERS = ("reviewData", "response", "data", "result", "payload")
PAGE_TOTALS = (("pdpData", "ratings", "reviewInfo", "reviewsCount"), ("pdpData", "ratings", "totalCount"))
META_WRAPPERS = ("response", "data", "result", "payload")
META_KEYS = {
    "name": (("productName",), ("name",), ("title",)),
    "brand": (("brandName",), ("brand",)),
    "price": (("price",), ("mrp",)),
    "image_url": (("imageUrl",), ("image",)),
    "rating": (("averageRating",), ("overallRating",)),
}
STATE_KEYS = {
    "name": (("pdpData", "name"), ("pdpData", "productName")),
    "brand": (("pdpData", "brand", "name"), ("pdpData", "brand", "brandName"), ("pdpData", "brand"), ("pdpData", "brandName")),
    "amount": (
        ("pdpData", "mrp", "mrp"), ("pdpData", "mrp", "value"), ("pdpData", "mrp"), ("pdpData", "price", "mrp"),
        ("pdpData", "price", "value"),
    ),
    "other_amount": (("pdpData", "discountedPrice"), ("pdpData", "price")),
    "currency": (("pdpData", "mrp", "currency"), ("pdpData", "price", "currency")),
    "image_url": (
        ("pdpData", "searchImage"), ("pdpData", "image"), ("pdpData", "defaultImage"), ("pdpData", "thumbnailImage"),
        ("pdpData", "landingPageImage"), ("pdpData", "productImage"),
    ),
    "rating": (("pdpData", "ratings", "averageRating"),),
}
STATE_ALBUM = "$.pdpData.media.albums[0].image"
PAGING_TOTALS = ("totalCount", "totalPages", "total")
PAGING_COUNTS = ("pageCount", "totalPages")
PAGING_SIZES = ("pageSize", "count")
PAGING_SIZE = 10


def review_list(body: Column, rule: ApiRule) -> Column:
    """The body itself if it is a list, else the first list under a known key, else the first one level deeper; null
    where there is none. Lists that a service keeps besides come after it."""
    more = [F.coalesce(V.get(body, *at, type=V.LIST), F.array().cast(V.LIST)) for at in rule.more_lists]
    if not rule.lists:
        return F.lit(None).cast(V.LIST)
    paths = [(), *[(k,) for k in rule.lists], *[(w, k) for w in rule.wrappers for k in rule.lists]]
    paths += [(w,) for w in rule.wrappers]
    lists = F.array(*[V.get(body, *at, type=V.LIST) for at in paths])
    first = F.get(F.filter(lists, lambda found: F.size(found) > 0), 0)
    if not more:
        return first
    every = F.concat(F.coalesce(first, F.array().cast(V.LIST)), *more)
    return F.get(F.filter(F.array(every), lambda found: F.size(found) > 0), 0)


def _first_text(item: Column, rule: ApiRule) -> Column:
    texts = [V.string(item, k) for k in rule.text]
    if rule.title:
        title = strip(F.coalesce(V.string(item, "title"), F.lit("")))
        filled = F.filter(F.array(*[V.string(item, k) for k in rule.text[:3]]), lambda t: t != "")
        body = strip(F.coalesce(F.get(filled, 0), F.lit("")))
        texts.append(strip(F.concat(title, F.lit(" "), body)))
    long_enough = F.filter(F.array(*texts), lambda t: F.length(strip(t)) >= rule.min_text)
    return clean_text(F.get(long_enough, 0))


def _first_rating(item: Column, rule: ApiRule) -> Column:
    rated = F.transform(F.array(*[V.scalar_text(item, k) for k in rule.rating]), parse_rating)
    flat = F.get(F.filter(rated, lambda r: r.isNotNull()), 0)
    if not rule.nested_rating:
        return flat
    nested = V.scalar_text(item, "reviewRating", "ratingValue")
    return F.when(nested.isNotNull(), parse_rating(nested)).otherwise(flat)


def _first_present(item: Column, keys: tuple[str, ...]) -> Column:
    texts = F.array(*[V.scalar_text(item, k) for k in keys])
    return F.coalesce(F.get(F.filter(texts, lambda t: ~t.isin("", "0")), 0), F.lit(""))


def api_reviews(bodies: DataFrame, service: str, key: str = "body_id", body: str = "body") -> DataFrame:
    """Reviews of one service's stored answers, without repeats in one answer: ``(key, pos, text, rating, review_id, date)``.

    Answers without a list at a known place are searched for review-like objects at any depth, as are those of services
    that have no such place. Answers that are no JSON have no reviews here; they are pages, to be read as such.
    """
    rule = RULES[service]
    if not rule.lists:
        deep = written(_deep(bodies.select(key, F.col(body).alias("body")), key), "reviews")
        return first_of_each(_usable(deep), key)
    # One row per listed item, or one with the body itself where it has no list. No filter stands on what is read out of a
    # body: it would be tested ahead of the read, with the body parsed again for every place tried.
    v, item = F.col("v"), F.col("item")
    none = F.lit(None).cast("string")
    listed = F.transform(review_list(v, rule), lambda x, i: F.struct(i.alias("pos"), x.alias("item"), none.alias("rest")))
    whole = F.struct(F.lit(None).cast("int").alias("pos"), V.parse(none).alias("item"), F.when(v.isNotNull(), F.col("body")).alias("rest"))
    read = written(
        bodies.select(key, F.col(body).alias("body"), V.parse(F.col(body)).alias("v"))
        .select(key, F.inline_outer(F.coalesce(listed, F.array(whole))))
        .select(
            key,
            "pos",
            _first_text(item, rule).alias("text"),
            _first_rating(item, rule).alias("rating"),
            _first_present(item, rule.ids).alias("review_id"),
            _first_present(item, rule.dates).alias("date"),
            "rest",
        ),
        "reviews",
    )
    found = read.filter(F.col("pos").isNotNull()).withColumn("date", epoch_or_iso_date(F.col("date"))).drop("rest")
    deep = written(_deep(read.filter(F.col("rest").isNotNull()).select(key, F.col("rest").alias("body")), key), "reviews")
    return first_of_each(_usable(found.union(deep)), key)


def _deep(bodies: DataFrame, key: str) -> DataFrame:
    found = deep_reviews(bodies, [key], "body", min_text=1)
    return found.select(key, "pos", "text", "rating", F.lit("").alias("review_id"), F.lit("").alias("date"))


def _usable(found: DataFrame) -> DataFrame:
    return found.filter((F.coalesce("text", F.lit("")) != "") & F.col("rating").isNotNull())


def first_of_each(found: DataFrame, key: str) -> DataFrame:
    """Reviews of a body or page without those that repeat an earlier one: the first of each identity by ``pos``."""
    first = found.groupBy(key, identity_key().alias("_key")).agg(F.min("pos").alias("pos")).select(key, "pos")
    return found.join(first, [key, "pos"], "left_semi").select(*found.columns)


def declared_total(body: Column, service: str) -> Column:
    """Review count an answer declares, at its top or one level down; 0 if it declares none."""
    rule = RULES[service]
    tries = [V.get(body, k, type="bigint") for k in rule.totals]
    tries += [V.get(body, w, k, type="bigint") for w in TOTAL_WRAPPERS for k in rule.totals]
    if service.startswith("myntra"):
        tries += [V.get(body, *at, type="bigint") for at in PAGE_TOTALS]
    return F.coalesce(*[F.when(t > 0, t) for t in tries], F.lit(0).cast("long"))


def shown_total(html: Column) -> Column:
    """Review count that a listing page shows: in its filter line, else in its header; 0 if it shows none."""

    def shown(hook: str) -> Column:
        inner = F.regexp_extract(html, rf"""(?is)data-hook\s*=\s*["']{hook}["'][^>]*>(.*?)</(?:div|span|h\d|p)>""", 1)
        return F.regexp_replace(inner, r"<[^>]*>", " ")

    counted = F.regexp_extract(shown("cr-filter-info-review-rating-count"), r"(?i)([\d,]+)\s+(?:global\s+)?(?:ratings?|reviews?)", 1)
    header = F.regexp_extract(shown("total-review-count"), r"([\d,]+)", 1)
    found = F.array(*[F.nullif(F.replace(t, F.lit(",")), F.lit("")).cast("long") for t in (counted, header)])
    return F.coalesce(F.get(F.filter(found, lambda n: n.isNotNull()), 0), F.lit(0).cast("long"))


def more_pages(bodies: DataFrame, key: str = "body_id", body: str = "body", page: str = "page") -> DataFrame:
    """``(key, more)``: whether some object of a service's answer, at any depth, says that pages follow ``page``.

    It does with a number of pages above ``page``, or with a total above what pages of its size hold up to ``page``.
    """

    def first(keys: tuple[str, ...]) -> Column:
        """The first of the whole numbers that is not zero."""
        numbers = F.array(*[F.when(V.kind(V.get(F.col("v"), k, type="variant")) == "BIGINT", V.get(F.col("v"), k, type="bigint")) for k in keys])
        return F.get(F.filter(numbers, lambda x: x != 0), 0)

    size = F.coalesce(first(PAGING_SIZES), F.lit(PAGING_SIZE))
    beyond = F.coalesce(F.col(f"k.{page}") * size < first(PAGING_TOTALS), F.lit(False))
    follows = F.coalesce(first(PAGING_COUNTS) > F.col(f"k.{page}"), F.lit(False)) | beyond
    found = objects(bodies, [key, page], follows, body).filter("found").select(F.col(f"k.{key}").alias(key), F.lit(True).alias("more")).distinct()
    return bodies.select(key).join(found, key, "left").withColumn("more", F.coalesce("more", F.lit(False)))


def has_next_page(total: Column, page: Column, size: Column) -> Column:
    return (total > 0) & (page * size < total)


def page_frontier(totals: DataFrame, fetched: DataFrame, page_size: int, by: list[str] | None = None) -> DataFrame:
    """Pages still to be read: all pages of the declared total without those fetched: ``(*by, page_no)``."""
    keys = by or ["product_id"]
    last = F.ceil(F.col("total") / page_size).cast("int")
    wanted = totals.filter(F.col("total") > 0).select(*keys, F.explode(F.sequence(F.lit(1), last)).alias("page_no"))
    return wanted.join(fetched.select(*keys, "page_no"), [*keys, "page_no"], "left_anti")


def _present(v: Column, *keys: tuple[str, ...]) -> Column:
    """First value under one of the paths that is neither missing, empty nor zero."""
    texts = F.array(*[V.scalar_text(v, *k) for k in keys])
    return F.get(F.filter(texts, lambda t: ~t.isin("", "0")), 0)


def service_meta(bodies: DataFrame, key: str = "body_id", body: str = "body") -> DataFrame:
    """Product facts next to the reviews of a service's answer, at its top or one level down.

    The first level that names a product is used; answers that name none have no row.
    """
    levels = F.array(F.col("v"), *[V.get(F.col("v"), w, type="variant") for w in META_WRAPPERS])
    naming = F.get(F.filter(levels, lambda level: _present(level, *META_KEYS["name"]).isNotNull()), 0)
    o = F.col("o")
    rating = _present(o, *META_KEYS["rating"]).try_cast("double")
    return (
        bodies.select(key, V.parse(F.col(body)).alias("v"))
        .select(key, naming.alias("o"))
        .select(
            key,
            _present(o, *META_KEYS["name"]).alias("name"),
            F.coalesce(_present(o, *META_KEYS["brand"]), F.lit("")).alias("brand"),
            F.coalesce(F.concat(F.lit("INR "), _present(o, *META_KEYS["price"])), F.lit("")).alias("price"),
            F.coalesce(_present(o, *META_KEYS["image_url"]), F.lit("")).alias("image_url"),
            rating.alias("rated"),
        )
        .select(key, "name", "brand", "price", "image_url", F.when(F.col("rated").between(0.0, 5.0), F.col("rated")).alias("overall_rating"))
        .filter(F.col("name").isNotNull())
    )


def page_state_meta(documents: DataFrame, keys: list[str], doc: str = "doc") -> DataFrame:
    """Product facts in a page's state under ``pdpData``; input are documents of ``embedded.state_documents``."""
    v = F.col("v")
    read = lambda name: _present(v, *STATE_KEYS[name])
    currency = F.coalesce(read("currency"), F.lit("INR"))
    album = F.try_variant_get(v, STATE_ALBUM, "string")
    return (
        documents.select(*keys, V.parse(F.col(doc)).alias("v"))
        .select(
            *keys,
            read("name").alias("name"),
            F.coalesce(read("brand"), F.lit("")).alias("brand"),
            F.coalesce(F.concat(currency, F.lit(" "), F.coalesce(read("amount"), read("other_amount"))), F.lit("")).alias("price"),
            F.coalesce(read("image_url"), F.nullif(album, F.lit("")), F.lit("")).alias("image_url"),
            parse_rating(read("rating")).alias("overall_rating"),
        )
        .filter(F.col("name").isNotNull())
    )
