"""Reviews and product facts in JSON-LD blocks, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.text import clean_text, parse_rating, strip
from . import variants as V

SCRIPT = r"""(?is)<script[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script>"""
_REVIEWS = "array<struct<text:string,rating:double,review_id:string,date:string>>"


def blocks(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1))


def _objects(payload: Column) -> Column:
    """The block itself with the members of its ``@graph``, or the members of a list."""
    listed = F.try_variant_get(payload, "$", V.LIST)
    graph = V.get(payload, "@graph", type=V.LIST)
    own = F.array(payload)
    return F.coalesce(listed, F.when(graph.isNotNull(), F.concat(own, graph)).otherwise(own))


def _review(r: Column) -> Column:
    filled = lambda c: F.nullif(c, F.lit(""))
    by_language = F.get(
        F.filter(
            F.map_values(F.coalesce(V.get(r, "reviewBody", type="map<string,variant>"), F.create_map().cast("map<string,variant>"))),
            lambda v: V.kind(v) == "STRING",
        ),
        0,
    )
    text = F.coalesce(
        filled(V.string(r, "reviewBody")),
        filled(F.try_variant_get(by_language, "$", "string")),
        filled(V.string(r, "description")),
        filled(V.string(r, "text")),
    )
    rating = F.coalesce(V.scalar_text(r, "reviewRating", "ratingValue"), V.scalar_text(r, "reviewRating"))
    return F.struct(
        clean_text(text).alias("text"),
        parse_rating(rating).alias("rating"),
        F.lit("").alias("review_id"),
        F.lit("").alias("date"),
    )


def jsonld_reviews(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per review of a page's JSON-LD: ``(key, pos, text, rating)``; needs text and a rating of 0 to 5.

    Blocks, objects and reviews are unfolded one after the other, so that no expression is computed twice. ``pos``
    counts the reviews of a page in order of appearance.
    """
    found = (
        pages.select(key, F.posexplode(blocks(F.col(html))).alias("block_no", "raw"))
        .select(key, "block_no", V.parse(strip(F.col("raw"))).alias("payload"))
        .filter(F.col("payload").isNotNull())
        .select(key, "block_no", F.posexplode(_objects(F.col("payload"))).alias("object_no", "obj"))
        .select(key, "block_no", "object_no", V.one_or_many(V.get(F.col("obj"), "review", type="variant")).alias("rs"))
        .select(key, "block_no", "object_no", F.posexplode("rs").alias("review_no", "r"))
        .select(key, F.struct("block_no", "object_no", "review_no").alias("pos"), _review(F.col("r")).alias("v"))
    )
    return found.select(key, "pos", "v.text", "v.rating").filter(
        (F.coalesce("text", F.lit("")) != "") & F.col("rating").isNotNull()
    )


def _meta_tag(html: Column, name: str) -> Column:
    """Content of ``<meta property=name content=...>`` with either order of attributes."""
    quoted = name.replace(":", r"\:")
    tag = F.regexp_extract(html, rf"""(?is)(<meta[^>]*property\s*=\s*["']{quoted}["'][^>]*>)""", 1)
    return F.nullif(F.trim(F.regexp_extract(tag, r"""(?is)content\s*=\s*["']([^"']*)["']""", 1)), F.lit(""))


def _product(obj: Column) -> Column:
    text = lambda *k: F.nullif(V.scalar_text(obj, *k), F.lit(""))
    return F.struct(
        text("name").alias("name"),
        F.coalesce(text("brand", "name"), F.nullif(V.string(obj, "brand"), F.lit(""))).alias("brand"),
        F.coalesce(text("offers", "price"), text("offers", "lowPrice")).alias("amount"),
        text("offers", "priceCurrency").alias("currency"),
        F.coalesce(
            F.nullif(F.try_variant_get(F.get(V.get(obj, "image", type=V.LIST), 0), "$", "string"), F.lit("")),
            F.nullif(V.string(obj, "image"), F.lit("")),
        ).alias("image_url"),
        parse_rating(text("aggregateRating", "ratingValue")).alias("overall_rating"),
    )


def product_meta(pages: DataFrame, key: str = "page_id", html: str = "html", default_currency: str = "INR") -> DataFrame:
    """Product facts of a page: first value found in its JSON-LD products, then in OpenGraph tags.

    Pages that name no product have no row.
    """
    parts = ["name", "brand", "amount", "currency", "image_url", "overall_rating"]
    kind_of = lambda o: F.lower(V.get(o, "@type"))
    products = (
        pages.select(key, F.posexplode(blocks(F.col(html))).alias("block_no", "raw"))
        .select(key, "block_no", V.one_or_many(V.parse(strip(F.col("raw")))).alias("objs"))
        .select(key, "block_no", F.posexplode("objs").alias("object_no", "obj"))
        .filter(kind_of(F.col("obj")) == "product")
        .select(key, F.struct("block_no", "object_no").alias("at"), _product(F.col("obj")).alias("p"))
        .select(key, "at", "p.*")
    )
    firsts = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in parts]
    page = F.col(html)
    tags = pages.select(
        key,
        _meta_tag(page, "og:title").alias("og_name"),
        _meta_tag(page, "og:image").alias("og_image"),
        _meta_tag(page, "product:brand").alias("og_brand"),
        _meta_tag(page, "product:price:amount").alias("og_amount"),
        _meta_tag(page, "product:price:currency").alias("og_currency"),
    )
    joined = tags.join(products.groupBy(key).agg(*firsts), key, "left")
    in_data = F.col("amount").isNotNull()
    currency = F.coalesce(F.when(in_data, F.col("currency")).otherwise(F.col("og_currency")), F.lit(default_currency))
    amount = F.coalesce("amount", "og_amount")
    return joined.select(
        key,
        F.coalesce("name", "og_name").alias("name"),
        F.coalesce("brand", "og_brand", F.lit("")).alias("brand"),
        F.coalesce(F.concat(currency, F.lit(" "), amount), F.lit("")).alias("price"),
        F.coalesce("image_url", "og_image", F.lit("")).alias("image_url"),
        "overall_rating",
    ).filter(F.col("name").isNotNull())


def name_from_title(html: Column) -> Column:
    """Product name out of a shop's page title: without ``Buy`` in front and ``Online | shop`` behind."""
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    name = F.trim(F.regexp_replace(F.regexp_replace(title, r"(?i)^Buy\s+", ""), r"(?i)\s+Online\s*\|.*$", ""))
    return F.when(F.length(name) > 5, name)
