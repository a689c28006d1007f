"""Reviews in the review cards of marketplace pages, and the choice between several readings of a page."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.pages import is_boilerplate
from ...functions.text import clean_text, find_date_text, parse_rating
from ...functions.urls import site_of
from ...session import ROW_GROUP, small_batches, written
from ..reviews import dedupe_reviews, drop_contained
from . import embedded, jsonld, markup

# Selectors per marketplace. The first rule of a site with cards on the page is used. ``cards`` lists
# alternatives in the order tried; a blank-separated selector is a path of ancestors. ``loose`` cards are found by their
# look alone, so page furniture and cards inside cards are taken out of them.
RULES = {
    "amazon": [
        {
            "cards": [
                ['div[data-hook="review"]', 'div[id^="customer_review-"]', 'div[data-hook="mob-review"]'],
            ],
            "text": [
                'span[data-hook="review-body"]',
                '[data-hook="review-body"] span',
                '[data-hook="review-body"]',
                "div.review-text-content span",
                "div.review-text span",
            ],
            "rating": [
                '[data-hook="review-star-rating"] .a-icon-alt',
                '[data-hook="cmps-review-star-rating"] .a-icon-alt',
                '[data-hook="review-star-rating"]',
                '[data-hook="cmps-review-star-rating"]',
                'i[data-hook="review-star-rating"] span',
                "span.a-icon-alt",
            ],
            "date": ['span[data-hook="review-date"]'],
        },
    ],
    "flipkart": [
        {
            "cards": [
                ['div[style*="padding-left: 16px"][style*="padding-top: 16px"][style*="padding-bottom: 16px"]'],
            ],
            "text": ['div[style*="padding-top: 8px"][style*="padding-bottom: 16px"] span'],
            "rating": ["div div", "div span"],
            "date": ['[class*="date"]', "p", "span"],
            "loose": True,
        },
        {
            "cards": [
                ["div.col._2wzgFH"], ["div._27M-vq"], ["div._16PBlm"], ["div.EKFha-"], ["div.cPHDOP"], ["div.RcXBOT"],
                ['div[class*="review-card"]'],
            ],
            "text": [
                "div.t-ZTKy div", "div.ZmyHeo div", "div._11pzQk", "div._6K-7Co", "div.t-ZTKy", "div.ZmyHeo",
                'div[class*="review-text"]',
            ],
            "rating": [
                "div._3LWZlK", "div.XQDdHH", "span._3LWZlK", "div._3Ay6sb", "div.Ga3i8K", 'div[class*="hGSR59"]',
            ],
            "date": ["p", "span", "div"],
        },
    ],
    "myntra": [
        {
            "cards": [
                ['div[class*="detailed-reviews-userReview"]'], ['div[class*="userReview"]'],
                ['div[class*="user-review"]'], ['div[class*="reviewCard"]'], ['div[class*="review-card"]'],
                ['div[class*="ReviewCard"]'], ['div[class*="userReviewCard"]'], ['div[class*="review-container"]'],
                ['div[class*="detailed-reviews"] div div'],
            ],
            "text": [
                '*[class*="reviewText"]', '*[class*="review-text"]', '*[class*="reviewBody"]',
                '*[class*="review-body"]', '*[class*="ReviewText"]', '*[class*="reviewContent"]',
                '*[class*="review-content"]', '*[class*="user-review-reviewTextWrapper"]', "p",
            ],
            "rating": [
                '*[class*="userRating"]', '*[class*="user-rating"]', '*[class*="rating"]', '*[class*="Rating"]',
                '*[class*="star"]', '*[class*="Star"]',
            ],
            "date": [
                '*[class*="reviewDate"]', '*[class*="review-date"]', '*[class*="posted"]', '*[class*="Posted"]',
                '*[class*="date"]', '*[class*="Date"]', "time",
            ],
        },
    ],
    "ajio": [
        {
            "cards": [
                [
                    'div[class*="review"]', 'li[class*="review"]', 'div[data-testid*="review"]',
                    'div[class*="Review"]',
                ],
            ],
            "text": [
                '*[class*="reviewText"]', '*[class*="review-text"]', '*[class*="reviewBody"]',
                '*[class*="review-body"]', '*[class*="ReviewText"]', '*[class*="reviewContent"]',
                '*[class*="review-content"]', '*[class*="details-text"]', '*[data-testid*="review-text"]', "p",
            ],
            "rating": [
                '*[class*="rating"]', '*[class*="Rating"]', '*[class*="star"]', '*[class*="Star"]',
                '*[data-testid*="rating"]',
            ],
            "date": [],
        },
    ],
    "nykaa": [
        {
            "cards": [
                ['div[class*="review-card"]'], ['div[class*="reviewCard"]'], ['div[class*="userReview"]'],
                ['div[class*="review-item"]'], ['div[class*="ReviewItem"]'], ['li[class*="review"]'],
            ],
            "text": [
                '*[class*="reviewText"]', '*[class*="review-text"]', '*[class*="reviewBody"]',
                '*[class*="review-content"]', '*[class*="ReviewText"]', "p",
            ],
            "rating": ['*[class*="rating"]', '*[class*="Rating"]', '*[class*="star"]', '*[class*="Star"]'],
            "date": [],
        },
    ],
}
REVIEW_ID = r"(R[A-Z0-9]{10,14})"

# Order of the readings per marketplace; the first with a review is taken.
READINGS = {
    "amazon": ("cards", "embedded", "jsonld"),
    "flipkart": ("cards", "embedded", "jsonld"),
    "myntra": ("embedded", "jsonld", "cards"),
    "ajio": ("embedded", "jsonld", "cards"),
    "nykaa": ("embedded", "jsonld", "cards"),
}


def register_extractor(site: str, rules: list[dict], readings: tuple[str, ...] = ("cards", "embedded", "jsonld")) -> None:
    """Add or replace the card rules of a marketplace. Hosts are assigned by ``functions.urls`` or your own column."""
    RULES[site], READINGS[site] = rules, readings


def _is_rating(text: str) -> bool:
    number = re.search(r"[0-9]+(?:\.[0-9]+)?", text)
    return number is not None and float(number.group()) <= 5.0


def _cards(html: Column, site: Column) -> Column:
    rules = dict(RULES)

    @F.pandas_udf("array<struct<text:string,rating:string,id:string,date:string,loose:boolean>>")
    def read(pages: pd.Series, sites: pd.Series) -> pd.Series:
        def page(text: str, name: str) -> list[dict]:
            root = markup.tree(text)
            for rule in rules.get(name, ()):
                for group in rule["cards"]:
                    found = {id(n): n for selector in group for n in markup.select(root, selector)}
                    if not found:
                        continue
                    rows = [
                        {
                            "text": markup.first_text(card, rule["text"]),
                            "rating": markup.first_text(card, rule["rating"]),
                            "id": card.attrs.get("id", ""),
                            "date": markup.first_text(card, rule["date"]),
                            "loose": rule.get("loose", False),
                        }
                        for card in found.values()
                    ]
                    rows = [r for r in rows if r["text"]]
                    if any(_is_rating(r["rating"]) for r in rows):
                        return rows
                    break
            return []

        return pd.Series([page(p or "", s or "") for p, s in zip(pages, sites)], dtype=object)

    return read(html, site)


def card_reviews(pages: DataFrame, key: str = "page_id", html: str = "html", site: str = "site") -> DataFrame:
    """Reviews in the cards of a page: ``(key, pos, text, rating, review_id, date)``.

    The first rule whose cards hold a rated review is used. Cards found by their look alone may be page furniture or
    repeat a review inside a longer one; both are dropped within the page. Cards found by their names are all kept.
    """
    small_batches(pages.sparkSession)
    found = pages.select(key, site, _cards(F.col(html), F.col(site)).alias("found"))
    nested = drop_contained(F.filter("found", lambda r: ~is_boilerplate(r.getField("text"))))
    return (
        found.select(key, F.posexplode(F.when(F.get("found", F.lit(0)).getField("loose"), nested).otherwise(F.col("found"))).alias("pos", "r"))
        .select(
            key,
            "pos",
            clean_text(F.col("r.text")).alias("text"),
            parse_rating(F.col("r.rating")).alias("rating"),
            F.regexp_extract("r.id", REVIEW_ID, 1).alias("review_id"),
            F.coalesce(find_date_text(F.col("r.date")), F.lit("")).alias("date"),
        )
        .filter((F.col("text") != "") & F.col("rating").isNotNull())
    )


# Where shop pages without structured data show their product facts, in the order tried.
META_SELECTORS = {
    "name": ["#productTitle", 'a[data-hook="product-link"]'],
    "brand": ["#bylineInfo"],
    "price": [
        "span.a-price .a-offscreen", "#priceblock_ourprice", "#priceblock_dealprice",
        'span[data-a-color="price"] .a-offscreen', ".a-price .a-offscreen",
    ],
    "rating": ['#acrPopover [class*="a-icon-alt"]', '[data-hook="rating-out-of-text"]'],
}
META_IMAGES = ("#landingImage", "#imgBlkFront", "#main-image")
# What a shop page puts around a brand.
BEFORE_BRAND = r"(?i)^(Visit the|Brand:\s*)"
AFTER_BRAND = r"\s*Store$"
META_TYPE = T.StructType([T.StructField(n, T.StringType()) for n in (*META_SELECTORS, "image")])


@F.pandas_udf(META_TYPE)
def _shown_meta(pages: pd.Series) -> pd.DataFrame:
    def read(html: str) -> dict:
        root = markup.tree(html or "")
        shown = {name: markup.first_text(root, selectors) for name, selectors in META_SELECTORS.items()}
        images = [n.attrs for s in META_IMAGES for n in markup.select(root, s)]
        return {**shown, "image": images[0].get("data-old-hires") or images[0].get("src", "") if images else ""}

    return pd.DataFrame([read(p) for p in pages], columns=META_TYPE.names)


def shown_meta(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Product facts that a shop page shows in its known places; pages without a product name have no row."""
    small_batches(pages.sparkSession)
    brand = F.regexp_replace(F.regexp_replace("m.brand", BEFORE_BRAND, ""), AFTER_BRAND, "")
    return (
        pages.select(key, _shown_meta(F.col(html)).alias("m"))
        .filter(F.col("m.name") != "")
        .select(
            key,
            F.col("m.name").alias("name"),
            F.trim(brand).alias("brand"),
            F.col("m.price").alias("price"),
            F.col("m.image").alias("image_url"),
            parse_rating(F.col("m.rating")).alias("overall_rating"),
        )
    )


def extract_reviews(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Reviews of stored marketplace pages by the best reading of each page, without repeats within a page.

    Result: ``(key, site, reading, pos, text, rating, review_id, date)``. Pages of other hosts have no rows.
    """
    sited = pages.select(key, html, site_of(F.col(url)).alias("site")).filter(F.col("site").isNotNull())
    # Every reading goes through the pages: they are made once.
    sited = written(sited, "pages", ROW_GROUP)
    plain = lambda df, name: df.select(
        key,
        F.lit(name).alias("reading"),
        F.row_number().over(Window.partitionBy(key).orderBy("pos")).alias("pos"),
        "text",
        "rating",
        (F.col("review_id") if "review_id" in df.columns else F.lit("")).alias("review_id"),
        (F.col("date") if "date" in df.columns else F.lit("")).alias("date"),
    )
    readings = (
        plain(card_reviews(sited, key, html), "cards")
        .union(plain(embedded.embedded_reviews(sited, key, html), "embedded"))
        .union(plain(jsonld.jsonld_reviews(sited, key, html), "jsonld"))
    )
    order = F.lit(None).cast("int")
    for site, names in READINGS.items():
        for i, name in enumerate(names):
            order = F.when((F.col("site") == site) & (F.col("reading") == name), i).otherwise(order)
    # A window per page: its reviews came out of one row, so no page can be a large group.
    best = F.min("_order").over(Window.partitionBy(key))
    chosen = (
        readings.join(sited.select(key, "site"), key)
        .withColumn("_order", order)
        .withColumn("_best", best)
        .filter(F.col("_order") == F.col("_best"))
        .drop("_order", "_best")
    )
    return dedupe_reviews(chosen, ["pos"], [key])
