"""Hosts, marketplaces, product ids and listing URLs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"

# Marketplaces in the order in which they claim a URL.
SITE_DOMAINS = (
    ("amazon", "amazon.com"),
    ("amazon", "amazon.in"),
    ("amazon", "amazon.co.uk"),
    ("amazon", "amazon.ca"),
    ("amazon", "amazon.de"),
    ("amazon", "amazon.fr"),
    ("amazon", "amazon.it"),
    ("amazon", "amazon.es"),
    ("amazon", "amazon.com.au"),
    ("amazon", "amazon.co.jp"),
    ("flipkart", "flipkart.com"),
    ("myntra", "myntra.com"),
    ("ajio", "ajio.com"),
    ("nykaa", "nykaa.com"),
    ("nykaa", "nykaafashion.com"),
)

# Domains open to link analysis.
ALLOWED_DOMAINS = (
    "amazon.in", "amazon.com", "amazon.co.uk", "flipkart.com", "myntra.com", "ajio.com", "nykaa.com",
    "nykaafashion.com",
)

# Product id patterns by marketplace, in the order tried.
PRODUCT_ID_PATTERNS = {
    "amazon": (r"/(?:dp|gp/product|product-reviews)/([A-Z0-9]{10})",),
    "flipkart": (r"/product-reviews/(itm\w+)", r"pid=([A-Z0-9]+)"),
    "myntra": (r"/(\d{6,15})(?:/buy|/reviews|$|[?#])",),
    "ajio": (r"/p/(\d+_[A-Za-z0-9]+)", r"/p/(\d+)"),
    "nykaa": (r"/p/(\d+)", r"[?&]productId=(\d+)"),
}

# URL shapes of product pages.
PRODUCT_PAGE_PATTERNS = (
    ("Amazon", r"amazon\.(com|in|co\.uk|ca|de|fr|it|es|com\.au|co\.jp)/.*/(dp|gp/product)/"),
    ("Flipkart", r"flipkart\.com/.*/p/"),
    ("Myntra", r"myntra\.com/.*/buy"),
    ("Ajio", r"ajio\.com/.*/p/"),
    ("Nykaa", r"nykaa\.com/.*/p/|nykaafashion\.com/.*/p/"),
)

# Host shapes of supported marketplaces.
HOST_PATTERNS = (
    ("Amazon", r"amazon\.(com|in|co\.uk|ca|de|fr|it|es|com\.au|co\.jp)"),
    ("Flipkart", r"flipkart\.com"),
    ("Myntra", r"myntra\.com"),
    ("Ajio", r"ajio\.com"),
    ("Nykaa", r"nykaa\.com|nykaafashion\.com"),
)

# Listing URL parts.
AMAZON_LISTING = "/ref=cm_cr_arp_d_paging_btm_next_1?ie=UTF8&reviewerType=all_reviews&pageNumber=1"
AMAZON_SORTED = "/ref=cm_cr_arp_d_viewopt_sr?ie=UTF8&reviewerType=all_reviews&pageNumber=1"
AMAZON_STARS = ("five_star", "four_star", "three_star", "two_star", "one_star")
FLIPKART_STARS = ("5", "4", "3", "2", "1")


def _found(url: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))


def authority(url: Column) -> Column:
    """Host of the URL in lower case, null where it has none."""
    return F.lower(_found(url, AUTHORITY))


def host(url: Column) -> Column:
    """Host without a leading ``www.``; ``unknown`` where the URL has none."""
    return F.coalesce(F.regexp_replace(authority(url), r"^www\.", ""), F.lit("unknown"))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def in_domain(host_col: Column, domain: str) -> Column:
    return (host_col == domain) | F.endswith(host_col, F.lit("." + domain))


def site_of(url: Column) -> Column:
    """Marketplace that claims the URL's host, null if none does."""
    h = authority(url)
    return F.coalesce(*[F.when(in_domain(h, d), s) for s, d in SITE_DOMAINS])


def product_id(url: Column, site: Column) -> Column:
    """The marketplace's own product id inside the URL, empty where there is none."""
    expr = F.when(F.lit(False), F.lit(""))
    for name, patterns in PRODUCT_ID_PATTERNS.items():
        expr = expr.when(site == name, F.coalesce(*[_found(url, p) for p in patterns], F.lit("")))
    return expr.otherwise("")


def review_url(url: Column, site: Column) -> Column:
    """Listing of all reviews for a product URL; a URL without product id is kept."""
    asin = _found(url, PRODUCT_ID_PATTERNS["amazon"][0])
    myntra = _found(url, PRODUCT_ID_PATTERNS["myntra"][0])
    path_end = r"^([^?#]*?)/p/(itm\w+)"
    return (
        F.when(
            (site == "amazon") & asin.isNotNull(),
            F.concat(origin(url), F.lit("/product-reviews/"), asin, F.lit(AMAZON_LISTING)),
        )
        .when(site == "flipkart", F.regexp_replace(url, path_end, "$1/product-reviews/$2"))
        .when((site == "myntra") & myntra.isNotNull(), F.concat(origin(url), F.lit("/reviews/"), myntra))
        .otherwise(url)
    )


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def set_param(url: Column, name: str, value: Column | str) -> Column:
    """Set one query parameter: replaced in its place, or put last. Other parameters keep their order."""
    value = F.lit(value) if isinstance(value, str) else value
    pair = F.concat(F.lit(name + "="), value)
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    key = lambda p: F.split_part(p, F.lit("="), F.lit(1))
    parts = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))),
    )

    def full(parts: Column, at: Column) -> Column:
        kept = F.filter(parts, lambda p, i: (key(p) != name) | (i + 1 == at))
        swapped = F.transform(kept, lambda p: F.when(key(p) == name, pair).otherwise(p))
        return F.when(at > 0, swapped).otherwise(F.array_append(kept, pair))

    placed = _with(parts, lambda ps: _with(F.array_position(F.transform(ps, key), F.lit(name)), lambda at: full(ps, at)))
    return F.concat(base, F.lit("?"), F.array_join(placed, "&"), fragment)


def expand_url_batches(df: DataFrame, url: str = "url", site: str = "site") -> DataFrame:
    """One row per listing URL of a product, in crawl order from 0: ``batch_no, batch_url``.

    Amazon: product page, all reviews in two orders, then each star in both orders. Flipkart: all reviews, then each
    star in both orders. Other marketplaces have their one listing.
    """
    plan = lambda rows: F.array(
        *[
            F.struct(F.lit(i).alias("batch_no"), F.lit(kind).alias("_kind"), F.lit(star).alias("_star"), F.lit(by).alias("_by"))
            for i, (kind, star, by) in enumerate(rows)
        ]
    )
    amazon = [("page", "", ""), ("all", "", ""), ("sorted", "", "recent")]
    amazon += [("star", s, by) for by in ("recent", "helpful") for s in AMAZON_STARS]
    flipkart = [("all", "", "")] + [("star", s, by) for by in ("MOST_RECENT", "MOST_HELPFUL") for s in FLIPKART_STARS]
    u, s = F.col(url), F.col(site)
    asin = _found(u, PRODUCT_ID_PATTERNS["amazon"][0])
    # What all listings of a product share is made once per product, ahead of the rows for its listings.
    listing = F.when(s == "flipkart", set_param(review_url(u, s), "page", "1")).otherwise(review_url(u, s))
    shared = df.withColumns({"_asin": asin, "_origin": origin(u), "_listing": listing})
    asin = F.col("_asin")
    rows = shared.select(
        "*",
        F.inline(
            F.when((s == "amazon") & asin.isNotNull(), plan(amazon))
            .when(s == "flipkart", plan(flipkart))
            .otherwise(plan([("all", "", "")]))
        ),
    )
    kind, star, by = F.col("_kind"), F.col("_star"), F.col("_by")
    own_sort = F.concat(F.col("_origin"), F.lit("/product-reviews/"), asin, F.lit(AMAZON_SORTED))
    built = (
        F.when(kind == "page", F.concat(F.col("_origin"), F.lit("/dp/"), asin))
        .when((s == "amazon") & (kind == "sorted"), F.concat(own_sort, F.lit("&sortBy="), by))
        .when((s == "amazon") & (kind == "star"), F.concat(own_sort, F.lit("&filterByStar="), star, F.lit("&sortBy="), by))
        .otherwise(F.col("_listing"))
    )
    rows = rows.withColumn("batch_url", built)
    # One parameter per step: each step reads the finished column of the step before.
    wanted = (s == "flipkart") & (kind == "star")
    for name, value in (("rating", star), ("sortOrder", by)):
        rows = rows.withColumn(
            "batch_url", F.when(wanted, set_param(F.col("batch_url"), name, value)).otherwise(F.col("batch_url"))
        )
    return rows.drop("_kind", "_star", "_by", "_asin", "_origin", "_listing")


def _first_match(value: Column, patterns: tuple) -> Column:
    return F.coalesce(*[F.when(value.rlike(p), name) for name, p in patterns])


def product_page_site(url: Column) -> Column:
    """Name of the marketplace whose product page this is, null for other pages."""
    return _first_match(url, PRODUCT_PAGE_PATTERNS)


def supported_site(url: Column) -> Column:
    """Name of the marketplace of the host, null for other hosts."""
    return _first_match(authority(url), HOST_PATTERNS)


def client_ip(forwarded_for: Column, real_ip: Column, remote: Column) -> Column:
    first_hop = F.trim(F.split_part(forwarded_for, F.lit(","), F.lit(1)))
    return F.when(forwarded_for != "", first_hop).when(real_ip != "", real_ip).otherwise(remote)
