"""Reviews and product facts out of stored pages and service bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustgrain import sql
from trustgrain.operators.extract import api, cards, embedded, jsonld
from trustgrain.operators.skew import dealt, spread_over
from trustgrain.plans import derive
from trustgrain.sources.tables import load

from .base import REVIEWS_SQL, query
from .scalars import HOST

WITH = f"WITH {REVIEWS_SQL.strip()} "
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
CLEAN = rf"trim(regexp_replace(trim(regexp_replace(text, '{WS}+', ' ', 'g')), '\b(read more|read less)\b', '', 'gi'))"
PAGE = "product_id || '-' || CAST(review_idx // 100 AS VARCHAR)"


@query("jsonld_reviews", WITH + f"SELECT {PAGE} AS page_id, {CLEAN} AS text, rating FROM reviews WHERE {CLEAN} <> ''")
def jsonld_reviews(spark, d):
    return jsonld.jsonld_reviews(derive.review_pages(spark, d)).select("page_id", "text", "rating")


@query(
    "product_meta",
    WITH + f"SELECT DISTINCT {PAGE} AS page_id, product_id AS name, 'brand ' || product_id AS brand, 'INR 499' AS price, '' AS image_url, 4.1::DOUBLE AS overall_rating FROM reviews",
)
def product_meta(spark, d):
    return jsonld.product_meta(derive.review_pages(spark, d))


@query(
    "service_meta",
    """SELECT p_partkey AS body_id, p_name AS name, CASE WHEN MOD(p_partkey, 2) = 0 THEN p_brand ELSE '' END AS brand, 'INR ' || p_size AS price, '' AS image_url,
    CASE WHEN MOD(p_partkey, 8) < 5 THEN CAST(MOD(p_partkey, 8) AS DOUBLE) + 0.5::DOUBLE END AS overall_rating FROM part""",
)
def service_meta(spark, d):
    """One answer per part; the product is named at the top or inside a wrapper, ratings beyond 5 do not count."""
    p = load(spark, d, "part")
    facts = F.struct(
        F.col("p_name").alias("productName"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("brandName"),
        F.col("p_size").alias("mrp"),
        ((F.col("p_partkey") % 8).cast("double") + 0.5).alias("averageRating"),
    )
    body = F.when(F.col("p_partkey") % 3 == 0, F.to_json(facts)).otherwise(F.to_json(F.struct(facts.alias("data"))))
    return api.service_meta(p.select(F.col("p_partkey").alias("body_id"), body.alias("body")))


@query(
    "shown_meta",
    "SELECT p_partkey AS page_id, p_name AS name, p_brand AS brand, 'INR ' || p_size AS price, p_type || '.png' AS image_url, CAST(MOD(p_size, 5) AS DOUBLE) + 0.5::DOUBLE AS overall_rating FROM part",
)
def shown_meta(spark, d):
    html = F.concat(
        F.lit('<html><body><span id="productTitle"> '), "p_name", F.lit(' </span><a id="bylineInfo">Visit the '), "p_brand",
        F.lit(' Store</a><span class="a-price"><b class="a-offscreen">INR '), "p_size", F.lit('</b></span><img id="landingImage" src="'), "p_type",
        F.lit('.png"><div id="acrPopover"><i class="x a-icon-alt">'), F.col("p_size") % 5, F.lit(".5 out of 5</i></div></body></html>"),
    )
    return cards.shown_meta(dealt(load(spark, d, "part")).select(F.col("p_partkey").alias("page_id"), html.alias("html")))


@query(
    "page_state_meta",
    """SELECT p_partkey AS page_id, p_name AS name, p_brand AS brand, 'INR ' || p_size AS price, p_type || '.jpg' AS image_url, 4.5::DOUBLE AS overall_rating FROM part""",
)
def page_state_meta(spark, d):
    state = F.to_json(
        F.struct(
            F.struct(
                F.col("p_name").alias("name"),
                F.struct(F.col("p_brand").alias("name")).alias("brand"),
                F.col("p_size").alias("mrp"),
                F.struct(F.array(F.struct(F.concat("p_type", F.lit(".jpg")).alias("image"))).alias("albums")).alias("media"),
                F.struct(F.lit(4.5).alias("averageRating")).alias("ratings"),
            ).alias("pdpData")
        )
    )
    html = F.concat(F.lit("<script>window.__myx = "), state, F.lit("</script>"))
    pages = load(spark, d, "part").select(F.col("p_partkey").alias("page_id"), html.alias("html"))
    documents = embedded.state_documents(pages)
    return api.page_state_meta(documents, ["page_id"])


@query(
    "page_titles",
    r"""SELECT page_id, CASE WHEN length(t) > 5 THEN t END AS name FROM (SELECT page_id, trim(regexp_replace(regexp_replace(
    regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '(?i)^Buy\s+', ''), '(?i)\s+Online\s*\|.*$', '')) AS t FROM pages)""",
)
def page_titles(spark, d):
    return load(spark, d, "pages").select("page_id", jsonld.name_from_title(F.col("html")).alias("name"))


def state_pages(spark, d):
    """One page per document with the review inside script state, at different depths and under different names."""
    r = derive.reviews(spark, d)
    node = F.to_json(
        F.struct(
            F.struct(
                F.array(F.struct(F.col("text").alias("reviewBody"), F.struct(F.col("rating").alias("ratingValue")).alias("reviewRating"))).alias(
                    "list"
                )
            ).alias("page")
        )
    )
    flat = F.to_json(F.struct(F.col("text").alias("comment"), F.concat("rating", F.lit(" stars")).alias("stars")))
    pad = F.lit("/* " + "x" * 100 + " */ ")
    k = F.col("review_idx") % 3
    script = (
        F.when(k == 0, F.concat(F.lit("<script>"), pad, F.lit("window.__INITIAL_STATE__ = "), node, F.lit("; window.x = {a: 1};</script>")))
        .when(k == 1, F.concat(F.lit('<script id="__NEXT_DATA__">'), flat, F.lit(" " * 100 + "</script>")))
        .otherwise(F.concat(F.lit("<script>"), pad, F.lit("var other = "), flat, F.lit("</script>")))
    )
    return r.select(F.col("review_idx").alias("page_id"), F.concat(F.lit("<html>"), script, F.lit("</html>")).alias("html"))


@query(
    "embedded_reviews",
    WITH + f"SELECT review_idx AS page_id, {CLEAN} AS text, rating FROM reviews WHERE MOD(review_idx, 3) <> 2 AND {CLEAN} <> ''",
)
def embedded_reviews(spark, d):
    return embedded.embedded_reviews(state_pages(spark, d)).select("page_id", "text", "rating")


@query(
    "deep_reviews",
    WITH + f"SELECT review_idx AS doc_id, {CLEAN} AS text, rating FROM reviews WHERE {CLEAN} <> ''",
)
def deep_reviews(spark, d):
    r = derive.reviews(spark, d)
    doc = F.to_json(
        F.struct(F.struct(F.array(F.struct(F.col("text").alias("content"), F.lit(9).alias("score"), F.col("rating").alias("overall"))).alias("a")).alias("b"))
    )
    docs = r.select(F.col("review_idx").alias("doc_id"), doc.alias("doc"))
    return embedded.deep_reviews(docs, ["doc_id"]).select("doc_id", "text", "rating")


@query(
    "sql_reviews",
    WITH + f"SELECT review_idx AS doc_id, {CLEAN} AS text, rating, 'unknown' AS host FROM reviews WHERE {CLEAN} <> ''",
)
def sql_reviews(spark, d):
    """The same as ``deep_reviews``, as SQL text."""
    statement = """
    SELECT doc_id, clean_text(text) AS text, parse_rating(rating) AS rating, url_host(text) AS host
    FROM reviews_in(TABLE(
      SELECT review_idx AS doc_id, to_json(named_struct('b', named_struct('a', array(named_struct('content', text, 'score', 9, 'overall', rating))))) AS doc
      FROM trust_reviews), 'doc')
    WHERE clean_text(text) <> ''"""
    return sql.query(spark, statement, trust_reviews=derive.reviews(spark, d))


@query(
    "sql_pages",
    f"SELECT page_id, coalesce(regexp_replace({HOST.format('url')}, '^www\\.', ''), 'unknown') AS host, CAST(length({CLEAN.replace('text', 'html')}) AS INTEGER) AS n_chars FROM pages",
)
def sql_pages(spark, d):
    statement = "SELECT page_id, url_host(url) AS host, length(clean_text(html)) AS n_chars FROM trust_pages"
    return sql.query(spark, statement, trust_pages=load(spark, d, "pages"))


@query("unreadable_documents", "SELECT p_partkey AS doc_id, CASE MOD(p_partkey, 3) WHEN 0 THEN 'not JSON' ELSE 'not JSON' END AS reason FROM part WHERE MOD(p_partkey, 3) < 2")
def unreadable_documents(spark, d):
    p, k = load(spark, d, "part"), F.col("p_partkey") % 3
    doc = F.when(k == 0, F.lit('{"reviews": [')).when(k == 1, F.lit("")).otherwise(F.to_json(F.struct(F.col("p_name").alias("text"))))
    found = embedded.unreadable_documents(p.select(F.col("p_partkey").alias("doc_id"), doc.alias("doc")), ["doc_id"])
    return found.select("doc_id", F.split_part("error", F.lit(":"), F.lit(1)).alias("reason"))


def api_bodies(spark, d):
    """One service answer per document: a list inside a wrapper, ids and epoch dates."""
    r = derive.reviews(spark, d)
    item = F.struct(
        (F.col("review_idx") + 1).alias("id"),
        F.col("text").alias("reviewText"),
        F.col("rating").alias("rating"),
        (F.unix_date("review_date").cast("long") * 86400000).cast("string").alias("createdDate"),
    )
    body = F.to_json(F.struct(F.struct(F.array(item).alias("productReviews"), F.lit(45).alias("totalReviews")).alias("reviewData")))
    return r.select(F.col("review_idx").alias("body_id"), "product_id", body.alias("body"))


@query(
    "api_reviews",
    WITH + f"SELECT review_idx AS body_id, {CLEAN} AS text, rating, CAST(review_idx + 1 AS VARCHAR) AS review_id, strftime(review_date, '%Y-%m-%d') AS date FROM reviews",
)
def api_reviews(spark, d):
    return api.api_reviews(api_bodies(spark, d), "ajio").select("body_id", "text", "rating", "review_id", "date")


_BLOCK = "product_id || '-' || CAST(FLOOR(review_idx / 80) AS BIGINT)"
_FP = f"regexp_replace(lower({CLEAN}), '[^a-z0-9]', '', 'g')"


def blocks(spark, d):
    """Reviews in blocks of a product, a body of several reviews each.

    Whole texts are dealt out, so there are as many parts as documents are read in, where a shuffle has fewer.
    """
    r = derive.reviews(spark, d).withColumn("body_id", F.concat_ws("-", "product_id", F.floor(F.col("review_idx") / 80).cast("string")))
    item = F.struct("review_idx", "text", "rating", "review_date")
    parts = r.rdd.getNumPartitions()
    if parts > spread_over(r):
        r = r.repartition(parts, "body_id")
    return r.groupBy("body_id").agg(F.array_sort(F.collect_list(item)).alias("items"))


def named(items, **keys):
    """Items with their values under a service's own key names."""
    values = {
        "text": lambda x: x["text"],
        "rating": lambda x: x["rating"],
        "id": lambda x: (x["review_idx"] + 1).cast("string"),
        "date": lambda x: (F.unix_date(x["review_date"]).cast("long") * 86400000).cast("string"),
    }
    return F.transform(items, lambda x: F.struct(*[values[k](x).alias(name) for name, k in keys.items()]))


_ALL = f"SELECT {_BLOCK} AS body_id, {CLEAN} AS text, rating, CAST(review_idx + 1 AS VARCHAR) AS review_id, strftime(review_date, '%Y-%m-%d') AS date FROM reviews"
_TEN = f" WHERE length(regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')) >= 10"
_ONCE = f"""SELECT body_id, text, rating, '' AS review_id, '' AS date FROM (SELECT {_BLOCK} AS body_id, {CLEAN} AS text, rating,
    ROW_NUMBER() OVER (PARTITION BY {_BLOCK}, {_FP}, rating ORDER BY review_idx) AS n FROM reviews WHERE {CLEAN} <> '') WHERE n = 1"""
_SHOWN = ["body_id", "text", "rating", "review_id", "date"]


@query("api_reviews_nykaa", WITH + _ALL + _TEN)
def api_reviews_nykaa(spark, d):
    """Lists inside a wrapper, each twice over: what repeats an earlier review of the body goes."""
    items = named(F.col("items"), description="text", starRating="rating", reviewId="id", createdOn="date")
    body = F.to_json(F.struct(F.struct(F.concat(items, items).alias("reviewList")).alias("response")))
    return api.api_reviews(blocks(spark, d).select("body_id", body.alias("body")), "nykaa").select(*_SHOWN)


@query("api_reviews_myntra", WITH + _ALL + _TEN)
def api_reviews_myntra(spark, d):
    """The body itself is a list."""
    body = F.to_json(named(F.col("items"), reviewContent="text", userRating="rating", uid="id", postedOn="date"))
    return api.api_reviews(blocks(spark, d).select("body_id", body.alias("body")), "myntra").select(*_SHOWN)


@query("api_reviews_page_state", WITH + _ALL)
def api_reviews_page_state(spark, d):
    """Half of the reviews in the main list, all but one of the others and a repeat among the top reviews of the product."""
    items, n = F.col("items"), F.size("items")
    main = named(F.slice(items, 1, F.greatest(F.floor(n / 2).cast("int"), F.lit(1))), review="text", userRating="rating", id="id", timestamp="date")
    top = named(items, reviewText="text", rating="rating", reviewId="id", updatedAt="date")
    state = F.struct(F.struct(main.alias("reviews")).alias("reviewsData"), F.struct(F.struct(F.struct(top.alias("topReviews")).alias("reviewInfo")).alias("ratings")).alias("pdpData"))
    return api.api_reviews(blocks(spark, d).select("body_id", F.to_json(state).alias("body")), "myntra_page").select(*_SHOWN)


@query("api_reviews_flipkart", WITH + _ONCE)
def api_reviews_flipkart(spark, d):
    """Reviews at some depth without a known list."""
    items = named(F.col("items"), text="text", rating="rating")
    body = F.to_json(F.struct(F.struct(F.array(F.struct(items.alias("widgets"))).alias("slots")).alias("RESPONSE")))
    return api.api_reviews(blocks(spark, d).select("body_id", body.alias("body")), "flipkart").select(*_SHOWN)


@query("api_reviews_anywhere", WITH + _ONCE)
def api_reviews_anywhere(spark, d):
    """Answers of a service that usually has a list, without one; a third of the bodies is no JSON and has no reviews here."""
    items = named(F.col("items"), content="text", stars="rating")
    body = F.to_json(F.struct(F.struct(F.struct(items.alias("entries")).alias("page")).alias("unknown")))
    return api.api_reviews(blocks(spark, d).select("body_id", body.alias("body")), "ajio").select(*_SHOWN)


@query(
    "declared_pages",
    """SELECT p_partkey AS body_id, CASE MOD(p_partkey, 4) WHEN 0 THEN p_size > 3 WHEN 1 THEN 3 * 5 < p_size WHEN 2 THEN 3 * 10 < p_size ELSE false END AS more,
    CAST(p_size AS BIGINT) AS total, p_size > 0 AND 20 < p_size AS next FROM part""",
)
def declared_pages(spark, d):
    """Whether pages follow the third: by a number of pages, by a total and a page size, by a total alone, or not said."""
    p, k = load(spark, d, "part"), F.col("p_partkey") % 4
    deep = lambda o: F.to_json(F.struct(F.array(F.struct(F.struct(o).alias("paging"), F.lit("x").alias("pageCount"))).alias("slots")))
    size = F.col("p_size").cast("int")
    body = (
        F.when(k == 0, deep(F.struct(size.alias("totalPages"))))
        .when(k == 1, deep(F.struct(size.alias("totalCount"), F.lit(5).alias("pageSize"))))
        .when(k == 2, deep(F.struct(F.lit(0).alias("totalCount"), size.alias("total"))))
        .otherwise(F.lit('{"total": "many", "pageCount": 2.5}'))
    )
    html = F.when(k < 2, F.concat(F.lit('<div data-hook="cr-filter-info-review-rating-count"> <span>1,0 ratings</span>, '), size, F.lit(" global reviews</div>"))).otherwise(
        F.concat(F.lit('<span class="a" data-hook="total-review-count">'), size, F.lit("</span>"))
    )
    html = F.replace(html, F.lit("<span>1,0 ratings</span>, "), F.lit(""))
    bodies = p.select(F.col("p_partkey").alias("body_id"), body.alias("body"), F.lit(3).alias("page"))
    totals = p.select(F.col("p_partkey").alias("body_id"), api.shown_total(html).alias("total"))
    return api.more_pages(bodies).join(totals, "body_id").withColumn("next", api.has_next_page(F.col("total"), F.lit(1), F.lit(20)))


@query(
    "page_frontier",
    WITH
    + """, w AS (SELECT DISTINCT product_id, CAST(p AS INTEGER) AS page_no FROM reviews, unnest(range(1, 4)) AS r(p))
    SELECT product_id, page_no FROM w WHERE NOT EXISTS (SELECT 1 FROM reviews f WHERE f.product_id = w.product_id AND MOD(f.review_idx, 7) + 1 = w.page_no AND f.rating < 2)""",
)
def page_frontier(spark, d):
    bodies = api_bodies(spark, d)
    totals = bodies.select(
        "product_id", api.declared_total(F.try_parse_json("body"), "ajio").alias("total")
    ).groupBy("product_id").agg(F.max("total").alias("total"))
    fetched = (
        derive.reviews(spark, d)
        .filter(F.col("rating") < 2)
        .select("product_id", (F.col("review_idx") % 7 + 1).cast("int").alias("page_no"))
        .distinct()
    )
    return api.page_frontier(totals, fetched, 20)


def card_pages(spark, d):
    """One marketplace page per document with a single review card; every fifth site."""
    r = derive.reviews(spark, d)
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    stars = F.col("rating").cast("int").cast("string")
    k = F.col("review_idx") % 5
    card = (
        F.when(
            k == 0,
            F.concat(
                F.lit('<div data-hook="review" id="customer_review-R'), F.lpad(F.col("review_idx").cast("string"), 12, "0"),
                F.lit('"><i data-hook="review-star-rating"><span class="a-icon-alt">'), stars, F.lit(".0 out of 5 stars</span></i>"),
                F.lit('<span data-hook="review-date">Reviewed in India on 3 May 2024</span><span data-hook="review-body">'), safe, F.lit("</span></div>"),
            ),
        )
        .when(k == 1, F.concat(F.lit('<div class="col _2wzgFH"><div class="_3LWZlK">'), stars, F.lit('</div><div class="t-ZTKy"><div>'), safe, F.lit("</div></div></div>")))
        .when(k == 2, F.concat(F.lit('<div class="x-userReview"><span class="user-rating">'), stars, F.lit('</span><div class="reviewText">'), safe, F.lit("</div></div>")))
        .when(k == 3, F.concat(F.lit('<ul><li class="a-review"><b class="starBox">'), stars, F.lit("</b><p>"), safe, F.lit("</p></li></ul>")))
        .otherwise(F.concat(F.lit('<div class="review-card"><i class="Rating">'), stars, F.lit("</i><p>"), safe, F.lit("</p></div>")))
    )
    site = F.element_at(F.array(*[F.lit(x) for x in ("www.amazon.in", "www.flipkart.com", "www.myntra.com", "www.ajio.com", "www.nykaa.com")]), (k + 1).cast("int"))
    return r.select(
        F.col("review_idx").alias("page_id"),
        F.concat(F.lit("https://"), site, F.lit("/p/"), F.col("review_idx")).alias("url"),
        F.concat(F.lit("<html><body><br>"), card, F.lit("</body></html>")).alias("html"),
    )


@query(
    "extract_reviews",
    WITH
    + f"""SELECT review_idx AS page_id, ['amazon', 'flipkart', 'myntra', 'ajio', 'nykaa'][MOD(review_idx, 5) + 1] AS site, {CLEAN} AS text, rating,
    CASE WHEN MOD(review_idx, 5) = 0 THEN 'R' || lpad(CAST(review_idx AS VARCHAR), 12, '0') ELSE '' END AS review_id,
    CASE WHEN MOD(review_idx, 5) = 0 THEN '3 May 2024' ELSE '' END AS date FROM reviews""",
)
def extract_reviews(spark, d):
    found = cards.extract_reviews(card_pages(spark, d))
    return found.select("page_id", "site", "text", "rating", "review_id", "date")


@query("extract_from_jsonld_pages", WITH + f"SELECT {PAGE} AS page_id, 'ajio' AS site, 'jsonld' AS reading, COUNT(DISTINCT regexp_replace(lower({CLEAN}), '[^a-z0-9]', '', 'g') || '|' || rating) AS n FROM reviews GROUP BY 1")
def extract_from_jsonld_pages(spark, d):
    found = cards.extract_reviews(derive.review_pages(spark, d))
    return found.groupBy("page_id", "site", "reading").agg(F.count(F.lit(1)).alias("n"))

