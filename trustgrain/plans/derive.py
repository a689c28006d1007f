"""Review, usage and account tables derived from the given star-schema tables.

The given tables hold documents, events, customers and orders. These views read them as reviews, site visits, analysis
records, users and link analyses, keeping every row and every whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import dealt
from ..sources.tables import load

#: The moment at which rolling counts are taken over the event table.
AS_OF = "2024-01-31 00:00:00"


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as reviews: the source is the product, stars and dates follow from position and length."""
    docs = load(spark, folder, "documents")
    k, seq = F.col("doc_id") % 20, F.floor(F.col("doc_id") / 20)
    ten = seq % 10
    stars = (
        F.when(
            k % 4 == 0,
            F.when(ten.isin(1, 4, 7), 4).when(ten == 3, 3).when(ten == 6, 2).when(ten == 9, 1).otherwise(5),
        )
        .when(k % 4 == 1, F.when(ten.isin(1, 3, 6), 1).when(ten == 8, 3).otherwise(5))
        .when(k % 4 == 2, F.when(seq % 20 == 0, 4).otherwise(5))
        .otherwise((1 + seq % 5).cast("int"))
    )
    day = F.when((k % 3 == 0) & (ten < 7), 10 + seq % 3).otherwise(seq % 90).cast("int")
    feeling = F.col("n_chars") % 7
    return docs.select(
        F.col("source").alias("product_id"),
        F.col("doc_id").alias("review_idx"),
        "text",
        stars.cast("double").alias("rating"),
        F.date_add(F.lit("2024-01-01").cast("date"), day).alias("review_date"),
        F.when(feeling < 4, "positive").when(feeling < 6, "negative").otherwise("neutral").alias("sentiment"),
        ((50 + F.col("n_chars") % 50).cast("double") / 100).alias("confidence"),
        ((F.col("n_chars") % 101).cast("double") / 100).alias("ai_probability"),
        (1 + F.col("n_chars") % 5).cast("int").alias("predicted_rating"),
        "lang",
    )


def site_visits(spark: SparkSession, folder: str) -> DataFrame:
    return as_visits(load(spark, folder, "events"))


def as_visits(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("/"), "event_type").alias("endpoint"),
        F.col("event_type").isin("purchase", "signup").alias("authenticated"),
        F.concat(F.lit("ip"), F.col("user_id").cast("string")).alias("ip_address"),
        "user_id",
        F.floor("value").alias("response_time_ms"),
        F.col("ts").alias("created_at"),
    )


def analysis_metrics(spark: SparkSession, folder: str) -> DataFrame:
    e = load(spark, folder, "events")
    link = F.col("event_type") == "purchase"
    return e.select(
        F.col("event_id").alias("id"),
        F.when(link, "PRODUCT_LINK").otherwise("INDIVIDUAL_REVIEW").alias("analysis_type"),
        F.col("event_type").isin("purchase", "signup").alias("authenticated"),
        "user_id",
        F.when(F.col("user_id") % 5 == 0, F.lit(None)).when(F.col("user_id") % 2 == 0, "en").otherwise("fr").alias(
            "detected_language"
        ),
        F.when(link, F.concat(F.lit("shop"), (F.col("user_id") % 7).cast("string"), F.lit(".example"))).alias("domain"),
        F.col("ts").alias("created_at"),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    c = load(spark, folder, "customer")
    return c.select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@mail.example")).alias("email"),
        F.col("c_name").alias("full_name"),
        F.when(F.col("c_mktsegment") == "BUILDING", "ADMIN").otherwise("USER").alias("role"),
        (F.col("c_acctbal") >= 0).alias("enabled"),
        (
            F.lit("2023-11-14 22:13:20").cast("timestamp_ntz")
            + F.make_dt_interval(secs=(F.col("c_custkey") * 37 % 1000003).cast("decimal(18,6)"))
        ).alias("created_at"),
    )


def review_analyses(spark: SparkSession, folder: str) -> DataFrame:
    """Stored analyses of single reviews: one per line item."""
    li = load(spark, folder, "lineitem")
    return li.select(
        F.concat_ws("-", F.lit("r"), "l_orderkey", "l_linenumber").alias("id"),
        F.col("l_suppkey").alias("user_id"),
        F.when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "R", "negative").otherwise(
            "neutral"
        ).alias("sentiment"),
        (1 + F.col("l_linenumber") % 5).cast("int").alias("predicted_rating"),
        F.col("l_discount").alias("ai_probability"),
        (F.col("l_quantity") * 2).cast("int").alias("authenticity_score"),
        F.col("l_shipdate").alias("created_at"),
    )


def link_analyses(spark: SparkSession, folder: str) -> DataFrame:
    """Stored analyses of product links: one per order."""
    o = load(spark, folder, "orders")
    return o.select(
        F.concat_ws("-", F.lit("l"), "o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.lower(F.concat(F.substring("o_orderpriority", 1, 1), F.lit(".example"))).alias("domain"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("total_reviews"),
        F.col("o_orderdate").alias("created_at"),
    )


# Views in SQL that Spark and other engines read alike. Table names in braces are bound to the given tables.
SHORT_REVIEWS = """
SELECT p_partkey AS review_idx, p_brand AS product_id,
  CASE WHEN MOD(p_partkey, 3) = 0 THEN '' ELSE concat('R', CAST(CAST(FLOOR(p_partkey / 4) AS BIGINT) AS STRING)) END AS review_id,
  CAST(1 + MOD(p_partkey, 6) AS INT) AS page_no,
  CASE MOD(p_partkey, 16)
    WHEN 0 THEN concat(upper(p_name), ' IS THE BEST PRODUCT!!!!! BUY NOW')
    WHEN 1 THEN concat('good product ', p_name)
    WHEN 2 THEN concat('only ', CAST(p_size AS STRING), ' left so order now for this ', p_name, ' please')
    WHEN 3 THEN concat('why? why? really? the ', p_name, ' broke after ', CAST(p_size AS STRING), ' days')
    WHEN 4 THEN concat(p_name, ' ', p_name, ' ', p_name, ' ', p_name, ' ', p_name)
    WHEN 5 THEN concat('I am a first time buyer of the ', p_name, ' and it cost $', CAST(p_size AS STRING), ' in 2023')
    WHEN 6 THEN concat('Five star rating  for ', p_name, ' READ MORE')
    WHEN 7 THEN concat('  ', p_brand, '   bought in mar, works for 3 weeks so far, the ', p_name,
                       ' is fine and I would take it again on any day of the year')
    WHEN 8 THEN concat('यह उत्पाद बहुत अच्छा है ', p_name)
    WHEN 9 THEN 'Отличный товар, всем советую'
    WHEN 10 THEN '这个产品很好用'
    WHEN 11 THEN 'とてもよいしなです'
    WHEN 12 THEN '정말 좋은 제품 입니다'
    WHEN 13 THEN 'منتج جيد جدا'
    WHEN 14 THEN '   '
    ELSE concat('Verified Purchase ', p_type, ' 5 ★ 218 4 ★ 80') END AS text,
  CASE MOD(p_partkey, 5) WHEN 0 THEN concat(CAST(MOD(p_size, 5) AS STRING), '.5 out of 5') WHEN 1 THEN CAST(MOD(p_size, 9) AS STRING)
    WHEN 2 THEN 'no stars' WHEN 3 THEN '4,0' ELSE concat('rated ', CAST(MOD(p_size, 6) AS STRING)) END AS rating_raw,
  CAST(1 + MOD(p_size, 5) AS DOUBLE) AS rating,
  CASE MOD(p_partkey, 9)
    WHEN 0 THEN concat('2024-01-', lpad(CAST(1 + MOD(p_size, 28) AS STRING), 2, '0'))
    WHEN 1 THEN concat(CAST(1 + MOD(p_size, 28) AS STRING), ' March 2024')
    WHEN 2 THEN concat('March ', CAST(1 + MOD(p_size, 28) AS STRING), ', 2024')
    WHEN 3 THEN concat(CAST(1 + MOD(p_size, 28) AS STRING), '/4/2024')
    WHEN 4 THEN concat('4/', CAST(1 + MOD(p_size, 28) AS STRING), '/2024')
    WHEN 5 THEN concat(CAST(1 + MOD(p_size, 28) AS STRING), '-11-2023')
    WHEN 6 THEN concat(CAST(1 + MOD(p_size, 28) AS STRING), ' months ago')
    WHEN 7 THEN concat('Reviewed in India on May ', CAST(1 + MOD(p_size, 28) AS STRING), ', 2023')
    ELSE concat('Dec ', CAST(1 + MOD(p_size, 28) AS STRING), ', 2022') END AS date_raw,
  CASE MOD(p_partkey, 4) WHEN 0 THEN CAST(1700000000000 + p_partkey * 86400000 AS STRING)
    WHEN 1 THEN concat('2024-02-', lpad(CAST(1 + MOD(p_size, 28) AS STRING), 2, '0'), 'T10:11:12Z')
    WHEN 2 THEN '2024-03-01' ELSE '12345' END AS api_date,
  CASE MOD(p_partkey, 7) WHEN 0 THEN 'Positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'neutral' WHEN 3 THEN 'mixed'
    WHEN 4 THEN 'positive' WHEN 5 THEN 'Negative' ELSE NULL END AS sentiment,
  CAST(1 + MOD(p_partkey, 5) AS INT) AS predicted_rating,
  CAST(MOD(p_partkey, 101) AS DOUBLE) / 100 AS ai_probability,
  CAST(50 + MOD(p_size, 50) AS DOUBLE) / 100 AS confidence
FROM {part}
"""

PRODUCT_URLS = """
SELECT p_partkey AS url_id,
  CASE MOD(p_partkey, 14)
    WHEN 0 THEN concat('https://www.amazon.in/', replace(p_name, ' ', '-'), '/dp/B', lpad(CAST(p_partkey AS STRING), 9, '0'), '?ref=sr_1')
    WHEN 1 THEN concat('https://amazon.co.uk/gp/product/B', lpad(CAST(p_partkey AS STRING), 9, '0'), '/x')
    WHEN 2 THEN concat('https://www.flipkart.com/', replace(p_name, ' ', '-'), '/p/itm', CAST(p_partkey AS STRING), '?pid=ABC', CAST(p_size AS STRING), '&page=3')
    WHEN 3 THEN concat('https://flipkart.com/x?pid=XYZ', CAST(p_partkey AS STRING))
    WHEN 4 THEN concat('https://www.myntra.com/shirts/brand/', CAST(1000000 + p_partkey AS STRING), '/buy')
    WHEN 5 THEN concat('https://www.myntra.com/reviews/', CAST(1000000 + p_partkey AS STRING))
    WHEN 6 THEN concat('https://www.ajio.com/leggings/p/', CAST(460000000 + p_partkey AS STRING), '_black')
    WHEN 7 THEN concat('https://www.ajio.com/leggings/p/', CAST(460000000 + p_partkey AS STRING))
    WHEN 8 THEN concat('https://www.nykaa.com/cream/p/', CAST(p_partkey AS STRING), '?skuId=1')
    WHEN 9 THEN concat('https://nykaafashion.com/c?productId=', CAST(p_partkey AS STRING))
    WHEN 10 THEN concat('https://notamazon.in/dp/B', lpad(CAST(p_partkey AS STRING), 9, '0'))
    WHEN 11 THEN concat('HTTPS://WWW.Example.COM:8080/login/phone?u=', CAST(p_partkey AS STRING))
    WHEN 12 THEN concat('https://cdn.hotjar.com/', p_brand, '.js')
    ELSE concat('no url ', p_name) END AS url,
  CASE MOD(p_partkey, 5) WHEN 0 THEN 'image' WHEN 1 THEN 'script' WHEN 2 THEN 'document' WHEN 3 THEN 'font' ELSE 'xhr' END AS resource_type
FROM {part}
"""

REFRESH_TOKENS = """
SELECT o_orderkey AS token_id, concat('token-', CAST(o_orderkey AS STRING)) AS token, o_custkey AS user_id,
  o_orderdate AS expires_at, MOD(o_orderkey, 5) = 0 AS revoked
FROM {orders}
"""

CONTACT_MESSAGES = """
SELECT conv_id * 1000 + turn AS id, role AS first_name, concat('conv', CAST(conv_id AS STRING)) AS last_name,
  concat(role, CAST(MOD(conv_id, 17) AS STRING), '@mail.example') AS email, text AS message,
  CASE WHEN MOD(conv_id, 3) = 0 THEN NULL ELSE conv_id END AS user_id,
  CAST(DATE '2024-01-01' + CAST(MOD(conv_id, 31) AS INT) AS TIMESTAMP) AS created_at
FROM {conversations}
"""


def view(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """One of the SQL views above over the given tables."""
    names = [n for n in ("part", "orders", "conversations", "documents", "events") if "{" + n + "}" in sql]
    return spark.sql(sql, **{n: load(spark, folder, n) for n in names})


def short_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """One short review per part, written so that every rule on single reviews has cases."""
    return spark.sql(SHORT_REVIEWS, part=dealt(load(spark, folder, "part")))


def product_urls(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(PRODUCT_URLS, part=dealt(load(spark, folder, "part")))


def refresh_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, REFRESH_TOKENS)


def contact_messages(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, CONTACT_MESSAGES).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


def review_pages(spark: SparkSession, folder: str, per_page: int = 5) -> DataFrame:
    """Reviews as product pages with JSON-LD, five to a page: ``(page_id, url, html)``."""
    r = reviews(spark, folder)
    ld = F.struct(
        F.lit("Product").alias("@type"),
        F.col("product_id").alias("name"),
        F.struct(F.concat(F.lit("brand "), "product_id").alias("name")).alias("brand"),
        F.struct(F.lit("499").alias("price"), F.lit("INR").alias("priceCurrency")).alias("offers"),
        F.struct(F.lit("4.1").alias("ratingValue")).alias("aggregateRating"),
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("review_idx").alias("position"),
                    F.col("text").alias("reviewBody"),
                    F.struct(F.col("rating").alias("ratingValue")).alias("reviewRating"),
                )
            )
        ).alias("review"),
    )
    block = F.floor(F.col("review_idx") / (20 * per_page))
    return (
        r.groupBy("product_id", block.alias("block"))
        .agg(F.to_json(F.struct(*[ld.getField(n).alias(n) for n in ("@type", "name", "brand", "offers", "aggregateRating", "review")])).alias("ld"))
        .select(
            F.concat_ws("-", "product_id", "block").alias("page_id"),
            F.concat(F.lit("https://www.ajio.com/x/p/"), 100000 + F.col("block"), F.lit("_red")).alias("url"),
            F.concat(
                F.lit('<html><head><title>Shop</title><script type="application/ld+json">'),
                "ld",
                F.lit("</script></head><body></body></html>"),
            ).alias("html"),
        )
    )
