"""Review operators, scores, summaries, keywords, usage analytics, governance and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustgrain.operators import governance, keywords, models, reviews, scoring, summary, usage
from trustgrain.functions import crypto
from trustgrain.functions.text import TERM_STOP_WORDS
from trustgrain.plans import derive
from trustgrain.session import work_path, written
from trustgrain.sources import files
from trustgrain.sources.tables import load

from .base import REVIEWS_SQL, plain, query
from .scalars import BL, EL, LANG_SQL, NW, SHORT, WS  # noqa: F401

WITH = f"WITH {REVIEWS_SQL.strip()} "
AS_OF = f"TIMESTAMP '{derive.AS_OF}'"


def as_of():
    return F.lit(derive.AS_OF).cast("timestamp")


@query("load_tables", "SELECT l_returnflag, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag")
def load_tables(spark, d):
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))


# --- row-level review operators ---------------------------------------------------------------------------------


@query(
    "validate_reviews",
    f"""SELECT doc_id, CASE WHEN NOT regexp_matches(text, '{NW}') THEN 'Review text is required'
    WHEN length(text) NOT BETWEEN 10 AND 5000 THEN 'Review text must be between 10 and 5000 characters'
    WHEN NOT regexp_matches(url, '^https?://.') THEN 'URL must be http or https' END AS error
    FROM (SELECT doc_id, text, CASE WHEN MOD(doc_id, 4) = 0 THEN 'ftp://' || source ELSE 'https://' || source END AS url FROM documents)""",
)
def validate_reviews(spark, d):
    docs = load(spark, d, "documents").withColumn(
        "url", F.concat(F.when(F.col("doc_id") % 4 == 0, "ftp://").otherwise("https://"), F.col("source"))
    )
    return reviews.validate_reviews(docs, url="url").select("doc_id", "error")


@query(
    "mark_empty",
    SHORT
    + f"""SELECT review_idx, CASE WHEN blank THEN 'unknown' ELSE sentiment END AS sentiment, CASE WHEN blank THEN 0 ELSE confidence END AS confidence,
    CASE WHEN blank THEN 0 ELSE predicted_rating END AS predicted_rating, CASE WHEN blank THEN 0 ELSE ai_probability END AS ai_probability,
    CASE WHEN blank THEN 'Empty review text' END AS error FROM (SELECT *, NOT regexp_matches(text, '{NW}') AS blank FROM s)""",
)
def mark_empty(spark, d):
    marked = reviews.mark_empty(derive.short_reviews(spark, d))
    return marked.select("review_idx", "sentiment", "confidence", "predicted_rating", "ai_probability", "error")


@query(
    "filter_reviews",
    SHORT
    + f"""SELECT kind, COUNT(*) AS n, CAST(SUM(review_idx) AS BIGINT) AS ids FROM (
    SELECT 'all' AS kind, review_idx FROM s UNION ALL SELECT 'ai', review_idx FROM s WHERE ai_probability > 0.5
    UNION ALL SELECT 'positive', review_idx FROM s WHERE lower(coalesce(sentiment, '')) = 'positive'
    UNION ALL SELECT 'not blank', review_idx FROM s WHERE regexp_matches(text, '{NW}')
    UNION ALL SELECT 'no boilerplate', review_idx FROM s WHERE NOT regexp_matches(text, '[\\x{{2605}}\\x{{2606}}\\x{{2B50}}]')
      AND NOT regexp_matches(text, '(?i)Contact Us|About Us|Careers|Corporate Information|GROUP COMPANIES|Flipkart Stories|MAIL US|REGISTERED OFFICE|Become a Seller|Help Centre|Gift Cards|CONSUMER COMPLAINTS|Payments|Shipping|Cancellation|Returns')
      AND NOT regexp_matches(text, '(?i)^\\s*(Verified Purchase|Certified Buyer)')) GROUP BY kind""",
)
def filter_reviews(spark, d):
    s = derive.short_reviews(spark, d)
    parts = {
        "all": reviews.filter_reviews(s, "all"),
        "ai": reviews.filter_reviews(s, "ai"),
        "positive": reviews.filter_reviews(s, "positive"),
        "not blank": reviews.drop_blank(s),
        "no boilerplate": reviews.drop_boilerplate(s),
    }
    tagged = [df.select(F.lit(k).alias("kind"), "review_idx") for k, df in parts.items()]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.union(t)
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("review_idx").alias("ids"))


@query(
    "search",
    f"""SELECT id, email FROM ({plain(derive.CONTACT_MESSAGES)}) WHERE contains(lower(first_name), 'er') OR contains(lower(last_name), 'er')
    OR contains(lower(email), 'er') OR contains(lower(message), 'er')""",
)
def search(spark, d):
    found = reviews.search(derive.contact_messages(spark, d), "ER", ["first_name", "last_name", "email", "message"])
    return found.select("id", "email")


@query(
    "dedupe_reviews",
    SHORT
    + """SELECT product_id, review_idx, review_id, text FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id,
      CASE WHEN review_id <> '' THEN review_id END, CASE WHEN review_id = '' THEN regexp_replace(lower(text), '[^a-z0-9]', '', 'g') END,
      CASE WHEN review_id = '' THEN rating END ORDER BY page_no, review_idx) AS rn FROM s) WHERE rn = 1""",
)
def dedupe_reviews(spark, d):
    s = derive.short_reviews(spark, d).select("product_id", "review_idx", "review_id", "page_no", "rating", "text")
    kept = reviews.dedupe_reviews(s, ["page_no", "review_idx"], ["product_id"])
    return kept.select("product_id", "review_idx", "review_id", "text")


@query(
    "dedupe_documents",
    WITH
    + """SELECT MIN(review_idx) AS review_idx, lang FROM reviews GROUP BY lang, regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), rating""",
)
def dedupe_documents(spark, d):
    docs = derive.reviews(spark, d).withColumn("review_id", F.lit(""))
    return reviews.dedupe_reviews(docs, ["review_idx"], ["lang"]).select("review_idx", "lang")


@query(
    "page_yield",
    SHORT
    + """, k AS (SELECT product_id, page_no, ROW_NUMBER() OVER (PARTITION BY product_id, CASE WHEN review_id <> '' THEN review_id END,
      CASE WHEN review_id = '' THEN regexp_replace(lower(text), '[^a-z0-9]', '', 'g') END,
      CASE WHEN review_id = '' THEN rating END ORDER BY page_no, review_idx) AS rn FROM s)
    SELECT product_id, page_no, COUNT(*) AS found, COUNT(*) FILTER (rn = 1) AS fresh, COUNT(*) FILTER (rn > 1) AS repeated FROM k GROUP BY ALL""",
)
def page_yield(spark, d):
    s = derive.short_reviews(spark, d).select("product_id", "review_idx", "review_id", "page_no", "rating", "text")
    return reviews.page_yield(s, ["page_no", "review_idx"], ["product_id"])


@query(
    "drop_contained",
    r"""WITH p AS (SELECT page_id, i AS pos, ps[i] AS text, trim(lower(ps[i])) AS low FROM
      (SELECT page_id, regexp_extract_all(html, '<(?:p|li|a)[^>]*>([^<]*)<', 1) AS ps FROM pages), unnest(range(1, len(ps) + 1)) AS r(i))
    SELECT a.page_id, a.text, COUNT(*) AS n FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.page_id = a.page_id
      AND length(b.low) > length(a.low) AND contains(b.low, a.low)) GROUP BY ALL""",
)
def drop_contained(spark, d):
    pages = load(spark, d, "pages")
    found = F.transform(
        F.regexp_extract_all("html", F.lit("<(?:p|li|a)[^>]*>([^<]*)<"), F.lit(1)), lambda t: F.struct(t.alias("text"))
    )
    kept = pages.select("page_id", found.alias("found")).select("page_id", F.inline(reviews.drop_contained(F.col("found"))))
    return kept.groupBy("page_id", "text").agg(F.count(F.lit(1)).alias("n"))


@query(
    "top_reviews",
    WITH
    + """SELECT product_id, review_idx FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY confidence DESC, review_idx) AS rn FROM reviews) WHERE rn <= 10""",
)
def top_reviews(spark, d):
    r = derive.reviews(spark, d).select("product_id", "review_idx", "confidence")
    kept = reviews.max_reviews(r, ["product_id"], [F.desc("confidence"), F.asc("review_idx")], 10, ["review_idx"])
    return kept.select("product_id", "review_idx")


@query("languages", WITH + "SELECT product_id, array_to_string(list_sort(list(DISTINCT lang)), ', ') AS languages FROM reviews GROUP BY product_id")
def languages(spark, d):
    found = reviews.languages(derive.reviews(spark, d), ["product_id"], "lang")
    return found.select("product_id", F.array_join("languages", ", ").alias("languages"))


# --- scores ----------------------------------------------------------------------------------------------------

_MISMATCH = """CASE WHEN sentiment IS NULL THEN 50 WHEN lower(sentiment) = 'positive' THEN CASE WHEN predicted_rating <= 2 THEN 80 WHEN predicted_rating = 3 THEN 40 ELSE 0 END
  WHEN lower(sentiment) = 'negative' THEN CASE WHEN predicted_rating >= 4 THEN 80 WHEN predicted_rating = 3 THEN 40 ELSE 0 END
  WHEN lower(sentiment) = 'neutral' THEN CASE WHEN predicted_rating IN (1, 5) THEN 50 ELSE 10 END ELSE 30 END"""
_REVIEW_SCORE = f"""CAST(floor(least(100, greatest(0, ai_probability * 100 * 0.5::DOUBLE + (1 - confidence) * 100 * 0.2::DOUBLE + ({_MISMATCH}) * 0.3::DOUBLE)) + 0.5::DOUBLE) AS INTEGER)"""
_LINK_SCORE = "CAST(floor(least(100, greatest(0, ai_probability * 100 * 0.6::DOUBLE + (1 - confidence) * 100 * 0.4::DOUBLE)) + 0.5::DOUBLE) AS INTEGER)"
_LABEL = "CASE WHEN {0} <= 40 THEN 'Likely Genuine' WHEN {0} <= 70 THEN 'Suspicious' WHEN {0} > 70 THEN 'Highly Suspicious' END"


@query(
    "authenticity",
    SHORT
    + f"""SELECT review_idx, review_score, {_LABEL.format("review_score")} AS review_label, link_score, {_LABEL.format("link_score")} AS link_label
    FROM (SELECT review_idx, {_REVIEW_SCORE} AS review_score, {_LINK_SCORE} AS link_score FROM s)""",
)
def authenticity(spark, d):
    scored = derive.short_reviews(spark, d).select(
        "review_idx",
        scoring.authenticity("review").alias("review_score"),
        scoring.authenticity("link").alias("link_score"),
    )
    return scored.withColumns(
        {
            "review_label": scoring.authenticity_label(F.col("review_score")),
            "link_label": scoring.authenticity_label(F.col("link_score")),
        }
    )


_FUSE_IN = """SELECT review_idx, CASE WHEN MOD(review_idx, 5) = 0 THEN NULL ELSE sentiment END AS sentiment_label,
  CASE WHEN MOD(review_idx, 5) = 0 THEN NULL ELSE confidence END AS sentiment_conf,
  CASE WHEN MOD(review_idx, 7) = 0 THEN NULL ELSE CAST(predicted_rating AS STRING) END AS rating_label,
  CASE WHEN MOD(review_idx, 7) = 0 THEN NULL ELSE CAST(MOD(review_idx, 64) AS DOUBLE) / 64 END AS rating_conf,
  CASE MOD(review_idx, 3) WHEN 0 THEN NULL WHEN 1 THEN 'AI Generated' ELSE 'Human' END AS ai_label,
  CASE MOD(review_idx, 3) WHEN 0 THEN NULL ELSE CAST(MOD(review_idx, 128) AS DOUBLE) / 128 END AS ai_conf FROM {s}"""


_UNIT = "4611686018427387904"
_EXACT = f"CAST({{0}} // {_UNIT} + CASE WHEN {{0}} % {_UNIT} * 2 > {_UNIT} OR ({{0}} % {_UNIT} * 2 = {_UNIT} AND ({{0}} // {_UNIT}) % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 10000"


@query(
    "fuse_predictions",
    SHORT
    + f""", f AS ({plain(_FUSE_IN)}), g AS (SELECT review_idx, lower(coalesce(sentiment_label, 'neutral')) AS sentiment, coalesce(CAST(rating_label AS INTEGER), 3) AS predicted_rating,
      CAST(CAST((CASE WHEN ai_label IS NULL THEN 0.0::DOUBLE WHEN ai_label = 'AI Generated' THEN ai_conf ELSE 1 - ai_conf END) * 4611686018427387904 AS HUGEINT) * CAST(10000 AS HUGEINT) AS HUGEINT) AS a,
      CAST(CAST((coalesce(sentiment_conf, 0.5::DOUBLE) + coalesce(rating_conf, 0.5::DOUBLE) + coalesce(ai_conf, 0.5::DOUBLE)) / 3 * 4611686018427387904 AS HUGEINT) * CAST(10000 AS HUGEINT) AS HUGEINT) AS c FROM f)
    SELECT review_idx, sentiment, predicted_rating, {_EXACT.format("a")} AS ai_probability, {_EXACT.format("c")} AS confidence FROM g""",
)
def fuse_predictions(spark, d):
    rows = spark.sql(_FUSE_IN, s=derive.short_reviews(spark, d))
    return scoring.fuse(rows).select("review_idx", "sentiment", "predicted_rating", "ai_probability", "confidence")


@query("score_reviews")
def score_reviews(spark, d):
    """Two classifiers trained on the labelled documents and applied to all documents, whose terms are counted once."""
    docs = models.term_counts(load(spark, d, "documents").select("doc_id", "text"))
    labelled = written(docs.join(load(spark, d, "labels"), "doc_id"), "labelled")
    ai = models.fit_classifier(labelled, "toxic")
    good = models.fit_classifier(labelled, "quality")
    scored = models.classify(ai, docs, ["Human", "AI Generated"], "ai")
    scored = models.classify(good, scored, ["negative", "positive"], "sentiment")
    scored = scored.withColumns({"rating_label": F.lit(None).cast("string"), "rating_conf": F.lit(None).cast("double")})
    return scoring.fuse(scored).select("doc_id", "sentiment", "predicted_rating", "ai_probability", "confidence")


@query(
    "rate_reviews",
    """SELECT COUNT(*) AS n, COUNT(quality) AS n_labelled, TRUE AS stars, TRUE AS spread, TRUE AS within_one, TRUE AS sure FROM documents LEFT JOIN labels USING (doc_id)""",
)
def rate_reviews(spark, d):
    """Stars by an ordinal model. Labelled documents give 1 or 2 stars where they are bad, 4 or 5 where they are good, fewer
    where they are toxic; every third is kept from training and must be rated right to within one star eight times in ten."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    marks = load(spark, d, "labels").filter("quality IS NOT NULL AND toxic IS NOT NULL")
    stars = marks.select("doc_id", "quality", F.expr("CASE WHEN quality = 1 THEN 5 - toxic ELSE 2 - toxic END").alias("rating"))
    held_out = F.col("doc_id") % 3 == 1
    model = models.fit_rating(docs.join(stars.filter(~held_out), "doc_id"))
    rated = models.rate(model, docs).join(stars, "doc_id", "left")
    fused = rated.withColumns({"sentiment_label": F.lit(None).cast("string"), "sentiment_conf": F.lit(None).cast("double")})
    fused = scoring.fuse(fused.withColumns({"ai_label": F.lit(None).cast("string"), "ai_conf": F.lit(None).cast("double")}))
    tested = F.col("rating").isNotNull() & held_out
    close = F.avg(F.when(tested, (F.abs(F.col("predicted_rating") - F.col("rating")) <= 1).cast("int")))
    return fused.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("quality").alias("n_labelled"),
        F.every(F.col("predicted_rating").between(1, 5)).alias("stars"),
        (F.countDistinct("predicted_rating") > 1).alias("spread"),
        (close >= 0.8).alias("within_one"),
        F.every(F.col("rating_conf").between(0.2, 1.0)).alias("sure"),
    )


def _length_model_of(refused):
    """A stand-in model with a rule that SQL can repeat: long texts are positive; texts with ``refused`` in them fail."""

    def load_model():
        def predict(texts):
            if refused and any(refused in t for t in texts):
                raise ValueError("dollar sign")
            return [("POSITIVE" if len(t) > 500 else "NEGATIVE", 0.75) for t in texts]

        return predict

    return load_model


@query(
    "score_with_model",
    """SELECT doc_id, CASE WHEN NOT contains(text, '$') THEN CASE WHEN length(text) > 500 THEN 'POSITIVE' ELSE 'NEGATIVE' END END AS sentiment_label,
    CASE WHEN NOT contains(text, '$') THEN 0.75::DOUBLE END AS sentiment_conf, CASE WHEN contains(text, '$') THEN 'dollar sign' END AS error FROM documents""",
)
def score_with_model(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "text")
    return scoring.score(docs, {"sentiment": _length_model_of("$")}).select("doc_id", "sentiment_label", "sentiment_conf", "error")


# --- summaries and keywords ------------------------------------------------------------------------------------

_R1 = "floor(({0}) * 10.0::DOUBLE + 0.5::DOUBLE) / 10"


@query(
    "product_summary",
    WITH
    + f""", x AS (SELECT *, {_LINK_SCORE} AS authenticity_score FROM reviews)
    SELECT product_id, COUNT(*) AS total_reviews, {_R1.format("COUNT(*) FILTER (sentiment = 'positive') / COUNT(*) * 100")} AS positive_percentage,
      {_R1.format("COUNT(*) FILTER (sentiment = 'negative') / COUNT(*) * 100")} AS negative_percentage,
      {_R1.format("COUNT(*) FILTER (sentiment = 'neutral') / COUNT(*) * 100")} AS neutral_percentage,
      {_R1.format("AVG(predicted_rating)")} AS average_predicted_rating, {_R1.format("AVG(ai_probability) * 100")} AS ai_generated_percentage,
      {_R1.format("AVG(authenticity_score)")} AS average_authenticity_score, {_LABEL.format("AVG(authenticity_score)")} AS authenticity_label,
      array_to_string(list_sort(list(DISTINCT lang)), ', ') AS languages_detected FROM x GROUP BY product_id""",
)
def product_summary(spark, d):
    r = derive.reviews(spark, d).withColumn("language", F.col("lang"))
    scored = r.withColumn("authenticity_score", scoring.authenticity("link"))
    return summary.product_summary(scored).withColumn("languages_detected", F.array_join("languages_detected", ", "))


RECURSIVE = WITH.replace("WITH", "WITH RECURSIVE", 1)
_STOP = ", ".join(f"'{w}'" for w in TERM_STOP_WORDS)
KEYWORD_CTE = f"""
kw AS (SELECT product_id, review_idx, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP})) AS ws FROM src
  WHERE regexp_matches(text, '{NW}')),
ku AS (SELECT product_id, review_idx, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM kw),
kq AS (SELECT product_id, w AS p1, w || ' ' || lead(w, 1) OVER r AS p2, w || ' ' || lead(w, 1) OVER r || ' ' || lead(w, 2) OVER r AS p3
  FROM ku WINDOW r AS (PARTITION BY product_id, review_idx ORDER BY pos)),
kg AS (SELECT product_id, 1 AS n, p1 AS phrase FROM kq UNION ALL SELECT product_id, 2, p2 FROM kq WHERE p2 IS NOT NULL
  UNION ALL SELECT product_id, 3, p3 FROM kq WHERE p3 IS NOT NULL),
kc AS (SELECT product_id, n, phrase, COUNT(*) AS uses FROM kg GROUP BY ALL),
kd AS (SELECT n, phrase, COUNT(*) AS products_with FROM kc GROUP BY ALL),
km AS (SELECT product_id, MAX(uses) AS most FROM kc GROUP BY ALL),
ks AS (SELECT product_id, n, phrase, round(uses / CAST(most AS DOUBLE) * (ln(((SELECT COUNT(DISTINCT product_id) FROM kc) + 1) / CAST(products_with + 1 AS DOUBLE)) + 1), 4) AS score
  FROM kc JOIN kd USING (n, phrase) JOIN km USING (product_id)),
k1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY score DESC, phrase) AS rn FROM ks WHERE n IN (1, 2)),
k2 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY score DESC, phrase) AS rn FROM ks WHERE n IN (2, 3)),
kz AS (SELECT product_id, 1 AS pass, 15 AS keep, phrase, score, rn, list_distinct(string_split(phrase, ' ')) AS ws FROM k1 WHERE rn <= 20
  UNION ALL SELECT product_id, 2, 10, phrase, score, rn, list_distinct(string_split(phrase, ' ')) FROM k2 WHERE rn <= 15),
ky AS (SELECT product_id, pass, MAX(rn) AS c, MAX(rn) - ANY_VALUE(keep) AS m FROM kz GROUP BY ALL HAVING MAX(rn) > ANY_VALUE(keep)),
kpair AS (SELECT a.product_id, a.pass, a.rn AS i, b.rn AS j, CASE WHEN a.rn = b.rn THEN 0 ELSE
    CAST(floor(1000000 * (len(list_intersect(a.ws, b.ws)) / sqrt(len(a.ws) * len(b.ws)))) AS BIGINT) END AS alike
  FROM kz a JOIN kz b ON a.product_id = b.product_id AND a.pass = b.pass),
krow AS (SELECT product_id, pass, i, SUM(alike) AS total FROM kpair GROUP BY ALL),
kmat AS (SELECT product_id, pass, c, m, (SELECT list(alike ORDER BY i, j) FROM kpair p WHERE p.product_id = y.product_id AND p.pass = y.pass) AS mat,
  (SELECT list(CAST(total AS BIGINT) ORDER BY i) FROM krow p WHERE p.product_id = y.product_id AND p.pass = y.pass) AS totals FROM ky y),
kway AS (SELECT product_id, pass, c, m, mat, totals, CAST([] AS BIGINT[]) AS gone, CAST(0 AS BIGINT) AS saved, CAST(0 AS BIGINT) AS upto FROM kmat
  UNION ALL SELECT product_id, pass, c, m, mat, totals, list_append(gone, r),
    saved + totals[r] - coalesce(CAST(list_sum(list_transform(gone, lambda g: mat[(g - 1) * c + r])) AS BIGINT), 0), r
  FROM kway, range(1, 21) AS t(r) WHERE r > upto AND r <= c AND len(gone) < m),
kbest AS (SELECT product_id, pass, gone FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id, pass ORDER BY saved DESC, gone DESC) AS best FROM kway WHERE len(gone) = m) WHERE best = 1),
kx AS (SELECT product_id, phrase AS keyword, MAX(score) AS score FROM kz LEFT JOIN kbest USING (product_id, pass)
  WHERE gone IS NULL OR NOT list_contains(gone, rn) GROUP BY ALL),
kk AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY score DESC, keyword) AS INTEGER) AS keyword_rank FROM kx),
kf AS (SELECT * FROM kk WHERE keyword_rank <= 15)
"""


@query("keywords", RECURSIVE + ", src AS (SELECT * FROM reviews), " + KEYWORD_CTE + " SELECT product_id, keyword, score, keyword_rank FROM kf")
def keyword_list(spark, d):
    return keywords.keywords(derive.reviews(spark, d))


@query(
    "keyword_counts",
    WITH + f"SELECT product_id, CAST(SUM(len(regexp_extract_all(text, '{NW}+'))) AS BIGINT) AS word_count, COUNT(*) AS review_count FROM reviews WHERE regexp_matches(text, '{NW}') GROUP BY product_id",
)
def keyword_counts(spark, d):
    return keywords.keyword_counts(derive.reviews(spark, d))


_TOPIC_ROWS = ", ".join(f"({i}, '{t}', '{w}')" for i, (t, ws) in enumerate(keywords.TOPICS.items()) for w in dict.fromkeys(ws))


@query(
    "topics",
    SHORT.replace("WITH", "WITH RECURSIVE", 1)
    + ", src AS (SELECT *, review_idx AS item FROM s), "
    + KEYWORD_CTE.replace("product_id", "item")
    + f""", tt AS (SELECT DISTINCT item, topic_no, topic, keyword, keyword_rank FROM kf, (VALUES {_TOPIC_ROWS}) AS v(topic_no, topic, word) WHERE contains(keyword, word)),
    tc AS (SELECT item, topic_no, topic, COUNT(*) AS count, list(keyword ORDER BY keyword_rank)[1:3] AS ks FROM tt GROUP BY ALL)
    SELECT item, topic, count, array_to_string(ks, '|') AS keywords, CAST(topic_rank AS INTEGER) AS topic_rank FROM
      (SELECT *, ROW_NUMBER() OVER (PARTITION BY item ORDER BY count DESC, topic_no) AS topic_rank FROM tc) WHERE topic_rank <= 5""",
)
def topics(spark, d):
    found = keywords.topics(keywords.keywords(derive.short_reviews(spark, d).withColumn("item", F.col("review_idx")), "item"), "item")
    return found.withColumn("keywords", F.array_join("keywords", "|"))


# --- usage -----------------------------------------------------------------------------------------------------

METRICS = """(SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN 'PRODUCT_LINK' ELSE 'INDIVIDUAL_REVIEW' END AS analysis_type,
  event_type IN ('purchase', 'signup') AS authenticated, user_id, CASE WHEN MOD(user_id, 5) = 0 THEN NULL WHEN MOD(user_id, 2) = 0 THEN 'en' ELSE 'fr' END AS detected_language,
  CASE WHEN event_type = 'purchase' THEN 'shop' || MOD(user_id, 7) || '.example' END AS domain, ts AS created_at FROM events)"""
VISITS = """(SELECT event_id AS id, '/' || event_type AS endpoint, event_type IN ('purchase', 'signup') AS authenticated, 'ip' || user_id AS ip_address, user_id,
  CAST(floor(value) AS BIGINT) AS response_time_ms, ts AS created_at FROM events)"""
USERS = """(SELECT c_custkey AS user_id, lower(replace(c_name, '#', '.')) || '@mail.example' AS email, c_name AS full_name,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'ADMIN' ELSE 'USER' END AS role, c_acctbal >= 0 AS enabled,
  make_timestamp((1700000000 + MOD(c_custkey * 37, 1000003)) * 1000000) AS created_at FROM customer)"""


@query(
    "usage_metrics",
    f"""SELECT COUNT(*) AS total_analyses, COUNT(*) FILTER (authenticated) AS by_authenticated, COUNT(*) FILTER (NOT authenticated) AS by_anonymous,
    COUNT(*) FILTER (analysis_type = 'INDIVIDUAL_REVIEW') AS individual_reviews, COUNT(*) FILTER (analysis_type = 'PRODUCT_LINK') AS link_analyses FROM {METRICS}""",
)
def usage_metrics(spark, d):
    return usage.usage_metrics(derive.analysis_metrics(spark, d))


@query(
    "distributions",
    f"""SELECT 'language' AS what, detected_language AS value, COUNT(*) AS count FROM {METRICS} WHERE detected_language IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'domain', domain, COUNT(*) FROM {METRICS} WHERE domain IS NOT NULL GROUP BY ALL
    UNION ALL SELECT 'link domain', substring(o_orderpriority, 1, 1) || '.example', COUNT(*) FROM orders GROUP BY ALL""",
)
def distributions(spark, d):
    m = derive.analysis_metrics(spark, d)
    named = lambda df, what, c: df.select(F.lit(what).alias("what"), F.col(c).alias("value"), "count")
    return (
        named(usage.distribution(m, "detected_language"), "language", "detected_language")
        .union(named(usage.distribution(m, "domain"), "domain", "domain"))
        .union(named(usage.distribution(derive.link_analyses(spark, d), "domain"), "link domain", "domain"))
    )


@query(
    "rolling_counts",
    f"""SELECT COUNT(*) AS total, COUNT(*) FILTER (created_at > {AS_OF} - INTERVAL 24 HOURS) AS last_24_hours, COUNT(*) FILTER (created_at > {AS_OF} - INTERVAL 7 DAYS) AS last_7_days,
    COUNT(*) FILTER (created_at > {AS_OF} - INTERVAL 30 DAYS) AS last_30_days, COUNT(*) FILTER (analysis_type = 'INDIVIDUAL_REVIEW') AS individual_reviews,
    COUNT(*) FILTER (analysis_type = 'PRODUCT_LINK') AS link_analyses FROM {METRICS}""",
)
def rolling_counts(spark, d):
    return usage.rolling_counts(derive.analysis_metrics(spark, d), as_of())


@query(
    "since",
    f"""SELECT 'strict' AS edge, COUNT(*) AS n FROM {METRICS} WHERE created_at > {AS_OF} - INTERVAL 7 DAYS
    UNION ALL SELECT 'inclusive', COUNT(*) FROM {VISITS} WHERE created_at >= {AS_OF} - INTERVAL 7 DAYS""",
)
def since(spark, d):
    strict = reviews.since(derive.analysis_metrics(spark, d), "created_at", as_of(), "7 DAYS", inclusive=False)
    loose = reviews.since(derive.site_visits(spark, d), "created_at", as_of(), "7 DAYS", inclusive=True)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("edge"), "n")
    return count(strict, "strict").union(count(loose, "inclusive"))


@query(
    "visit_metrics",
    f"""SELECT COUNT(*) AS total_visits, COUNT(*) FILTER (created_at >= {AS_OF} - INTERVAL 24 HOURS) AS visits_last_24_hours, COUNT(*) FILTER (created_at >= {AS_OF} - INTERVAL 7 DAYS) AS visits_last_7_days,
    COUNT(*) FILTER (created_at >= {AS_OF} - INTERVAL 30 DAYS) AS visits_last_30_days, COUNT(*) FILTER (authenticated) AS authenticated_visits, COUNT(*) FILTER (NOT authenticated) AS anonymous_visits,
    COUNT(DISTINCT ip_address) FILTER (created_at >= {AS_OF} - INTERVAL 24 HOURS) AS unique_last_24_hours, COUNT(DISTINCT ip_address) FILTER (created_at >= {AS_OF} - INTERVAL 7 DAYS) AS unique_last_7_days FROM {VISITS}""",
)
def visit_metrics(spark, d):
    return usage.visit_metrics(derive.site_visits(spark, d), as_of())


@query("visit_metrics_approximate")
def visit_metrics_approximate(spark, d):
    return usage.visit_metrics(derive.site_visits(spark, d), as_of(), approximate=True)


@query(
    "simple_counts",
    f"""SELECT users, admins, enabled, total, from_users, anonymous, this_week FROM
    (SELECT COUNT(*) AS users, COUNT(*) FILTER (role = 'ADMIN') AS admins, COUNT(*) FILTER (enabled) AS enabled FROM {USERS}) u,
    (SELECT COUNT(*) AS total, COUNT(*) FILTER (user_id IS NOT NULL) AS from_users, COUNT(*) FILTER (user_id IS NULL) AS anonymous,
      COUNT(*) FILTER (created_at >= {AS_OF} - INTERVAL 7 DAYS) AS this_week FROM ({plain(derive.CONTACT_MESSAGES)})) m""",
)
def simple_counts(spark, d):
    users = usage.user_counts(derive.users(spark, d)).withColumn("one", F.lit(1))
    messages = usage.message_counts(derive.contact_messages(spark, d), as_of()).withColumn("one", F.lit(1))
    return users.join(messages, "one").drop("one")


TOKENS = f"({plain(derive.REFRESH_TOKENS)})"
TOKEN_AS_OF = "1998-01-01 00:00:00"


@query("active_tokens", f"SELECT user_id, COUNT(*) FILTER (NOT revoked AND expires_at > TIMESTAMP '{TOKEN_AS_OF}') AS active_tokens FROM {TOKENS} GROUP BY user_id")
def active_tokens(spark, d):
    return usage.active_tokens(derive.refresh_tokens(spark, d), F.lit(TOKEN_AS_OF).cast("timestamp"))


ANALYSES = """(SELECT 'r-' || l_orderkey || '-' || l_linenumber AS id, l_suppkey AS user_id, CASE l_returnflag WHEN 'A' THEN 'positive' WHEN 'R' THEN 'negative' ELSE 'neutral' END AS sentiment,
  CAST(1 + MOD(l_linenumber, 5) AS INTEGER) AS predicted_rating, l_discount AS ai_probability, CAST(trunc(l_quantity * 2) AS INTEGER) AS authenticity_score, l_shipdate AS created_at FROM lineitem)"""
LINKS = """(SELECT 'l-' || o_orderkey AS id, o_custkey AS user_id, substring(o_orderpriority, 1, 1) || '.example' AS domain, CAST(floor(o_totalprice / 1000) AS INTEGER) AS total_reviews, o_orderdate AS created_at FROM orders)"""


@query(
    "users_with_activity",
    f"""SELECT u.user_id, u.email, coalesce(r.n, 0) + coalesce(l.n, 0) AS total_analyses FROM {USERS} u
    LEFT JOIN (SELECT user_id, COUNT(*) AS n FROM {ANALYSES} GROUP BY ALL) r USING (user_id) LEFT JOIN (SELECT user_id, COUNT(*) AS n FROM {LINKS} GROUP BY ALL) l USING (user_id)""",
)
def users_with_activity(spark, d):
    found = usage.users_with_activity(derive.users(spark, d), derive.review_analyses(spark, d), derive.link_analyses(spark, d))
    return found.select("user_id", "email", "total_analyses")


@query("analyses_with_user", f"SELECT id, user_id, email, role FROM {LINKS} JOIN (SELECT user_id, email, role FROM {USERS}) USING (user_id)")
def analyses_with_user(spark, d):
    return usage.with_user(derive.link_analyses(spark, d), derive.users(spark, d), ["email", "role"]).select("id", "user_id", "email", "role")


@query("paged_users", f"SELECT user_id, email, created_at FROM {USERS} ORDER BY created_at DESC, user_id OFFSET 40 LIMIT 20")
def paged_users(spark, d):
    page = usage.paginate(derive.users(spark, d), 2, 20, [F.desc("created_at"), F.asc("user_id")])
    return page.select("user_id", "email", "created_at")


@query("deep_page", f"SELECT user_id, email, created_at FROM {USERS} ORDER BY created_at DESC, user_id OFFSET 100 LIMIT 25")
def deep_page(spark, d):
    order = [F.desc("created_at"), F.asc("user_id")]
    index = usage.PageIndex(derive.users(spark, d), order, work_path(spark, "listing"), rows_per_part=60)
    return index.page(4, 25).select("user_id", "email", "created_at")


@query(
    "page_info",
    f"SELECT 2 AS page, 20 AS size, COUNT(*) AS total_elements, CAST(ceil(COUNT(*) / 20) AS INTEGER) AS total_pages, 2 >= ceil(COUNT(*) / 20) - 1 AS last FROM {USERS}",
)
def page_info(spark, d):
    return usage.page_info(derive.users(spark, d), 2, 20)


@query("messages_newest_first", f"SELECT id, email, created_at FROM ({plain(derive.CONTACT_MESSAGES)}) ORDER BY created_at DESC, id")
def messages_newest_first(spark, d):
    return usage.newest_first(derive.contact_messages(spark, d)).select("id", "email", "created_at")


@query(
    "history",
    f"""SELECT id, user_id, 'INDIVIDUAL_REVIEW' AS analysis_type, sentiment, authenticity_score, {_LABEL.format("authenticity_score")} AS authenticity_label, NULL AS domain, NULL AS total_reviews, created_at FROM {ANALYSES}
    UNION ALL SELECT id, user_id, 'PRODUCT_LINK', NULL, NULL, NULL, domain, total_reviews, created_at FROM {LINKS}""",
)
def history(spark, d):
    both = usage.history(derive.review_analyses(spark, d), derive.link_analyses(spark, d))
    return both.select("id", "user_id", "analysis_type", "sentiment", "authenticity_score", "authenticity_label", "domain", "total_reviews", "created_at")


@query(
    "user_history",
    f"""SELECT * FROM (SELECT id, 'INDIVIDUAL_REVIEW' AS analysis_type, sentiment, authenticity_score, NULL AS domain, 'text of ' || id AS review_text, created_at FROM {ANALYSES} WHERE user_id = 7
    UNION ALL SELECT id, 'PRODUCT_LINK', NULL, NULL, domain, NULL, created_at FROM {LINKS} WHERE user_id = 7) ORDER BY created_at DESC, analysis_type, id LIMIT 20 OFFSET 20""",
)
def user_history(spark, d):
    reviews = derive.review_analyses(spark, d)
    sealed = reviews.withColumn("review_text", crypto.encrypt(F.concat(F.lit("text of "), "id"), "a secret"))
    page = usage.user_history(sealed, derive.link_analyses(spark, d), 7, page=1, size=20, secret="a secret")
    return page.select("id", "analysis_type", "sentiment", "authenticity_score", "domain", "review_text", "created_at")


# --- governance ------------------------------------------------------------------------------------------------


@query(
    "insert_if_absent",
    """SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey + 50, s_name FROM supplier WHERE s_suppkey + 50 NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)""",
)
def insert_if_absent(spark, d):
    old = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    parts = load(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    more = load(spark, d, "supplier").select((F.col("s_suppkey") + 50).alias("id"), F.col("s_name").alias("name"))
    return governance.insert_if_absent(old, more.union(parts), ["id"])


@query(
    "update_where",
    f"SELECT user_id, CASE WHEN NOT enabled THEN 'BLOCKED' ELSE role END AS role, CASE WHEN NOT enabled THEN lower(full_name) ELSE full_name END AS full_name FROM {USERS}",
)
def update_where(spark, d):
    changed = governance.update_where(
        derive.users(spark, d), ~F.col("enabled"), {"role": F.lit("BLOCKED"), "full_name": F.lower("full_name")}
    )
    return changed.select("user_id", "role", "full_name")


@query("revoke_tokens", f"SELECT token_id, revoked OR user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS revoked FROM {TOKENS}")
def revoke_tokens(spark, d):
    gone = derive.users(spark, d).filter(~F.col("enabled")).select("user_id")
    return governance.revoke_tokens(derive.refresh_tokens(spark, d), gone).select("token_id", "revoked")


@query("purge_tokens", f"SELECT token_id, expires_at FROM {TOKENS} WHERE NOT (expires_at < TIMESTAMP '{TOKEN_AS_OF}' OR revoked)")
def purge_tokens(spark, d):
    kept = governance.purge_tokens(derive.refresh_tokens(spark, d), F.lit(TOKEN_AS_OF).cast("timestamp"))
    return kept.select("token_id", "expires_at")


@query(
    "erase_users",
    f"""WITH g AS (SELECT c_custkey AS user_id FROM customer WHERE c_acctbal < 0) SELECT 'reviews' AS name, COUNT(*) AS n FROM {ANALYSES} WHERE user_id NOT IN (SELECT user_id FROM g)
    UNION ALL SELECT 'links', COUNT(*) FROM {LINKS} WHERE user_id NOT IN (SELECT user_id FROM g) UNION ALL SELECT 'users', COUNT(*) FROM {USERS} WHERE user_id NOT IN (SELECT user_id FROM g)""",
)
def erase_users(spark, d):
    users = derive.users(spark, d)
    tables = {"reviews": derive.review_analyses(spark, d), "links": derive.link_analyses(spark, d), "users": users}
    left = governance.erase_users(tables, users.filter(~F.col("enabled")))
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("name"), "n") for k, df in left.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query(
    "erase_by_file",
    f"""SELECT user_id, COUNT(*) AS n FROM {ANALYSES} WHERE user_id NOT IN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_suppkey % 5 = 0 AND l_suppkey < 30) GROUP BY ALL""",
)
def erase_by_file(spark, d):
    analyses = derive.review_analyses(spark, d)
    table = governance.UserFiles.create(analyses, work_path(spark, "analyses"))
    erased = analyses.filter((F.col("user_id") % 5 == 0) & (F.col("user_id") < 30)).select("user_id").distinct()
    table.drop_replaced(table.erase(erased))
    return table.read().groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


_SUMMARY_REQ = """SELECT p_partkey AS user_id, concat(' https://www.', lower(replace(p_name, ' ', '-')), '.example/p/', CAST(p_partkey AS STRING), ' ') AS product_url,
  CASE WHEN MOD(p_partkey, 4) = 0 THEN NULL ELSE p_size END AS total_reviews, CASE WHEN MOD(p_partkey, 3) = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) / 2 END AS positive_percentage,
  CAST(p_size AS DOUBLE) AS negative_percentage, CAST(NULL AS DOUBLE) AS neutral_percentage, CAST(p_size AS DOUBLE) / 10 AS average_predicted_rating, CAST(1 AS DOUBLE) AS ai_generated_percentage,
  CASE MOD(p_partkey, 3) WHEN 0 THEN NULL WHEN 1 THEN 'en' ELSE 'en, fr' END AS languages_detected FROM {part}"""


@query(
    "save_summary",
    f"""SELECT user_id, trim(product_url) AS product_url, regexp_extract(trim(product_url), '^https://www\\.([^/]*)', 1) AS domain, coalesce(total_reviews, 0) AS total_reviews,
    coalesce(positive_percentage, 0) AS positive_percentage, negative_percentage, coalesce(neutral_percentage, 0) AS neutral_percentage, average_predicted_rating, ai_generated_percentage,
    coalesce(languages_detected, '') AS languages_detected FROM ({plain(_SUMMARY_REQ)})""",
)
def save_summary(spark, d):
    return governance.save_summary(spark.sql(_SUMMARY_REQ, part=load(spark, d, "part")))


# --- files -----------------------------------------------------------------------------------------------------

_PLAIN = "CASE WHEN rating = round(rating) THEN CAST(CAST(rating AS INTEGER) AS VARCHAR) ELSE CAST(rating AS VARCHAR) END"


@query("reviews_csv_round_trip", SHORT + "SELECT text, rating, date_raw FROM s")
def reviews_csv_round_trip(spark, d):
    path = work_path(spark, "reviews-csv")
    files.write_reviews_csv(derive.short_reviews(spark, d), path)
    return files.read_reviews_csv(spark, path)


@query("raw_csv_rows", WITH + f"SELECT text AS review_text, {_PLAIN.replace('rating', 'r')} AS rating, CAST(review_date AS VARCHAR) AS date FROM (SELECT *, rating + confidence AS r FROM reviews)")
def raw_csv_rows(spark, d):
    r = derive.reviews(spark, d)
    return files.raw_csv_rows(
        r.withColumn("rating", F.col("rating") + F.col("confidence")).withColumn("date_raw", F.col("review_date").cast("string"))
    )


@query(
    "analysis_csv_rows",
    WITH
    + f"""SELECT text, {_PLAIN} AS rating, sentiment, printf('%.3f', confidence) AS confidence, predicted_rating, printf('%.3f', ai_probability) AS ai_probability,
    printf('%.1f', CAST({_LINK_SCORE} AS DOUBLE)) AS authenticity FROM reviews""",
)
def analysis_csv_rows(spark, d):
    scored = derive.reviews(spark, d).withColumn("authenticity_score", scoring.authenticity("link"))
    return files.analysis_csv_rows(scored)


@query("reviews_json_source", WITH + "SELECT product_id, review_idx - first AS review_idx, text, rating FROM (SELECT *, 0 AS first FROM reviews)")
def reviews_json_source(spark, d):
    path = work_path(spark, "reviews-json")
    r = derive.reviews(spark, d)
    body = F.array(F.struct("text", "rating", F.col("review_date").cast("string").alias("date")))
    r.select(F.concat_ws("#", "product_id", "review_idx").alias("product_id"), body.alias("reviews")).write.json(path)
    back = files.read_reviews_json(spark, path)
    return back.select(
        F.split_part("product_id", F.lit("#"), F.lit(1)).alias("product_id"),
        (F.split_part("product_id", F.lit("#"), F.lit(2)).cast("long") + F.col("review_idx")).alias("review_idx"),
        "text",
        "rating",
    )


@query(
    "reviews_json_bodies",
    WITH
    + """SELECT product_id, CAST(ROW_NUMBER() OVER (PARTITION BY product_id, FLOOR(review_idx / 100) ORDER BY review_idx) - 1 AS BIGINT) AS review_idx, text, rating,
    CAST(review_date AS VARCHAR) AS date_raw FROM reviews""",
)
def reviews_json_bodies(spark, d):
    """Request bodies with several reviews each."""
    path = work_path(spark, "reviews-json")
    item = F.struct("review_idx", "text", "rating", F.col("review_date").cast("string").alias("date"))
    bodies = derive.reviews(spark, d).groupBy("product_id", F.floor(F.col("review_idx") / 100)).agg(F.array_sort(F.collect_list(item)).alias("reviews"))
    bodies.select("product_id", F.transform("reviews", lambda r: r.dropFields("review_idx")).alias("reviews")).write.json(path)
    return files.read_reviews_json(spark, path).select("product_id", "review_idx", "text", "rating", "date_raw")


@query(
    "analysis_csv_file",
    WITH
    + f"""SELECT sentiment, {_PLAIN} AS rating, printf('%.3f', confidence) AS confidence, predicted_rating, printf('%.3f', ai_probability) AS ai_probability,
    printf('%.1f', CAST({_LINK_SCORE} AS DOUBLE)) AS authenticity, CAST(length(text) AS INTEGER) AS n_chars FROM reviews WHERE text <> ''""",
)
def analysis_csv_file(spark, d):
    """An analysis export, written and read as any reader of quoted CSV does."""
    path = work_path(spark, "analysis-csv")
    scored = derive.reviews(spark, d).filter("text <> ''").withColumn("authenticity_score", scoring.authenticity("link"))
    files.write_analysis_csv(scored, path)
    back = spark.read.schema(
        "text string, rating string, sentiment string, confidence string, predicted_rating int, ai_probability string, authenticity string"
    ).options(**files.CSV, multiLine=True).csv(path)
    return back.withColumn("n_chars", F.length("text")).drop("text")


@query("visit_rows", "SELECT event_id AS id, substring('/' || event_type, 1, 4) AS endpoint, substring('ip' || user_id, 1, 3) AS ip_address FROM events")
def visit_rows(spark, d):
    rows = files.visit_rows(derive.site_visits(spark, d), {"endpoint": 4, "ip_address": 3})
    return rows.select("id", "endpoint", "ip_address")


@query(
    "append_events",
    f"""SELECT domain, detected_language, COUNT(*) AS n FROM (SELECT regexp_extract(trim(product_url), '^https://www\\.([^/]*)', 1) AS domain,
      unnest(string_split(languages_detected, ', ')) AS detected_language FROM ({plain(_SUMMARY_REQ)}) WHERE languages_detected <> '') GROUP BY ALL""",
)
def append_events(spark, d):
    saved = governance.save_summary(spark.sql(_SUMMARY_REQ, part=load(spark, d, "part"))).filter("languages_detected <> ''")
    events = governance.summary_events(saved).withColumn("created_at", as_of())
    path = work_path(spark, "events")
    files.append_events(events.filter(F.col("user_id") % 2 == 0), path)
    files.append_events(events.filter(F.col("user_id") % 2 == 1), path)
    return spark.read.parquet(path).groupBy("domain", "detected_language").agg(F.count(F.lit(1)).alias("n"))

