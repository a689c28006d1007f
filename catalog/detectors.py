"""Per-product detectors and the trust report."""

from __future__ import annotations

from trustgrain.functions.text import PHRASE_STOP_WORDS, TERM_STOP_WORDS
from trustgrain.operators import bursts, duplicates, phrases, ratings, similarity
from trustgrain.plans import derive, report
from trustgrain.session import DICTIONARY, ROW_GROUP, written

from .base import ORACLES, REVIEWS_SQL, query

PCT = "CAST(CAST(round_even({0} * 100.0::DOUBLE, 0) AS BIGINT) AS VARCHAR) || '%'"

RATING_CTE = f"""
rc AS (SELECT product_id,
    COUNT(*) FILTER (trunc(rating) = 1) AS r1, COUNT(*) FILTER (trunc(rating) = 2) AS r2,
    COUNT(*) FILTER (trunc(rating) = 3) AS r3, COUNT(*) FILTER (trunc(rating) = 4) AS r4,
    COUNT(*) FILTER (trunc(rating) = 5) AS r5 FROM reviews GROUP BY product_id),
rf AS (SELECT *, CAST(r1+r2+r3+r4+r5 AS DOUBLE) AS t FROM rc),
rg AS (SELECT *, r1/t AS f1, r2/t AS f2, r3/t AS f3, r4/t AS f4, r5/t AS f5 FROM rf),
rh AS (SELECT *, f1 + f5 AS ends, greatest(f1, f2, f3, f4, f5) AS top,
    sqrt((pow(f1-0.2::DOUBLE,2)+pow(f2-0.2::DOUBLE,2)+pow(f3-0.2::DOUBLE,2)+pow(f4-0.2::DOUBLE,2)
      +pow(f5-0.2::DOUBLE,2))/5) AS spread FROM rg),
ri AS (SELECT *, CASE WHEN t < 5 THEN 'few' WHEN ends > 0.7::DOUBLE AND f1 > 0.15::DOUBLE AND f5 > 0.15::DOUBLE
      THEN 'bimodal' WHEN top > 0.85::DOUBLE THEN 'skew' WHEN spread < 0.06::DOUBLE AND t >= 10 THEN 'uniform'
      ELSE 'natural' END AS kind FROM rh),
rating_v AS (SELECT product_id, kind NOT IN ('few', 'natural') AS detected,
    CASE kind WHEN 'bimodal' THEN 'high' WHEN 'skew' THEN 'medium' WHEN 'uniform' THEN 'medium' ELSE 'low' END AS severity,
    CAST(CASE kind WHEN 'bimodal' THEN greatest(10, 100 - trunc(ends * 100)) WHEN 'skew' THEN
      greatest(20, 100 - trunc(top * 80)) WHEN 'uniform' THEN 45 ELSE 85 END AS INTEGER) AS score,
    CASE kind WHEN 'few' THEN 'Not enough ratings for distribution analysis'
      WHEN 'bimodal' THEN 'Bimodal distribution -- ' || r5 || ' five-star and ' || r1 || ' one-star reviews ('
        || {PCT.format("ends")} || ' at extremes)'
      WHEN 'skew' THEN 'Heavily skewed -- ' || {PCT.format("top")} || ' of reviews are '
        || CASE top WHEN f1 THEN '1' WHEN f2 THEN '2' WHEN f3 THEN '3' WHEN f4 THEN '4' ELSE '5' END || '-star'
      WHEN 'uniform' THEN 'Unusually uniform distribution across all ratings'
      ELSE 'Rating distribution appears natural' END AS details
  FROM ri)
"""

BURST_CTE = """
bd AS (SELECT product_id, review_date AS day, COUNT(*) AS n_day FROM reviews WHERE review_date IS NOT NULL GROUP BY ALL),
bw AS (SELECT a.product_id, a.day, a.n_day, CAST((SELECT SUM(b2.n_day) FROM bd b2 WHERE b2.product_id = a.product_id
    AND b2.day BETWEEN a.day AND a.day + 2) AS BIGINT) AS n_window FROM bd a),
bx AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY n_window DESC, day) AS rn,
    CAST(SUM(n_day) OVER (PARTITION BY product_id) AS BIGINT) AS n_dated FROM bw),
burst AS (SELECT p.product_id, coalesce(x.n_dated, 0) AS n_dated, x.n_window AS worst, x.day AS burst_start,
    x.n_window / CAST(x.n_dated AS DOUBLE) AS share FROM (SELECT DISTINCT product_id FROM reviews) p
    LEFT JOIN bx x ON x.product_id = p.product_id AND x.rn = 1),
burst_v AS (SELECT product_id, burst_start, n_dated >= 5 AND worst >= greatest(3, n_dated * 0.3::DOUBLE) AS detected,
    CASE WHEN n_dated < 5 OR worst < greatest(3, n_dated * 0.3::DOUBLE) THEN 'low' WHEN share > 0.6::DOUBLE THEN 'high'
      WHEN share > 0.4::DOUBLE THEN 'medium' ELSE 'low' END AS severity,
    CAST(CASE WHEN n_dated < 5 THEN 90 WHEN worst < greatest(3, n_dated * 0.3::DOUBLE) THEN 85
      ELSE greatest(0, 100 - trunc(share * 120)) END AS INTEGER) AS score,
    CASE WHEN n_dated < 5 THEN 'Not enough dated reviews for burst analysis'
      WHEN worst < greatest(3, n_dated * 0.3::DOUBLE) THEN 'No unusual review posting patterns detected'
      ELSE worst || ' of ' || n_dated || ' reviews posted within 3 days (' || strftime(burst_start, '%Y-%m-%d') || ' to '
        || strftime(burst_start + 2, '%Y-%m-%d') || ')' END AS details
  FROM burst)
"""

CONTRADICTS = """coalesce(confidence, 0) >= 0.55::DOUBLE AND ((coalesce(trunc(rating), 0) >= 4 AND
 lower(coalesce(sentiment, '')) = 'negative') OR (coalesce(trunc(rating), 0) <= 2 AND lower(coalesce(sentiment, '')) = 'positive'))"""

MISMATCH_CTE = f"""
mc AS (SELECT product_id, COUNT(*) AS n, COUNT(*) FILTER ({CONTRADICTS}) AS c FROM reviews GROUP BY product_id),
mr AS (SELECT *, c / CAST(n AS DOUBLE) AS rate FROM mc),
mismatch_v AS (SELECT product_id, c > 0 AS detected,
    CASE WHEN rate > 0.25::DOUBLE THEN 'high' WHEN rate > 0.1::DOUBLE THEN 'medium' ELSE 'low' END AS severity,
    CAST(CASE WHEN c = 0 THEN 90 ELSE greatest(10, 100 - trunc(rate * 300)) END AS INTEGER) AS score,
    CASE WHEN c = 0 THEN 'Ratings and sentiments are consistent' ELSE c || ' of ' || n ||
      ' reviews have star ratings contradicting their sentiment' END AS details
  FROM mr)
"""

WORDS = r"len(regexp_extract_all(text, '[^\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]+'))"

LENGTH_CTE = f"""
lw AS (SELECT product_id, {WORDS} AS words FROM reviews),
ls AS (SELECT product_id, COUNT(*) FILTER (words > 0) AS n, AVG(words) FILTER (words > 0) AS mean,
    stddev_pop(words) FILTER (words > 0) AS std FROM lw GROUP BY product_id),
lc AS (SELECT *, std / mean AS cv, printf('%.2f', std / mean) AS cvt, printf('%.0f', round_even(mean, 0)) AS mt FROM ls),
length_v AS (SELECT product_id, n >= 5 AND cv < 0.35::DOUBLE AS detected,
    CASE WHEN n < 5 OR cv >= 0.35::DOUBLE THEN 'low' WHEN cv < 0.2::DOUBLE THEN 'high' ELSE 'medium' END AS severity,
    CAST(CASE WHEN n < 5 OR cv >= 0.35::DOUBLE THEN 85 WHEN cv < 0.2::DOUBLE THEN 25 ELSE 55 END AS INTEGER) AS score,
    CASE WHEN n < 5 THEN 'Not enough reviews for length analysis'
      WHEN cv < 0.2::DOUBLE THEN 'Review lengths are suspiciously uniform (CV=' || cvt || ', avg ' || mt || ' words)'
      WHEN cv < 0.35::DOUBLE THEN 'Review lengths show low variance (CV=' || cvt || ', avg ' || mt || ' words)'
      ELSE 'Review lengths show natural variance (CV=' || cvt || ')' END AS details,
    CASE WHEN n >= 5 THEN round_even(mean, 1) END AS mean, CASE WHEN n >= 5 THEN round_even(std, 1) END AS std,
    CASE WHEN n >= 5 THEN round_even(cv, 2) END AS cv
  FROM lc)
"""

_quoted = lambda words: ", ".join(f"'{w}'" for w in words)

PHRASE_CTE = f"""
pw AS (SELECT product_id, review_idx, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'),
    lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN ({_quoted(PHRASE_STOP_WORDS)})) AS ws FROM reviews),
pu AS (SELECT product_id, review_idx, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM pw),
pq AS (SELECT product_id, review_idx, pos, w || ' ' || lead(w, 1) OVER r || ' ' || lead(w, 2) OVER r AS p3,
    w || ' ' || lead(w, 1) OVER r || ' ' || lead(w, 2) OVER r || ' ' || lead(w, 3) OVER r AS p4
    FROM pu WINDOW r AS (PARTITION BY product_id, review_idx ORDER BY pos)),
pg AS (SELECT product_id, review_idx, 3 AS k, pos, p3 AS phrase FROM pq WHERE p3 IS NOT NULL
    UNION ALL SELECT product_id, review_idx, 4, pos, p4 FROM pq WHERE p4 IS NOT NULL),
pn AS (SELECT product_id, COUNT(*) AS n FROM reviews GROUP BY product_id),
pd AS (SELECT product_id, review_idx, phrase, MIN(k) AS k, MIN(pos) AS pos FROM pg GROUP BY ALL),
pc AS (SELECT product_id, phrase, COUNT(*) AS c, MIN((review_idx, k, pos)) AS seen FROM pd GROUP BY ALL),
pr AS (SELECT pc.*, n, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY c DESC, seen) AS phrase_rank
    FROM pc JOIN pn USING (product_id) WHERE c >= greatest(3, n // 5)),
pk AS (SELECT * FROM pr WHERE phrase_rank <= 20),
pf(product_id, r, seen_words, kept) AS (
    SELECT product_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM (SELECT DISTINCT product_id FROM pk)
    UNION ALL
    SELECT f.product_id, k.phrase_rank,
      CASE WHEN len(kept) < 8 AND NOT list_has_all(seen_words, string_split(k.phrase, ' '))
        THEN list_concat(seen_words, string_split(k.phrase, ' ')) ELSE seen_words END,
      CASE WHEN len(kept) < 8 AND NOT list_has_all(seen_words, string_split(k.phrase, ' '))
        THEN list_append(kept, k.phrase) ELSE kept END
    FROM pf f JOIN pk k ON k.product_id = f.product_id AND k.phrase_rank = f.r + 1),
pl AS (SELECT product_id, arg_max(kept, r) AS kept FROM pf GROUP BY product_id),
phrase_s AS (SELECT pn.product_id, pn.n, coalesce(len(pl.kept), 0) AS kept,
    (SELECT MAX(c) FROM pk WHERE pk.product_id = pn.product_id AND list_contains(pl.kept, pk.phrase)) / CAST(n AS DOUBLE) AS rate,
    coalesce(array_to_string(pl.kept, '|'), '') AS repeated
    FROM pn LEFT JOIN pl USING (product_id)),
phrase_v AS (SELECT product_id, kept > 0 AS detected, CASE WHEN rate > 0.5::DOUBLE THEN 'high' WHEN rate > 0.3::DOUBLE THEN 'medium'
    ELSE 'low' END AS severity,
    CAST(CASE WHEN kept = 0 THEN 90 ELSE greatest(15, 100 - trunc(rate * 150) - kept * 5) END AS INTEGER) AS score,
    CASE WHEN kept = 0 THEN 'No suspicious phrase repetition detected' ELSE kept || ' phrase(s) repeated across multiple reviews' END
      AS details, repeated
  FROM phrase_s)
"""

TFIDF_CTE = f"""
tv AS (SELECT product_id, review_idx, text FROM reviews WHERE {WORDS} >= 5),
tt AS (SELECT product_id, review_idx, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM tv),
tf AS (SELECT product_id, review_idx, term, COUNT(*) AS tf FROM tt WHERE term NOT IN ({_quoted(TERM_STOP_WORDS)}) GROUP BY ALL),
td AS (SELECT product_id, term, COUNT(*) AS df, SUM(tf) AS uses FROM tf GROUP BY ALL),
tn AS (SELECT product_id, COUNT(*) AS n FROM tv GROUP BY product_id),
ti AS (SELECT product_id, term, ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM td JOIN tn USING (product_id)),
tw AS (SELECT product_id, review_idx, term, tf * idf AS w0 FROM tf JOIN ti USING (product_id, term)),
tl AS (SELECT product_id, review_idx, sqrt(SUM(w0 * w0)) AS norm FROM tw GROUP BY ALL),
vec AS (SELECT product_id, review_idx, term, w0 / norm AS w FROM tw JOIN tl USING (product_id, review_idx))
"""

PAIR_CTE = """
pairs AS (SELECT x.product_id, x.review_idx AS a, y.review_idx AS b, SUM(x.w * y.w) AS sim
    FROM vec x JOIN vec y ON x.product_id = y.product_id AND x.term = y.term AND x.review_idx < y.review_idx
    GROUP BY ALL HAVING SUM(x.w * y.w) > 0.75)
"""

CLUSTER_CTE = """
sym AS (SELECT product_id, a AS u, b AS v FROM pairs UNION ALL SELECT product_id, b, a FROM pairs),
reach(product_id, u, v) AS (
    SELECT DISTINCT product_id, u, u FROM sym UNION SELECT r.product_id, r.u, s.v FROM reach r JOIN sym s
    ON s.product_id = r.product_id AND s.u = r.v),
member AS (SELECT product_id, u AS review_idx, MIN(v) AS cluster FROM reach GROUP BY ALL),
dn AS (SELECT product_id, COUNT(*) AS n FROM reviews GROUP BY product_id),
ds AS (SELECT dn.product_id, dn.n, coalesce(tn.n, 0) AS n_valid, m.n_dup, m.n_clusters FROM dn LEFT JOIN tn USING (product_id)
    LEFT JOIN (SELECT product_id, COUNT(*) AS n_dup, COUNT(DISTINCT cluster) AS n_clusters FROM member GROUP BY ALL) m
    USING (product_id)),
dup_v AS (SELECT product_id, n_valid >= 3 AND n_dup IS NOT NULL AS detected,
    CASE WHEN n_valid < 3 OR n_dup IS NULL THEN 'low' WHEN n_dup > n * 0.2::DOUBLE THEN 'high' WHEN n_dup > 3 THEN 'medium' ELSE 'low' END
      AS severity,
    CAST(CASE WHEN n_valid < 3 OR n_dup IS NULL THEN 90 ELSE greatest(10, 100 - trunc(n_dup / CAST(n AS DOUBLE) * 200)) END AS INTEGER)
      AS score,
    CASE WHEN n_valid < 3 THEN 'Not enough reviews for duplicate analysis' WHEN n_dup IS NULL THEN
      'No duplicate or near-duplicate reviews found' ELSE n_dup || ' reviews found in ' || n_clusters || ' duplicate cluster(s)' END
      AS details
  FROM ds)
"""


def _with(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",".join(c.strip() for c in ctes) + " " + select


VERDICT = "product_id, detected, severity, score, details"


@query("rating_anomaly", _with(REVIEWS_SQL, RATING_CTE, select=f"SELECT {VERDICT} FROM rating_v"))
def rating_anomaly(spark, d):
    return ratings.detect_rating_anomaly(derive.reviews(spark, d)).drop("distribution")


@query(
    "rating_histogram",
    _with(
        REVIEWS_SQL,
        RATING_CTE,
        select="""SELECT product_id, star, count, count / CAST(greatest(1, max(count) OVER (PARTITION BY product_id)) AS DOUBLE) * 100
        AS height FROM (SELECT product_id, 1 AS star, r1 AS count FROM rc UNION ALL SELECT product_id, 2, r2 FROM rc UNION ALL
        SELECT product_id, 3, r3 FROM rc UNION ALL SELECT product_id, 4, r4 FROM rc UNION ALL SELECT product_id, 5, r5 FROM rc)""",
    ),
)
def rating_histogram(spark, d):
    return ratings.rating_histogram(derive.reviews(spark, d))


@query("review_burst", _with(REVIEWS_SQL, BURST_CTE, select=f"SELECT {VERDICT} FROM burst_v"))
def review_burst(spark, d):
    return bursts.detect_bursts(derive.reviews(spark, d))


@query("sliding_day_count", _with(REVIEWS_SQL, BURST_CTE, select="SELECT product_id, day, n_day, n_window FROM bw"))
def sliding_day_count(spark, d):
    return bursts.sliding_day_count(derive.reviews(spark, d))


@query(
    "burst_reviews",
    _with(
        REVIEWS_SQL,
        BURST_CTE,
        select="""SELECT r.product_id, r.review_idx, r.review_date FROM reviews r JOIN burst_v v USING (product_id)
        WHERE v.detected AND r.review_date BETWEEN v.burst_start AND v.burst_start + 2""",
    ),
)
def burst_reviews(spark, d):
    return bursts.burst_reviews(derive.reviews(spark, d))


@query("rating_sentiment_mismatch", _with(REVIEWS_SQL, MISMATCH_CTE, select=f"SELECT {VERDICT} FROM mismatch_v"))
def rating_sentiment_mismatch(spark, d):
    return ratings.detect_mismatch(derive.reviews(spark, d))


@query(
    "mismatched_reviews", _with(REVIEWS_SQL, select=f"SELECT product_id, review_idx FROM reviews WHERE {CONTRADICTS}")
)
def mismatched_reviews(spark, d):
    return ratings.mismatched_reviews(derive.reviews(spark, d))


@query("length_uniformity", _with(REVIEWS_SQL, LENGTH_CTE, select=f"SELECT {VERDICT}, mean, std, cv FROM length_v"))
def length_uniformity(spark, d):
    found = ratings.detect_length_uniformity(derive.reviews(spark, d))
    return found.select("product_id", "detected", "severity", "score", "details", "stats.*")


@query(
    "ranked_phrases", _with(REVIEWS_SQL, PHRASE_CTE, select="SELECT product_id, phrase, c AS count, CAST(phrase_rank AS INTEGER) AS phrase_rank FROM pk")
)
def ranked_phrases(spark, d):
    return phrases.ranked_phrases(derive.reviews(spark, d)).drop("n")


@query("phrase_repetition", _with(REVIEWS_SQL, PHRASE_CTE, select=f"SELECT {VERDICT}, repeated FROM phrase_v"))
def phrase_repetition(spark, d):
    found = phrases.detect_phrases(derive.reviews(spark, d))
    return found.selectExpr(
        "product_id", "detected", "severity", "score", "details", "array_join(repeated_phrases.phrase, '|') AS repeated"
    )


@query(
    "phrase_reviews",
    _with(
        REVIEWS_SQL,
        PHRASE_CTE,
        select="SELECT DISTINCT pg.product_id, pg.review_idx, pg.phrase FROM pg JOIN pl USING (product_id) WHERE list_contains(pl.kept, pg.phrase)",
    ),
)
def phrase_reviews(spark, d):
    return phrases.phrase_reviews(derive.reviews(spark, d))


@query(
    "repeated_phrase_reviews",
    _with(
        REVIEWS_SQL,
        PHRASE_CTE,
        select="SELECT DISTINCT pg.product_id, pg.review_idx, pg.phrase FROM pg JOIN pr USING (product_id, phrase)",
    ),
)
def repeated_phrase_reviews(spark, d):
    return phrases.repeated_phrase_reviews(derive.reviews(spark, d))


@query(
    "tfidf_weights",
    _with(
        REVIEWS_SQL,
        TFIDF_CTE,
        select="""SELECT product_id, doc, term, round(w, 6) AS w FROM (SELECT product_id, review_idx AS doc, term, w FROM vec) JOIN
        (SELECT product_id, min(review_idx) AS doc FROM (SELECT product_id, review_idx, string_agg(term || ':' || tf, ' ' ORDER BY term) AS bag
         FROM tf GROUP BY ALL) GROUP BY product_id, bag) USING (product_id, doc)""",
    ),
)
def tfidf_weights(spark, d):
    from pyspark.sql import functions as F

    weights = similarity.tfidf(derive.reviews(spark, d))
    return weights.select("product_id", "doc", "term", F.round("w", 6).alias("w"))


@query(
    "similar_pairs",
    _with(
        REVIEWS_SQL,
        TFIDF_CTE,
        PAIR_CTE,
        select="""SELECT product_id, a, b, round(sim, 6) AS sim FROM pairs JOIN
        (SELECT product_id, min(review_idx) AS a FROM (SELECT product_id, review_idx, string_agg(term || ':' || tf, ' ' ORDER BY term) AS bag
         FROM tf GROUP BY ALL) GROUP BY product_id, bag) USING (product_id, a) JOIN
        (SELECT product_id, min(review_idx) AS b FROM (SELECT product_id, review_idx, string_agg(term || ':' || tf, ' ' ORDER BY term) AS bag
         FROM tf GROUP BY ALL) GROUP BY product_id, bag) USING (product_id, b)""",
    ),
)
def similar_pairs(spark, d):
    from pyspark.sql import functions as F

    bags = written(similarity.numbered_bags(similarity.token_bags(derive.reviews(spark, d))), "bags", ROW_GROUP, DICTIONARY)
    return similarity.similar_pairs(bags).withColumn("sim", F.round("sim", 6))


@query(
    "similar_members",
    _with(
        REVIEWS_SQL,
        TFIDF_CTE,
        select="""SELECT product_id, review_idx, min(review_idx) OVER (PARTITION BY product_id, bag) AS representative FROM
        (SELECT product_id, review_idx, string_agg(term || ':' || tf, ' ' ORDER BY term) AS bag FROM tf GROUP BY ALL)""",
    ),
)
def similar_members(spark, d):
    return similarity.bag_members(derive.reviews(spark, d))


@query(
    "duplicate_reviews",
    _with(REVIEWS_SQL, TFIDF_CTE, PAIR_CTE, CLUSTER_CTE, select="SELECT product_id, cluster, review_idx FROM member"),
)
def duplicate_reviews(spark, d):
    return duplicates.duplicate_reviews(derive.reviews(spark, d))


@query(
    "duplicate_clusters",
    _with(
        REVIEWS_SQL,
        TFIDF_CTE,
        PAIR_CTE,
        CLUSTER_CTE,
        select="""SELECT m.product_id, m.cluster, m.count, CASE WHEN length(r.text) > 80 THEN substring(r.text, 1, 80) || '...'
        ELSE r.text END AS preview FROM (SELECT product_id, cluster, COUNT(*) AS count FROM member GROUP BY ALL) m
        JOIN reviews r ON r.product_id = m.product_id AND r.review_idx = m.cluster""",
    ),
)
def duplicate_clusters(spark, d):
    return duplicates.duplicate_clusters(derive.reviews(spark, d))


@query(
    "duplicate_content",
    _with(REVIEWS_SQL, TFIDF_CTE, PAIR_CTE, CLUSTER_CTE, select=f"SELECT {VERDICT} FROM dup_v"),
)
def duplicate_content(spark, d):
    return duplicates.detect_duplicates(derive.reviews(spark, d))


_PARTS = (
    ("review_burst", "burst_v"),
    ("rating_distribution", "rating_v"),
    ("duplicate_content", "dup_v"),
    ("rating_sentiment_mismatch", "mismatch_v"),
    ("phrase_repetition", "phrase_v"),
    ("length_uniformity", "length_v"),
)
TRUST_SQL = _with(
    REVIEWS_SQL,
    BURST_CTE,
    RATING_CTE,
    TFIDF_CTE,
    PAIR_CTE,
    CLUSTER_CTE,
    MISMATCH_CTE,
    PHRASE_CTE,
    LENGTH_CTE,
    "trust AS (SELECT product_id, dn.n AS total_reviews, CAST(round_even(burst_v.score * 0.2::DOUBLE + rating_v.score * 0.2::DOUBLE"
    " + dup_v.score * 0.2::DOUBLE + mismatch_v.score * 0.15::DOUBLE + phrase_v.score * 0.15::DOUBLE + length_v.score * 0.1::DOUBLE, 0)"
    " AS INTEGER) AS trust_score, CAST("
    + " + ".join(f"CAST({v}.detected AS INTEGER)" for _, v in _PARTS)
    + " AS INTEGER) AS issues_found, "
    + ", ".join(f"{v}.{c} AS {n}_{c}" for n, v in _PARTS for c in ("severity", "score", "details"))
    + " FROM dn "
    + " ".join(f"JOIN {v} USING (product_id)" for _, v in _PARTS)
    + " WHERE dn.n >= 3)",
    select="SELECT *, CASE WHEN trust_score >= 80 THEN 'High Trust' WHEN trust_score >= 60 THEN 'Moderate Trust'"
    " WHEN trust_score >= 40 THEN 'Low Trust' ELSE 'Very Low Trust' END AS trust_label FROM trust",
)


@query("trust_report", TRUST_SQL)
def trust_report(spark, d):
    return report.flat_report(derive.reviews(spark, d))


@query(
    "flagged_reviews",
    _with(
        REVIEWS_SQL,
        BURST_CTE,
        TFIDF_CTE,
        PAIR_CTE,
        CLUSTER_CTE,
        PHRASE_CTE,
        select=f"""SELECT r.product_id, 'review_burst' AS detector, r.review_idx FROM reviews r JOIN burst_v v USING (product_id)
        WHERE v.detected AND r.review_date BETWEEN v.burst_start AND v.burst_start + 2
        UNION ALL SELECT product_id, 'rating_sentiment_mismatch', review_idx FROM reviews WHERE {CONTRADICTS}
        UNION ALL SELECT product_id, 'duplicate_content', review_idx FROM member
        UNION ALL SELECT DISTINCT pg.product_id, 'phrase_repetition', pg.review_idx FROM pg JOIN pl USING (product_id)
        WHERE list_contains(pl.kept, pg.phrase)""",
    ),
)
def flagged_reviews(spark, d):
    return report.flagged_reviews(derive.reviews(spark, d))


@query(
    "flagged_reviews_every_phrase",
    _with(
        REVIEWS_SQL,
        BURST_CTE,
        TFIDF_CTE,
        PAIR_CTE,
        CLUSTER_CTE,
        PHRASE_CTE,
        select=f"""SELECT r.product_id, 'review_burst' AS detector, r.review_idx FROM reviews r JOIN burst_v v USING (product_id)
        WHERE v.detected AND r.review_date BETWEEN v.burst_start AND v.burst_start + 2
        UNION ALL SELECT product_id, 'rating_sentiment_mismatch', review_idx FROM reviews WHERE {CONTRADICTS}
        UNION ALL SELECT product_id, 'duplicate_content', review_idx FROM member
        UNION ALL SELECT DISTINCT pg.product_id, 'phrase_repetition', pg.review_idx FROM pg JOIN pr USING (product_id, phrase)""",
    ),
)
def flagged_reviews_every_phrase(spark, d):
    return report.flagged_reviews(derive.reviews(spark, d), every_phrase=True)


@query(
    "flagged_arrays",
    f"""SELECT product_id, detector, CAST(floor(review_idx / 512) AS BIGINT) AS block, array_to_string(list(review_idx ORDER BY review_idx), ',') AS review_indices
    FROM ({ORACLES["flagged_reviews"]}) GROUP BY ALL""",
)
def flagged_arrays(spark, d):
    from pyspark.sql import functions as F

    packed = report.flagged_arrays(report.flagged_reviews(derive.reviews(spark, d)), span=512)
    return packed.withColumn("review_indices", F.array_join(F.col("review_indices").cast("array<string>"), ","))


def _from_bodies_sql() -> str:
    """The report over what is read out of the bodies: cleaned texts, and a sentiment that follows from their length."""
    from .extraction import CLEAN

    read = f"""raw_{REVIEWS_SQL.strip()[REVIEWS_SQL.strip().index("reviews AS"):]}"""
    before = REVIEWS_SQL.strip()[: REVIEWS_SQL.strip().index("reviews AS")]
    cleaned = f""", reviews AS (SELECT product_id, review_idx, text, rating, review_date, CASE WHEN length(text) > 500 THEN 'positive' ELSE 'negative' END AS sentiment,
      round((0.75 + 0.5 + 0.5) / 3, 4) AS confidence, 0.0 AS ai_probability, 3 AS predicted_rating, lang FROM (SELECT * REPLACE ({CLEAN} AS text) FROM raw_reviews))"""
    return TRUST_SQL.replace(REVIEWS_SQL.strip(), before + read + cleaned)


@query("report_from_bodies", _from_bodies_sql())
def report_from_bodies(spark, d):
    """Stored answers with several reviews each, read, dated, scored and judged."""
    from pyspark.sql import functions as F

    from trustgrain.plans import ingest

    from .analytics import _length_model_of
    from .extraction import blocks, named

    items = named(F.col("items"), reviewText="text", rating="rating", id="id", createdDate="date")
    body = F.to_json(F.struct(F.struct(items.alias("productReviews")).alias("reviewData")))
    bodies = blocks(spark, d).select("body_id", F.regexp_extract("body_id", r"^(.*)-\d+$", 1).alias("product_id"), body.alias("body"))
    found = ingest.reviews_from_bodies(bodies, "ajio", {"sentiment": _length_model_of(None)}, lambda: F.col("review_id").cast("long") - 1)
    return report.flat_report(written(found, "reviews"))
