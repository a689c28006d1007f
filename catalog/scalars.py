"""Column functions over derived short reviews, URLs and the given pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from trustgrain.functions import crypto, lang, numbers, pages, text, urls
from trustgrain.operators import redflags, sites
from trustgrain.plans import derive
from trustgrain.sources.tables import load

from .base import plain, query

SHORT = f"WITH s AS ({plain(derive.SHORT_REVIEWS)}) "
URLS = f"WITH u AS ({plain(derive.PRODUCT_URLS)}) "
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
NW = r"[^\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"
BL, EL = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
STRIP = rf"regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')"


@query(
    "clean_text",
    SHORT
    + rf"""SELECT review_idx, trim(regexp_replace(trim(regexp_replace(text, '{WS}+', ' ', 'g')), '\b(read more|read less)\b', '', 'gi')) AS clean,
    CASE WHEN length(text) > 20 THEN substring(text, 1, 20) || '...' ELSE text END AS preview, substring(text, 1, 12) AS cut FROM s""",
)
def clean_text(spark, d):
    t = F.col("text")
    return derive.short_reviews(spark, d).select(
        "review_idx",
        text.clean_text(t).alias("clean"),
        text.preview(t, 20).alias("preview"),
        text.truncate(t, 12).alias("cut"),
    )


@query(
    "parse_rating",
    SHORT
    + r"""SELECT review_idx, CASE WHEN r BETWEEN 0 AND 5 THEN r END AS rating, coalesce(try_cast(rating_raw AS DOUBLE), 0.0::DOUBLE) AS lenient
    FROM (SELECT *, try_cast(nullif(regexp_extract(rating_raw, '(\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS r FROM s)""",
)
def parse_rating(spark, d):
    raw = F.col("rating_raw")
    return derive.short_reviews(spark, d).select(
        "review_idx", text.parse_rating(raw).alias("rating"), numbers.to_double(raw).alias("lenient")
    )


@query(
    "text_fingerprint",
    "SELECT doc_id, sha256(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS fp FROM documents",
)
def text_fingerprint(spark, d):
    return load(spark, d, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("fp"))


@query(
    "parse_review_date",
    SHORT
    + """SELECT review_idx, date_raw, CAST(coalesce(try_strptime(date_raw, '%Y-%m-%d'), try_strptime(date_raw, '%d %B %Y'),
    try_strptime(date_raw, '%B %d, %Y'), try_strptime(date_raw, '%d/%m/%Y'), try_strptime(date_raw, '%m/%d/%Y'),
    try_strptime(date_raw, '%d-%m-%Y'), try_strptime(date_raw, '%b %d, %Y'), try_strptime(date_raw, '%d %b %Y')) AS DATE) AS review_date FROM s""",
)
def parse_review_date(spark, d):
    return derive.short_reviews(spark, d).select(
        "review_idx", "date_raw", text.parse_review_date(F.col("date_raw")).alias("review_date")
    )


MON = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\w*"


@query(
    "find_date_text",
    SHORT
    + rf"""SELECT review_idx, coalesce(nullif(regexp_extract(date_raw, '(?i)(\d+\s+(?:months?|days?|years?|weeks?|hours?|minutes?)\s+ago)', 1), ''),
    nullif(regexp_extract(date_raw, '(?i)({MON}\s+\d{{1,2}},?\s+\d{{4}}|{MON},?\s+\d{{4}}|\d{{1,2}}\s+{MON},?\s+\d{{4}})', 1), ''),
    nullif(regexp_extract(date_raw, '(\d{{4}}-\d{{2}}-\d{{2}})', 1), ''), nullif(regexp_extract(date_raw, '(?i)on\s+(.+)$', 1), '')) AS found,
    CAST(CASE WHEN date_raw LIKE '%months ago' THEN DATE '2024-06-30' - to_months(CAST(regexp_extract(date_raw, '(\d+)', 1) AS INTEGER)) END AS DATE) AS resolved FROM s""",
)
def find_date_text(spark, d):
    raw = F.col("date_raw")
    return derive.short_reviews(spark, d).select(
        "review_idx",
        text.find_date_text(raw).alias("found"),
        text.resolve_relative_date(raw, F.lit("2024-06-30").cast("date")).alias("resolved"),
    )


@query(
    "epoch_or_iso_date",
    SHORT
    + r"""SELECT review_idx, CASE WHEN regexp_full_match(api_date, '\d{13,}') THEN strftime(epoch_ms(CAST(api_date AS BIGINT)), '%Y-%m-%d')
    WHEN contains(api_date, 'T') THEN split_part(api_date, 'T', 1) ELSE api_date END AS day FROM s""",
)
def epoch_or_iso_date(spark, d):
    return derive.short_reviews(spark, d).select("review_idx", text.epoch_or_iso_date(F.col("api_date")).alias("day"))


LANG_RANGES = (
    ("hi", r"[\x{0900}-\x{097F}]"), ("ru", r"[\x{0400}-\x{04FF}]"), ("zh", r"[\x{4E00}-\x{9FFF}]"),
    ("ja", r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}]"), ("ko", r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}]"), ("ar", r"[\x{0600}-\x{06FF}]"),
)
LANG_SQL = (
    "CASE WHEN len(regexp_extract_all(text, '\\p{L}')) = 0 THEN 'en' "
    + " ".join(
        f"WHEN len(regexp_extract_all(text, '{r}')) / len(regexp_extract_all(text, '\\p{{L}}')) > 0.5 THEN '{c}'" for c, r in LANG_RANGES
    )
    + " ELSE 'en' END"
)
NAMES_SQL = "CASE lower(code) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lang.LANGUAGE_NAMES.items()) + " ELSE upper(code) END"


@query(
    "detect_language",
    SHORT
    + f"""SELECT review_idx, language, CASE WHEN language IN ('hi', 'hi-en') THEN 'en' ELSE language END AS normal
    FROM (SELECT review_idx, {LANG_SQL} AS language FROM s)""",
)
def detect_language(spark, d):
    return derive.short_reviews(spark, d).select(
        "review_idx", lang.detect_language(F.col("text")).alias("language")
    ).withColumn("normal", lang.normalize_language(F.col("language")))


@query("document_language", f"SELECT doc_id, {LANG_SQL} AS language FROM documents")
def document_language(spark, d):
    return load(spark, d, "documents").select("doc_id", lang.detect_language(F.col("text")).alias("language"))


@query("language_name", f"SELECT lang AS code, COUNT(*) AS n, {NAMES_SQL.replace('code', 'lang')} AS name FROM documents GROUP BY lang")
def language_name(spark, d):
    counted = load(spark, d, "documents").groupBy(F.col("lang").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("name", lang.language_name(F.col("code")))


@query(
    "apply_translations",
    SHORT
    + f""", l AS (SELECT review_idx, text, {LANG_SQL} AS language FROM s),
    m AS (SELECT sha256(text) AS text_hash, language AS lang, min(CASE WHEN language = 'ko' THEN text ELSE 'in English: ' || language END) AS translated
      FROM l WHERE language IN ('ru', 'zh', 'ko', 'en') GROUP BY ALL)
    SELECT review_idx, l.language, coalesce(translated <> text AND l.language <> 'en', false) AS was_translated,
      CASE WHEN translated <> text AND l.language <> 'en' THEN translated ELSE text END AS text_to_analyze
    FROM l LEFT JOIN m ON m.text_hash = sha256(l.text) AND m.lang = l.language""",
)
def apply_translations(spark, d):
    rows = derive.short_reviews(spark, d).select("review_idx", "text", lang.detect_language(F.col("text")).alias("language"))
    memory = (
        rows.filter(F.col("language").isin("ru", "zh", "ko", "en"))
        .groupBy(F.sha2("text", 256).alias("text_hash"), F.col("language").alias("lang"))
        .agg(
            F.min(
                F.when(F.col("language") == "ko", F.col("text")).otherwise(F.concat(F.lit("in English: "), "language"))
            ).alias("translated")
        )
    )
    return lang.apply_translations(rows, memory).drop("text")


@query(
    "round_half_up",
    """SELECT l_orderkey, l_linenumber, floor(l_discount * l_extendedprice / 7 * 10 + 0.5::DOUBLE) / 10 AS one,
    CAST(floor(l_tax * l_quantity * 10 + 0.5::DOUBLE) AS INTEGER) AS whole FROM lineitem""",
)
def round_half_up(spark, d):
    return load(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        numbers.round_half_up(F.col("l_discount") * F.col("l_extendedprice") / 7, 1).alias("one"),
        numbers.truncate_to_int(numbers.round_half_up(F.col("l_tax") * F.col("l_quantity") * 10)).alias("whole"),
    )


KEY = "a secret of the test suite"


@query("encrypt_decrypt", "SELECT doc_id, text AS opened, '[Decryption Failed - Invalid Key or Corrupted Data]' AS wrong_key FROM documents")
def encrypt_decrypt(spark, d):
    docs = load(spark, d, "documents").select("doc_id", crypto.encrypt(F.col("text"), KEY).alias("sealed"))
    return docs.select(
        "doc_id",
        crypto.decrypt(F.col("sealed"), KEY).alias("opened"),
        crypto.decrypt(F.col("sealed"), "another key").alias("wrong_key"),
    )


@query(
    "token_hash",
    f"SELECT token_id, to_base64(unhex(sha256(token))) AS token_hash FROM ({plain(derive.REFRESH_TOKENS)})",
)
def token_hash(spark, d):
    return derive.refresh_tokens(spark, d).select("token_id", crypto.token_hash(F.col("token")).alias("token_hash"))


HOST = r"lower(nullif(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), ''))"


def _owned(expr: str, domains) -> str:
    return " OR ".join(f"{expr} = '{x}' OR ends_with({expr}, '.{x}')" for x in domains)


SITE_SQL = "CASE " + " ".join(f"WHEN h = '{x}' OR ends_with(h, '.{x}') THEN '{s}'" for s, x in urls.SITE_DOMAINS) + " END"


@query(
    "url_sites",
    URLS
    + f"""SELECT url_id, coalesce(regexp_replace(h, '^www\\.', ''), 'unknown') AS host, {SITE_SQL} AS site,
    contains(lower(url), '/ap/signin') OR contains(lower(url), '/accounts/login') OR contains(lower(url), '/login?')
      OR contains(lower(url), '/login/phone') OR contains(lower(url), '/account/login') AS signin,
    resource_type IN ('image', 'media', 'font') OR {" OR ".join(f"contains(lower(url), '{p}')" for p in pages.TRACKER_PARTS)} AS tracker
    FROM (SELECT *, {HOST.format("url")} AS h FROM u)""",
)
def url_sites(spark, d):
    u = F.col("url")
    return derive.product_urls(spark, d).select(
        "url_id",
        urls.host(u).alias("host"),
        urls.site_of(u).alias("site"),
        pages.is_signin(u).alias("signin"),
        pages.is_tracker(u, F.col("resource_type")).alias("tracker"),
    )


@query("page_hosts", f"SELECT page_id, coalesce(regexp_replace({HOST.format('url')}, '^www\\.', ''), 'unknown') AS host FROM pages")
def page_hosts(spark, d):
    return load(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"))


@query(
    "assign_site",
    URLS + f"SELECT url_id, url, {SITE_SQL} AS site FROM (SELECT *, {HOST.format('url')} AS h FROM u)",
)
def assign_site(spark, d):
    found = sites.assign_site(derive.product_urls(spark, d), sites.site_table(spark))
    return found.select("url_id", "url", "site")


@query(
    "allowed_domains",
    URLS
    + f"""SELECT url_id, true AS allowed FROM (SELECT *, coalesce(regexp_replace({HOST.format('url')}, '^www\\.', ''), 'unknown') AS h FROM u) WHERE {_owned('h', urls.ALLOWED_DOMAINS)}
    UNION ALL SELECT url_id, false FROM (SELECT *, coalesce(regexp_replace({HOST.format('url')}, '^www\\.', ''), 'unknown') AS h FROM u) WHERE NOT ({_owned('h', urls.ALLOWED_DOMAINS)})""",
)
def allowed_domains(spark, d):
    found = derive.product_urls(spark, d)
    kept = sites.allowed_domains(found).select("url_id", F.lit(True).alias("allowed"))
    return kept.union(sites.allowed_domains(found, keep=False).select("url_id", F.lit(False).alias("allowed")))


@query(
    "robots_filter",
    f"""WITH p AS (SELECT page_id, url, {HOST.format('url')} AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^#]*)', 1) AS path0 FROM pages),
    q AS (SELECT *, CASE WHEN path0 = '' THEN '/' ELSE path0 END AS path FROM p),
    h AS (SELECT DISTINCT host FROM p),
    r AS (SELECT host, 1 AS rule_no, '/en/6' AS prefix, false AS allow FROM h UNION ALL SELECT host, 2, '/en', true FROM h
      UNION ALL SELECT host, 3, '/fr', false FROM h),
    st AS (SELECT host, CASE MOD(length(host), 4) WHEN 0 THEN 404 WHEN 1 THEN 503 ELSE 200 END AS fetch_status FROM h),
    m AS (SELECT page_id, arg_min(allow, rule_no) AS allow FROM q JOIN r USING (host) WHERE starts_with(path, prefix) GROUP BY page_id)
    SELECT page_id, CASE WHEN fetch_status = 200 THEN coalesce(allow, true) WHEN fetch_status = 404 THEN true ELSE false END AS allowed
    FROM q JOIN st USING (host) LEFT JOIN m USING (page_id)""",
)
def robots_filter(spark, d):
    found = load(spark, d, "pages").select("page_id", "url")
    hosts = found.select(urls.authority(F.col("url")).alias("host")).distinct()
    listed = F.array(
        *[
            F.struct(F.lit(i).alias("rule_no"), F.lit(p).alias("prefix"), F.lit(a).alias("allow"))
            for i, p, a in ((1, "/en/6", False), (2, "/en", True), (3, "/fr", False))
        ]
    )
    rules = hosts.select("host", F.inline(listed))
    kind = F.length("host") % 4
    status = hosts.withColumn("fetch_status", F.when(kind == 0, 404).when(kind == 1, 503).otherwise(200))
    return sites.robots_filter(found, rules, status, key="page_id").select("page_id", "allowed")


@query(
    "robots_agents",
    f"""WITH p AS (SELECT page_id, {HOST.format('url')} AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^#]*)', 1) AS path FROM pages)
    SELECT page_id, CASE MOD(length(host), 2) WHEN 0 THEN NOT starts_with(path, '/de') ELSE starts_with(path, '/en') OR NOT starts_with(path, '/') END AS allowed FROM p""",
)
def robots_agents(spark, d):
    """Groups for all agents, and on every other host one for the agent asked for, which then holds alone."""
    found = load(spark, d, "pages").select("page_id", "url")
    hosts = found.select(urls.authority(F.col("url")).alias("host")).distinct()
    every = F.array(*[
        F.struct(F.lit(a).alias("agent"), F.lit(i).alias("rule_no"), F.lit(p).alias("prefix"), F.lit(x).alias("allow"))
        for a, i, p, x in (("*", 1, "/en", True), ("*", 2, "/", False))
    ])
    own = F.array(F.struct(F.lit("TrustBot").alias("agent"), F.lit(1).alias("rule_no"), F.lit("/de").alias("prefix"), F.lit(False).alias("allow")))
    rules = hosts.select("host", F.inline(every)).union(hosts.filter(F.length("host") % 2 == 0).select("host", F.inline(own)))
    status = hosts.withColumn("fetch_status", F.lit(200))
    return sites.robots_filter(found, rules, status, key="page_id", agent="trustbot/2.1").select("page_id", "allowed")


SUPPORTED_SQL = "CASE " + " ".join(f"WHEN regexp_matches(h, '{p}') THEN '{name}'" for name, p in urls.HOST_PATTERNS) + " END"


@query(
    "supported_sites",
    URLS + f"SELECT url_id, {SUPPORTED_SQL} AS site FROM (SELECT *, {HOST.format('url')} AS h FROM u)",
)
def supported_sites(spark, d):
    return derive.product_urls(spark, d).select("url_id", urls.supported_site(F.col("url")).alias("site"))


ASIN = r"nullif(regexp_extract(url, '/(?:dp|gp/product|product-reviews)/([A-Z0-9]{10})', 1), '')"
SITED = URLS.rstrip() + f", t AS (SELECT *, {SITE_SQL} AS site FROM (SELECT *, {HOST.format('url')} AS h FROM u)) "


@query(
    "product_ids",
    SITED
    + rf"""SELECT url_id, CASE site WHEN 'amazon' THEN coalesce({ASIN}, '')
      WHEN 'flipkart' THEN coalesce(nullif(regexp_extract(url, '/product-reviews/(itm\w+)', 1), ''), nullif(regexp_extract(url, 'pid=([A-Z0-9]+)', 1), ''), '')
      WHEN 'myntra' THEN regexp_extract(url, '/(\d{{6,15}})(?:/buy|/reviews|$|[?#])', 1)
      WHEN 'ajio' THEN coalesce(nullif(regexp_extract(url, '/p/(\d+_[A-Za-z0-9]+)', 1), ''), regexp_extract(url, '/p/(\d+)', 1))
      WHEN 'nykaa' THEN coalesce(nullif(regexp_extract(url, '/p/(\d+)', 1), ''), regexp_extract(url, '[?&]productId=(\d+)', 1)) ELSE '' END AS product_id,
      CASE WHEN site = 'amazon' AND {ASIN} IS NOT NULL THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/product-reviews/' || {ASIN}
          || '/ref=cm_cr_arp_d_paging_btm_next_1?ie=UTF8&reviewerType=all_reviews&pageNumber=1'
        WHEN site = 'flipkart' THEN regexp_replace(url, '^([^?#]*?)/p/(itm\w+)', '\1/product-reviews/\2')
        WHEN site = 'myntra' AND regexp_extract(url, '/(\d{{6,15}})(?:/buy|/reviews|$|[?#])', 1) <> '' THEN
          regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/reviews/' || regexp_extract(url, '/(\d{{6,15}})(?:/buy|/reviews|$|[?#])', 1)
        ELSE url END AS review_url,
      CASE WHEN regexp_matches(url, 'amazon\.(com|in|co\.uk|ca|de|fr|it|es|com\.au|co\.jp)/.*/(dp|gp/product)/') THEN 'Amazon'
        WHEN regexp_matches(url, 'flipkart\.com/.*/p/') THEN 'Flipkart' WHEN regexp_matches(url, 'myntra\.com/.*/buy') THEN 'Myntra'
        WHEN regexp_matches(url, 'ajio\.com/.*/p/') THEN 'Ajio' WHEN regexp_matches(url, 'nykaa\.com/.*/p/|nykaafashion\.com/.*/p/') THEN 'Nykaa' END AS page_of
    FROM t""",
)
def product_ids(spark, d):
    u, s = F.col("url"), F.col("site")
    found = derive.product_urls(spark, d).withColumn("site", urls.site_of(F.col("url")))
    return found.select(
        "url_id",
        urls.product_id(u, s).alias("product_id"),
        urls.review_url(u, s).alias("review_url"),
        urls.product_page_site(u).alias("page_of"),
    )


@query(
    "set_param",
    URLS
    + r"""SELECT url_id, CASE WHEN regexp_matches(b, '[?&]page=') THEN regexp_replace(b, '([?&])page=[^&]*', '\1page=7')
    WHEN contains(b, '?') THEN b || '&page=7' ELSE b || '?page=7' END || f AS url
    FROM (SELECT url_id, regexp_extract(url, '^([^#]*)', 1) AS b, regexp_extract(url, '(#.*)$', 1) AS f FROM u)""",
)
def set_param(spark, d):
    return derive.product_urls(spark, d).select("url_id", urls.set_param(F.col("url"), "page", "7").alias("url"))


_AMZ = "o || '/product-reviews/' || asin || '/ref=cm_cr_arp_d_viewopt_sr?ie=UTF8&reviewerType=all_reviews&pageNumber=1"
_AMZ_LIST = ", ".join(
    [
        "o || '/dp/' || asin",
        "o || '/product-reviews/' || asin || '/ref=cm_cr_arp_d_paging_btm_next_1?ie=UTF8&reviewerType=all_reviews&pageNumber=1'",
        f"{_AMZ}&sortBy=recent'",
    ]
    + [f"{_AMZ}&filterByStar={s}&sortBy={o}'" for o in ("recent", "helpful") for s in urls.AMAZON_STARS]
)


_STARS = ", ".join(f"('{s}', '{o}', {1 + i * 5 + j})" for i, o in enumerate(("MOST_RECENT", "MOST_HELPFUL")) for j, s in enumerate(urls.FLIPKART_STARS))


@query(
    "url_batches",
    SITED
    + rf""", a AS (SELECT url_id, {ASIN} AS asin, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS o FROM t WHERE site = 'amazon'),
    l AS (SELECT url_id, [{_AMZ_LIST}] AS us FROM a WHERE asin IS NOT NULL),
    k AS (SELECT url_id, regexp_replace(regexp_replace(url, '^([^?#]*?)/p/(itm\w+)', '\1/product-reviews/\2'), '&page=[^&]*$', '') || '&page=1' AS o
      FROM t WHERE site = 'flipkart')
    SELECT url_id, CAST(i - 1 AS INTEGER) AS batch_no, us[i] AS batch_url FROM l, unnest(range(1, 14)) AS r(i)
    UNION ALL SELECT url_id, 0, o FROM k
    UNION ALL SELECT url_id, n, o || '&rating=' || st || '&sortOrder=' || so FROM k, (VALUES {_STARS}) AS v(st, so, n)
    UNION ALL SELECT url_id, 0, CASE WHEN site = 'myntra' THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/reviews/' ||
      regexp_extract(url, '/(\d{{6,15}})(?:/buy|/reviews|$|[?#])', 1) ELSE url END FROM t
      WHERE site IN ('myntra', 'ajio', 'nykaa')""",
)
def url_batches(spark, d):
    found = derive.product_urls(spark, d).withColumn("site", urls.site_of(F.col("url")))
    wide = urls.expand_url_batches(found.filter(F.col("site").isNotNull()))
    return wide.select("url_id", "batch_no", "batch_url")


@query(
    "client_ip",
    """SELECT event_id, CASE WHEN xff <> '' THEN trim(split_part(xff, ',', 1)) WHEN rip <> '' THEN rip ELSE remote END AS ip FROM
    (SELECT event_id, CASE WHEN MOD(event_id, 3) = 0 THEN ' 10.0.0.' || user_id || ' , 10.1.1.1' WHEN MOD(event_id, 3) = 1 THEN '' END AS xff,
     CASE WHEN MOD(event_id, 2) = 0 THEN '10.2.0.' || user_id END AS rip, '127.0.0.1' AS remote FROM events)""",
)
def client_ip(spark, d):
    e, uid = load(spark, d, "events"), F.col("user_id").cast("string")
    n = F.col("event_id")
    xff = F.when(n % 3 == 0, F.concat(F.lit(" 10.0.0."), uid, F.lit(" , 10.1.1.1"))).when(n % 3 == 1, "")
    real = F.when(n % 2 == 0, F.concat(F.lit("10.2.0."), uid))
    return e.select("event_id", urls.client_ip(xff, real, F.lit("127.0.0.1")).alias("ip"))


_STRONG = " OR ".join(f"contains(low, '{m}')" for m in pages.STRONG_BLOCK_MARKERS)


@query(
    "blocked_pages",
    f"""SELECT page_id, (({_STRONG}) AND NOT (contains(low, 'recaptcha') AND n > 10000)) OR (n < 10000 AND (contains(low, 'captcha') OR contains(low, 'access denied'))) AS blocked
    FROM (SELECT page_id, lower(h) AS low, length(h) AS n FROM (SELECT page_id, CASE MOD(page_id, 4) WHEN 0 THEN html || 'please verify: reCAPTCHA'
      WHEN 1 THEN html || '<p>Unusual traffic</p>' WHEN 2 THEN html || 'Access Denied' ELSE html END AS h FROM pages))""",
)
def blocked_pages(spark, d):
    k = F.col("page_id") % 4
    html = F.concat(
        "html",
        F.when(k == 0, "please verify: reCAPTCHA").when(k == 1, "<p>Unusual traffic</p>").when(k == 2, "Access Denied").otherwise(""),
    )
    return load(spark, d, "pages").select("page_id", pages.is_blocked(html).alias("blocked"))


GEN = rf"{BL}(good|bad|great|awesome|terrible|worst|best|amazing){WS}+(product|item|quality|service){EL}"
SUSP = (
    (rf"{BL}(only|just){WS}+\d+{WS}+(left|remaining){EL}", "Fake urgency - ''Only X left!''"),
    (rf"{BL}(order|sell|buy){WS}+(fast|quick|now){EL}", "Fake urgency"),
    (rf"{BL}(first{WS}+time{WS}+(buyer|user|customer)){EL}", "Fake first-timer claims"),
    (rf"{BL}(5{WS}*star|five{WS}*star|one{WS}*star|1{WS}*star){WS}+(rating|review){EL}", "Explicit star claims"),
)
DET = rf"(\d+{WS}*(gb|mb|kg|cm|mm|inch|hour|minute|day|week|month|year))|(\$\d+)|({BL}\d{{4}}{EL})|({BL}(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec){EL})"


def flags_sql(source: str, key: str) -> str:
    return rf"""
    , f1 AS (SELECT {key}, t, lower(t) AS low, len(regexp_extract_all(t, '\p{{L}}')) AS letters, len(regexp_extract_all(t, '\p{{Lu}}')) AS ups,
      len(regexp_extract_all(t, '!')) AS bangs, len(regexp_extract_all(t, '\?')) AS qs, regexp_extract_all(lower(t), '{NW}+') AS ws
      FROM (SELECT {key}, {STRIP} AS t FROM {source})),
    f2 AS (SELECT *, len(ws) AS n, list_zip(ws[:-2], ws[2:]) AS pairs FROM f1),
    f3 AS (SELECT {key}, list_filter([
      CASE WHEN letters > 5 AND ups / letters > 0.3 THEN 'EXCESSIVE_CAPS|high|' || CAST(CAST(round_even(ups / letters * 100.0::DOUBLE, 0) AS BIGINT) AS VARCHAR) || '% of letters are uppercase' END,
      CASE WHEN bangs >= 5 THEN 'EXCESSIVE_EXCLAMATIONS|medium|Contains ' || bangs || ' exclamation marks' END,
      CASE WHEN qs >= 3 THEN 'EXCESSIVE_QUESTIONS|low|Contains ' || qs || ' question marks' END,
      CASE WHEN n < 8 AND regexp_matches(low, '{GEN}') THEN 'GENERIC_LANGUAGE|low|Review contains only generic/vague phrases without detail' END,
      CASE {" ".join(f"WHEN regexp_matches(low, '{p}') THEN 'SUSPICIOUS_PHRASE|medium|{x}'" for p, x in SUSP)} END,
      CASE WHEN n >= 4 AND len(list_distinct(pairs)) / len(pairs) < 0.5 THEN 'REPETITIVE_TEXT|high|High repetition of phrases detected' END,
      CASE WHEN n < 15 AND NOT regexp_matches(low, '{DET}') THEN 'LACKS_SPECIFICS|low|No specific measurements, prices, dates, or specifications mentioned' END
      ], lambda x: x IS NOT NULL) AS fl FROM f2),
    f4 AS (SELECT *, CAST(least(100, coalesce(list_sum(list_transform(fl, lambda x: CASE split_part(x, '|', 2) WHEN 'high' THEN 30 WHEN 'medium' THEN 15 ELSE 5 END)), 0)) AS INTEGER) AS suspicion_score FROM f3)
    SELECT {key}, array_to_string(fl, ';') AS flags, CAST(len(fl) AS INTEGER) AS total_flags, suspicion_score,
      CASE WHEN suspicion_score >= 60 THEN 'high' WHEN suspicion_score >= 30 THEN 'medium' ELSE 'low' END AS suspicion_level FROM f4"""


def _flat_flags(df, key):
    flagged = redflags.red_flags(df)
    shown = F.transform(
        "red_flags",
        lambda f: F.concat_ws(
            "|",
            f.getField("type"),
            f.getField("severity"),
            F.when(f.getField("type") == "SUSPICIOUS_PHRASE", f.getField("description")).otherwise(f.getField("evidence")),
        ),
    )
    return flagged.select(key, F.array_join(shown, ";").alias("flags"), "total_flags", "suspicion_score", "suspicion_level")


@query("red_flags", SHORT.rstrip() + flags_sql("s", "review_idx"))
def red_flags(spark, d):
    return _flat_flags(derive.short_reviews(spark, d), "review_idx")


@query("document_red_flags", "WITH d AS (SELECT doc_id, text FROM documents)" + flags_sql("d", "doc_id"))
def document_red_flags(spark, d):
    return _flat_flags(load(spark, d, "documents"), "doc_id")
