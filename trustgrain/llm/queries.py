"""The operators of this subpackage as queries over the given tables, and the SQL with the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, arc, divergence, hosts, importance, jaccard, lines, mixing, neardup, packing, quality, secrets
from ..session import work_path
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, folder, "embeddings"), F.col("id") % 100 == 0)


@query
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    found = quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query
def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_digest(secrets.scan_secrets(table(spark, folder, "documents")))


@query
def op4_divergence(spark: SparkSession, folder: str) -> DataFrame:
    found = divergence.judge_documents(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "char_distance",
        "word_distance",
    )


@query
def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, folder, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), TOKENIZER, PATTERN)


@query
def op8_archives(spark: SparkSession, folder: str) -> DataFrame:
    path = work_path(spark, "warc")
    records = arc.page_records(table(spark, folder, "pages"))
    arc.write_warc(arc.to_warc(records), path)
    back = arc.read_warc(spark, path).filter("record_type in ('response', 'revisit')")
    return arc.resolve_revisits(back).select(
        F.col("id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to_id").alias("refers_to"),
    )


@query
def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    found = hosts.filter_urls(table(spark, folder, "pages"), table(spark, folder, "labels"))
    return found.select("page_id", "host", "path", "rule", "verdict")


@query
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.drop_boilerplate(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", "text")


@query
def op10_long_lines(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.drop_boilerplate(table(spark, folder, "documents"), long_words=lines.LONG_WORDS)
    return found.select("doc_id", "n_lines", "n_dropped", "text")


@query
def op11_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_classes(table(spark, folder, "documents"))


@query
def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.align_tokens(table(spark, folder, "documents"), TOKENIZER, PATTERN, PIECES)


@query
def op13_importance(spark: SparkSession, folder: str) -> DataFrame:
    return importance.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: The fewest sources at their limit with which no other source is above its own give the rate; then the histograms.
ORACLES["op5_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST(concat('0x', substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))), 1, 6))
      AS BIGINT) AS h
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
    WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM sums),
ratios AS (
  SELECT *, 2.0 * source_size / w AS r,
    sum(2 * source_size) OVER o AS size_upto, sum(w) OVER o AS w_upto, row_number() OVER o AS k,
    CAST(1.5 * sum(source_size) OVER () AS DOUBLE) AS budget, sum(w) OVER () AS w_all
  FROM weighed WINDOW o AS (ORDER BY 2.0 * source_size / w, source ROWS UNBOUNDED PRECEDING)),
steps AS (
  SELECT 0 AS size_upto, 0 AS w_upto, 0 AS k, max(budget) AS budget, max(w_all) AS w_all, min(r) AS next FROM ratios
  UNION ALL
  SELECT size_upto, w_upto, k, budget, w_all, lead(r) OVER (ORDER BY k) FROM ratios),
rate AS (
  SELECT arg_min((budget - size_upto) / (w_all - w_upto), k) AS rate
  FROM steps WHERE w_upto < w_all AND (budget - size_upto) / (w_all - w_upto) <= next),
targets AS (
  SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), rate * w) AS target FROM weighed, rate),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
rests AS (SELECT *, target - epochs * source_size AS rest FROM budgets),
coarse AS (
  SELECT source, h // 4096 AS bucket, sum(size) AS size FROM sized GROUP BY ALL),
edges AS (
  SELECT source, bucket AS edge, rest - upto + size AS room FROM (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY bucket) AS upto FROM coarse) c
  JOIN rests r USING (source) WHERE upto > rest AND upto - size <= rest),
fine AS (
  SELECT s.source, edge, room, h % 4096 AS fine, sum(size) AS size
  FROM sized s JOIN edges e ON s.source = e.source AND h // 4096 = edge GROUP BY ALL),
cuts AS (
  SELECT source, edge * 4096 + max(fine) + 1 AS cut FROM (
    SELECT *, sum(size) OVER (PARTITION BY source ORDER BY fine) AS upto FROM fine) f
  WHERE abs(upto - room) < abs(upto - size - room) GROUP BY source, edge),
limits AS (
  SELECT r.*, coalesce(cut, edge * 4096, 0) AS threshold
  FROM rests r LEFT JOIN edges USING (source) LEFT JOIN cuts USING (source))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (epochs + CASE WHEN epochs < 2 AND h < threshold THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized JOIN limits USING (source)
"""

ORACLES["op9_url_filter"] = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY 1),
bare AS (
  SELECT host, bad, CASE WHEN starts_with(host, '[') THEN split_part(host, ']', 1) ELSE split_part(host, ':', 1) END AS bare
  FROM parts LEFT JOIN marks ON page_id = doc_id),
labels2 AS (
  SELECT *, starts_with(host, '[') OR regexp_matches(bare, '^[0-9]{1,3}(\.[0-9]{1,3}){3}$') AS address,
    array_to_string(string_split(bare, '.')[-2:], '.') AS two FROM bare),
named AS (
  SELECT host, bad, CASE WHEN address THEN bare WHEN two IN {suffixes} THEN array_to_string(string_split(bare, '.')[-3:], '.')
      ELSE two END AS domain,
    CASE WHEN address THEN 'address' WHEN two IN {suffixes} THEN two ELSE string_split(bare, '.')[-1] END AS suffix
  FROM labels2),
hosts AS (
  SELECT host, domain, suffix, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM named GROUP BY 1, 2, 3),
overall AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0.0) AS p FROM hosts),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, max(p) AS p FROM hosts, overall GROUP BY 1),
sk AS (
  SELECT 1 / least(greatest(coalesce((q - (k - 1)) / CASE WHEN k > 1 AND room > 0 THEN room END, 0.001), 0.001), 0.5) - 1
    AS k FROM (
      SELECT *, t - t2 / t - (k - 1) AS room FROM (
        SELECT sum(n * pow(bad / n - p, 2) / (p * (1 - p))) AS q, count(*) AS k, sum(n) AS t, sum(n * n) AS t2
        FROM s WHERE n > 0 AND p > 0 AND p < 1))),
sm AS (SELECT suffix, (k * p + bad) / (k * p + bad + (k * (1 - p) + n - bad)) AS p FROM s, sk),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, max(p) AS p FROM hosts JOIN sm USING (suffix) GROUP BY 1, 2),
dk AS (
  SELECT 1 / least(greatest(coalesce((q - (k - 1)) / CASE WHEN k > 1 AND room > 0 THEN room END, 0.001), 0.001), 0.5) - 1
    AS k FROM (
      SELECT *, t - t2 / t - (k - 1) AS room FROM (
        SELECT sum(n * pow(bad / n - p, 2) / (p * (1 - p))) AS q, count(*) AS k, sum(n) AS t, sum(n * n) AS t2
        FROM d WHERE n > 0 AND p > 0 AND p < 1))),
dm AS (SELECT domain, (k * p + bad) / (k * p + bad + (k * (1 - p) + n - bad)) AS p FROM d, dk),
h AS (SELECT host, n, bad, p FROM hosts JOIN dm USING (domain)),
hk AS (
  SELECT 1 / least(greatest(coalesce((q - (k - 1)) / CASE WHEN k > 1 AND room > 0 THEN room END, 0.001), 0.001), 0.5) - 1
    AS k FROM (
      SELECT *, t - t2 / t - (k - 1) AS room FROM (
        SELECT sum(n * pow(bad / n - p, 2) / (p * (1 - p))) AS q, count(*) AS k, sum(n) AS t, sum(n * n) AS t2
        FROM h WHERE n > 0 AND p > 0 AND p < 1))),
post AS (SELECT host, k * p + bad AS a, k * (1 - p) + n - bad AS b FROM h, hk),
cubes AS (SELECT *, pow(b * 0.5, 1.0 / 3) AS x, pow(a * 0.5, 1.0 / 3) AS y FROM post),
blocked AS (
  SELECT host FROM cubes WHERE a > 0 AND CASE WHEN b <= 0 THEN TRUE ELSE
    -3 * (x * (1 - 1 / (9 * b)) - y * (1 - 1 / (9 * a))) / sqrt(x * x / b + y * y / a) > 1.645 END),
rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
  ('org', '/fr/', 'allow')) t(rule_host, rule_path, what)),
best AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(what, length(rule_host || rule_path)) AS what
  FROM (SELECT DISTINCT host, path FROM parts)
  JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1, 2)
SELECT page_id, p.host, p.path, rule,
  coalesce(what, CASE WHEN p.host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path
""".replace("{suffixes}", str(hosts.SUFFIXES))

ORACLES["op10_line_dedup"] = r"""
WITH texts AS (SELECT DISTINCT source, coalesce(text, '') AS text FROM documents),
totals AS (SELECT source, count(*) AS total FROM texts GROUP BY 1),
cut AS (
  SELECT DISTINCT source, text, trim(line, ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS line FROM texts)),
boiler AS (
  SELECT source, list(line) AS lines FROM (
    SELECT c.source, line FROM cut c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE line <> ''
    GROUP BY c.source, line, total HAVING count(*) >= 5 AND count(*) > CAST(0.05 AS DOUBLE) * total)
  GROUP BY 1),
kept AS (
  SELECT doc_id, d.text, len(string_split(d.text, chr(10))) AS n_lines,
    list_filter(string_split(d.text, chr(10)),
      lambda x: NOT list_contains(coalesce(lines, []), trim(x, ' ' || chr(9) || chr(13)))) AS left_lines
  FROM documents d LEFT JOIN boiler b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
  CAST(coalesce(n_lines - len(left_lines), 0) AS BIGINT) AS n_dropped,
  CASE WHEN text IS NOT NULL THEN array_to_string(left_lines, chr(10)) END AS text
FROM kept
"""

#: The ratio falls with the words of a line; from 50 words on, the pages of all sources count together.
ORACLES["op10_long_lines"] = r"""
WITH texts AS (SELECT DISTINCT source, coalesce(text, '') AS text FROM documents),
totals AS (SELECT source, count(*) AS total FROM texts GROUP BY 1),
cut AS (
  SELECT DISTINCT source, text, trim(line, ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS line FROM texts)),
worded AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM cut WHERE line <> ''),
boiler AS (
  SELECT source, list(line) AS lines FROM (
    SELECT c.source, line FROM worded c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE words < 50
    GROUP BY c.source, line, words, total
    HAVING count(*) >= 5 AND count(*) > CAST(0.05 AS DOUBLE) * (50 - words) / 50 * total)
  GROUP BY 1),
passages AS (
  SELECT list(line) AS long FROM (SELECT line FROM worded WHERE words >= 50 GROUP BY 1 HAVING count(DISTINCT text) >= 5)),
kept AS (
  SELECT doc_id, d.text, len(string_split(d.text, chr(10))) AS n_lines,
    list_filter(string_split(d.text, chr(10)),
      lambda x: NOT list_contains(list_concat(coalesce(lines, []), coalesce(long, [])), trim(x, ' ' || chr(9) || chr(13)))) AS left_lines
  FROM documents d LEFT JOIN boiler b ON d.source IS NOT DISTINCT FROM b.source CROSS JOIN passages)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
  CAST(coalesce(n_lines - len(left_lines), 0) AS BIGINT) AS n_dropped,
  CASE WHEN text IS NOT NULL THEN array_to_string(left_lines, chr(10)) END AS text
FROM kept
"""

#: CRC-32 by its table of 256 entries, for the distinct words alone.
ORACLES["op13_importance"] = r"""
WITH crc AS (
  SELECT list(v ORDER BY b) AS entry FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)),
      lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS v FROM range(256) t(b))),
sides AS (
  SELECT 'raw' AS side, doc_id, text FROM documents UNION ALL SELECT 'target', NULL, text FROM benchmark),
words AS (
  SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS list FROM sides),
spread AS (SELECT side, doc_id, unnest(list) AS word FROM words),
hashed AS (
  SELECT word, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(length(hex(word)) // 2), lambda i: CAST(concat('0x', substr(hex(word), 2 * i + 1, 2)) AS BIGINT))),
    lambda c, x: xor(c >> 8, entry[xor(c & 255, x) + 1]))) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM spread), crc),
counted AS (
  SELECT bucket, count(*) FILTER (side = 'raw') AS s, count(*) FILTER (side = 'target') AS t
  FROM spread JOIN hashed USING (word) GROUP BY 1),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (sum(s) OVER () + 10000)
    / ((CAST(s AS DOUBLE) + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM counted),
weights AS (
  SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight
  FROM spread JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'raw' GROUP BY 1),
scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('2024:', CAST(d.doc_id AS VARCHAR))), 1, 8)) AS BIGINT)
      + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weights w USING (doc_id)),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS many FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * many // 100 THEN place END AS rank
FROM scored s LEFT JOIN drawn USING (doc_id)
"""
