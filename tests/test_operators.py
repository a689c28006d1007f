"""Functions and operators on inline tables: every accepted form, and thresholds at, below and above."""

from __future__ import annotations

import datetime as dt
import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from catalog import streams
from trustgrain.functions import crypto, lang, numbers, pages, text, urls
from trustgrain.operators import attempts, governance, redflags, reviews, sites, skew, usage
from trustgrain.operators.components import components
from trustgrain.operators.extract import api, cards, embedded, jsonld, markup
from trustgrain.sources import files
from trustgrain.session import work_path


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, fn, kind="string"):
    rows = column(spark, values, kind).select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


def test_dates(spark):
    d = dt.date
    cases = {
        "2024-01-05": d(2024, 1, 5), "2024-1-5": d(2024, 1, 5), "5 January 2024": d(2024, 1, 5),
        "January 5, 2024": d(2024, 1, 5), "05/01/2024": d(2024, 1, 5), "01/25/2024": d(2024, 1, 25),
        "5-1-2024": d(2024, 1, 5), " 2024-01-05 ": d(2024, 1, 5), "Jan 5, 2024": d(2024, 1, 5),
        "5 Jan 2024": d(2024, 1, 5), "2024-01-05T10:00:00Z": d(2024, 1, 5), "31/02/2024": None, "4 months ago": None,
        "": None, "soon": None, "2024/03/05": d(2024, 3, 5), "05.03.2024": d(2024, 5, 3), "25.03.2024": d(2024, 3, 25),
        "Mar 5 2024": d(2024, 3, 5), "March 5 2024": d(2024, 3, 5), "5 Mar, 2024": d(2024, 3, 5),
        "Sept 5, 2024": d(2024, 9, 5), "5th March 2024": d(2024, 3, 5), "Tue, 5 Mar 2024": d(2024, 3, 5),
        "20240305": d(2024, 3, 5), "March 2024": None,
    }
    assert apply(spark, list(cases), text.parse_review_date) == list(cases.values())


def test_ratings_and_text(spark):
    assert apply(spark, ["4.5 out of 5", "5", "rated 6", "none", "", None, "0 stars"], text.parse_rating) == [4.5, 5.0, None, None, None, None, 0.0]
    cases = ["  a  b\tc ", "fine. Read More", "bread moreover", "READ LESS it is"]
    assert apply(spark, cases, text.clean_text) == ["a b c", "fine.", "bread moreover", "it is"]
    assert apply(spark, ["a b c", "", "   ", "x"], text.word_count) == [3, 0, 0, 1]
    assert apply(spark, [2.5, -2.5, 0.25], lambda c: numbers.round_half_up(c, 0), "double") == [3.0, -2.0, 0.0]
    values = [random.Random(3).random() for _ in range(500)] + [0.12345, 0.5, 1.0, 0.00005, 0.99995]
    assert apply(spark, values, lambda c: numbers.round_exact(c, 4), "double") == [round(v, 4) for v in values]


def test_run_lengths(spark):
    got = apply(spark, [["a", "a", "b"], [], ["x"]], text.run_lengths, "array<string>")
    assert [[(t["term"], t["tf"]) for t in x] for x in got] == [[("a", 2), ("b", 1)], [], [("x", 1)]]


def test_language(spark):
    cases = ["hello", "यह उत्पाद अच्छा", "Отличный", "这个产品", "とてもよい", "정말 좋은", "منتج جيد", "123 !!", "", None, "abcd это"]
    assert apply(spark, cases, lang.detect_language) == ["en", "hi", "ru", "zh", "ja", "ko", "ar", "en", "en", "en", "en"]
    assert apply(spark, ["de", "hi-en", "xx", "", None, "French"], lang.language_name) == ["German", "Hinglish", "XX", "Unknown", "Unknown", "French"]


def flags_of(spark, value):
    row = redflags.red_flags(column(spark, [value]).withColumnRenamed("v", "text")).first()
    return {f["type"] for f in row["red_flags"]}, row["suspicion_score"], row["suspicion_level"]


def test_red_flags(spark):
    detail = " and it weighs 3 kg"
    assert "EXCESSIVE_CAPS" not in flags_of(spark, "AAAbcdefgh" + detail)[0]
    assert "EXCESSIVE_CAPS" in flags_of(spark, "AAAA BBBB CCCC DDDD" + detail)[0]
    assert "EXCESSIVE_CAPS" not in flags_of(spark, "ABCDE")[0]
    assert "EXCESSIVE_EXCLAMATIONS" in flags_of(spark, "yes!!!!!" + detail)[0]
    assert "EXCESSIVE_EXCLAMATIONS" not in flags_of(spark, "yes!!!!" + detail)[0]
    assert "EXCESSIVE_QUESTIONS" in flags_of(spark, "why???" + detail)[0]
    assert "GENERIC_LANGUAGE" in flags_of(spark, "a great  product 3 kg")[0]
    assert "GENERIC_LANGUAGE" not in flags_of(spark, "a great product of one two three four five")[0]
    assert "SUSPICIOUS_PHRASE" in flags_of(spark, "only 3 left in the shop")[0]
    assert "SUSPICIOUS_PHRASE" not in flags_of(spark, "reorder now")[0]
    assert "REPETITIVE_TEXT" in flags_of(spark, "a b a b a b a b")[0]
    assert "REPETITIVE_TEXT" not in flags_of(spark, "one two three")[0]
    assert "LACKS_SPECIFICS" not in flags_of(spark, "came in march 2023")[0]
    assert flags_of(spark, "BUY NOW BUY NOW BUY NOW BUY NOW!!!!!")[1:] == (95, "high")
    assert flags_of(spark, "fine thing this")[1:] == (5, "low")


def test_blocked_pages(spark):
    pad = lambda s, n: s + "x" * (n - len(s))
    cases = [pad("captcha", 9_999), pad("captcha", 10_000), pad("recaptcha", 10_000), pad("recaptcha", 10_001), pad("robot check", 20_000), pad("robot check recaptcha", 20_000)]
    assert apply(spark, cases, pages.is_blocked) == [True, False, True, False, True, False]


def test_urls(spark):
    cases = ["https://www.amazon.in/dp/B000000001", "https://m.flipkart.com/x", "https://notamazon.in/", "bad", "https://user@ajio.com:80/p/1"]
    assert apply(spark, cases, urls.site_of) == ["amazon", "flipkart", None, None, "ajio"]
    assert apply(spark, cases, urls.host) == ["amazon.in", "m.flipkart.com", "notamazon.in", "unknown", "ajio.com"]
    got = apply(spark, ["http://a/b?x=1&page=2&y=#f", "http://a/b", "http://a?page=1&page=2", "http://a?k"], lambda c: urls.set_param(c, "page", "9"))
    assert got == ["http://a/b?x=1&page=9&y=#f", "http://a/b?page=9", "http://a?page=9", "http://a?k=&page=9"]


def test_encryption(spark):
    values = ["text", "", None, "ünï"]
    key = "k" * 40
    sealed = column(spark, values).select("i", crypto.encrypt(F.col("v"), key).alias("v")).cache()
    assert [r["o"] for r in sealed.select("i", crypto.decrypt(F.col("v"), key).alias("o")).orderBy("i").collect()] == values
    assert apply(spark, ["not base64!", "AAAA"], lambda c: crypto.decrypt(c, key)) == [crypto.UNREADABLE] * 2


def test_dedupe_keeps_first_and_is_idempotent(spark):
    rows = [(1, "r1", "Some Text", 5.0), (2, "r1", "other", 1.0), (3, "", "Some text!", 4.0), (4, "", "some  text", 4.0), (5, "", "some text", 3.0), (6, None, "r1", 4.0)]
    df = spark.createDataFrame(rows, "n int, review_id string, text string, rating double")
    once = reviews.dedupe_reviews(df, ["n"])
    assert sorted(r["n"] for r in once.collect()) == [1, 3, 5, 6]
    assert sorted(r["n"] for r in reviews.dedupe_reviews(once, ["n"]).collect()) == [1, 3, 5, 6]


def test_drop_contained(spark):
    page = [("Great value here",), ("great value",), ("value here",), ("other",), ("other",)]
    df = spark.createDataFrame([(1, page)], "p int, found array<struct<text:string>>")
    kept = df.select(F.inline(reviews.drop_contained(F.col("found")))).collect()
    assert [r["text"] for r in kept] == ["Great value here", "other", "other"]


def test_top_k_and_join_facts_with_one_hot_key(spark):
    rows = [("hot", i, float(i % 97)) for i in range(3000)] + [("cold", i, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(6)
    got = skew.top_k(df, ["k"], [F.desc("v"), F.asc("i")], 5, ["i"]).collect()
    want = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (-r[2], r[1]))[:5]
    assert sorted((r["rank"], r["i"]) for r in got if r["k"] == "hot") == [(n + 1, r[1]) for n, r in enumerate(want)]
    facts = spark.createDataFrame([("hot", 1)], "k string, f int")
    assert skew.join_facts(df, facts, ["k"], "i").count() == 3000
    assert skew.join_facts(df, facts, ["k"], "i", "left").count() == 3003


def test_components(spark):
    rng = random.Random(5)
    edges = [(p, rng.randrange(60), rng.randrange(60)) for p in ("x", "y") for _ in range(45)]
    edges += [("z", i, i + 1) for i in range(40)]
    got = {(r["p"], r["node"]): r["component"] for r in components(spark.createDataFrame(edges, "p string, a long, b long"), ["p"]).collect()}
    label = {(p, n): n for p, a, b in edges if a != b for n in (a, b)}
    for _ in range(100):
        for p, a, b in edges:
            if a != b:
                label[p, a] = label[p, b] = min(label[p, a], label[p, b])
    assert got == label


def test_paging_and_history(spark):
    df = spark.createDataFrame([(i,) for i in range(45)], "id int")
    assert [r["id"] for r in usage.paginate(df, 2, 20, [F.asc("id")]).collect()] == list(range(40, 45))
    assert usage.page_info(df, 2, 20).first().asDict() == {"page": 2, "size": 20, "total_elements": 45, "total_pages": 3, "last": True}
    assert usage.page_info(df.limit(0), 0, 500).first()["total_pages"] == 0
    a = spark.createDataFrame([("a", 50)], "id string, authenticity_score int")
    b = spark.createDataFrame([("b", "x")], "id string, domain string")
    assert {r["id"] for r in usage.history(a, b, "link").collect()} == {"b"}
    assert usage.history(a, b, "nonsense").count() == 0


def test_governance(spark):
    old = spark.createDataFrame([(1, "a")], "id int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c")], "id int, v string")
    assert {tuple(r) for r in governance.insert_if_absent(old, new, ["id"]).collect()} == {(1, "a"), (2, "c")}


def test_csv_round_trip_keeps_quotes_and_lines(spark):
    rows = [('say "hi", twice', 5.0, "2024-01-01"), ("two\nlines", 4.5, ""), (" padded ", 3.0, None), ("back\\slash", 1.0, "x"), ("", 2.0, "y"), (None, 2.5, "z"), ("  ", None, "")]
    df = spark.createDataFrame(rows, "text string, rating double, date_raw string")
    path = work_path(spark, "csv-test")
    files.write_reviews_csv(df, path)
    got = {tuple(r) for r in files.read_reviews_csv(spark, path).collect()}
    assert got == {(t, r, d or "") for t, r, d in rows}


def page(*blocks):
    return "".join(f'<script type="application/ld+json">{json.dumps(b)}</script>' for b in blocks)


def test_jsonld_forms(spark):
    review = lambda t, r: {"reviewBody": t, "reviewRating": {"ratingValue": r}}
    html = page(
        {"@type": "Product", "review": [review("one", 5), {"description": "two", "reviewRating": "4 stars"}, review("no rating", None)]},
        {"@graph": [{"review": review("three", "3.5")}, 7]},
        [{"review": {"reviewBody": {"en": "four"}, "reviewRating": {"ratingValue": 1}}}],
        {"review": review("too high", 9)},
    ) + '<script type="application/ld+json">{broken</script>'
    got = jsonld.jsonld_reviews(column(spark, [html]).select(F.col("i").alias("page_id"), F.col("v").alias("html"))).orderBy("pos").collect()
    assert [(r["text"], r["rating"]) for r in got] == [("one", 5.0), ("two", 4.0), ("three", 3.5), ("four", 1.0)]


def test_product_meta(spark):
    full = page({"@type": "Product", "name": "N", "brand": "B", "image": ["i.png"], "offers": {"lowPrice": 9.5, "priceCurrency": "EUR"}, "aggregateRating": {"ratingValue": "4.2"}})
    og = '<meta property="og:title" content="T"/><meta content="o.png" property="og:image">'
    df = column(spark, [full + og, og, "<html/>"]).select(F.col("i").alias("page_id"), F.col("v").alias("html"))
    got = [tuple(r) for r in jsonld.product_meta(df).orderBy("page_id").collect()]
    assert got == [(0, "N", "B", "EUR 9.5", "i.png", 4.2), (1, "T", "", "", "o.png", None)]


def test_embedded_and_deep(spark):
    state = json.dumps({"a": [{"text": "long enough text", "rating": {"x": 1}, "stars": "4.5"}, {"body": "short", "rating": 5}]})
    script = f"<script>var pad='{'x' * 100}';window.__INITIAL_STATE__ = {state};var y={{}}</script>"
    df = column(spark, [script, "<script>window.__data = {broken</script>" + "x" * 200]).select(F.col("i").alias("page_id"), F.col("v").alias("html"))
    assert [(r["text"], r["rating"]) for r in embedded.embedded_reviews(df).collect()] == [("long enough text", 4.5), ("short", 5.0)]
    deep = {"comment": "at the very bottom", "score": 3}
    for _ in range(20):
        deep = {"k": deep}
    many = {"list": [{"comment": f"review {i}", "score": 3} for i in range(1200)]}
    bodies = [json.dumps(deep), json.dumps(many), "[" * 100_000, "{broken", None]
    docs = column(spark, bodies).withColumnRenamed("v", "doc")
    found = [(r["i"], r["text"]) for r in embedded.deep_reviews(docs, ["i"]).orderBy("i", "pos").collect()]
    assert found == [(0, "at the very bottom"), *((1, f"review {i}") for i in range(1200))]
    assert {r["i"] for r in embedded.unreadable_documents(docs, ["i"]).collect()} == {2, 3, 4}


def test_api_bodies(spark):
    ajio = {"reviewData": {"productReviews": [{"reviewText": "ok", "rating": 4, "id": 7, "createdDate": "1704412800000"}, {"title": "T", "rating": 5}, {"reviewText": "x", "rating": 9}]}}
    nykaa = {"response": {"reviews": [{"description": "short", "title": "a longer title", "reviewRating": {"ratingValue": 2}}]}}
    run = lambda b, s: [tuple(r)[2:] for r in api.api_reviews(column(spark, [json.dumps(b)]).select(F.col("i").alias("body_id"), F.col("v").alias("body")), s).collect()]
    assert run(ajio, "ajio") == [("ok", 4.0, "7", "2024-01-05")]
    assert run(nykaa, "nykaa") == [("a longer title short", 2.0, "", "")]


def test_selectors_and_cards(spark):
    html = '<div class="a b" id="x"><p data-k="v1">one<br>two</p><span>three</span></div><p>out</p>'
    root = markup.tree(html)
    assert [n.text() for n in markup.select(root, "div.a p")] == ["one two"]
    assert [n.text() for n in markup.select(root, 'p[data-k^="v"]')] == ["one two"]
    assert len(markup.select(root, "p")) == 2 and not markup.select(root, "#y") and markup.select(root, "#x span")
    card = '<div data-hook="review" id="R1234567890AB"><i data-hook="review-star-rating"><span class="a-icon-alt">4.0 out of 5</span></i><span data-hook="review-date">Reviewed on 3 May 2024</span><span data-hook="review-body">Nice  thing</span></div>'
    df = spark.createDataFrame([(1, "https://www.amazon.com/dp/B000000001", card), (2, "https://example.org/", card)], "page_id int, url string, html string")
    got = [tuple(r) for r in cards.extract_reviews(df).select("page_id", "text", "rating", "review_id", "date").collect()]
    assert got == [(1, "Nice thing", 4.0, "R1234567890AB", "3 May 2024")]


def test_pages_of_any_depth(spark):
    nested = "<div>" * 1200 + "deep" + "</div>" * 1200
    assert markup.tree(nested).text() == "deep" and len(list(markup.tree(nested).walk())) == 1200
    items = markup.tree("<ul>" + "<li>a<p>b" * 1200 + "</ul><p>c")
    assert len(items.children) == 2 and len(items.children[0].children) == 1200
    assert [n.text() for n in markup.select(items, "li")][:2] == ["a b", "a b"]
    grid = markup.tree("<table><tr><td>1<td>2<tr><td>3<table><tr><td>4</table></table>")
    assert [n.text() for n in markup.select(grid, "tr")] == ["1 2", "3 4", "4"]
    card = '<div class="_2wzgFH"><div class="_3LWZlK">4</div><div class="t-ZTKy">Great phone and the Shipping was fast</div></div>'
    look = "padding-top: 8px; padding-bottom: 16px"
    unrated = f'<div style="padding-left: 16px; padding-top: 16px; padding-bottom: 16px"><div style="{look}"><span>no stars</span></div></div>'
    rated = '<div class="cPHDOP"><div class="_3LWZlK">3</div><div class="t-ZTKy">three stars</div></div>'
    pages_ = [card.replace('"_2wzgFH', '"col _2wzgFH'), nested, unrated + '<div class="x">' + rated + "</div>"]
    df = column(spark, pages_).select(F.col("i").alias("page_id"), F.lit("https://www.flipkart.com/p/1").alias("url"), F.col("v").alias("html"))
    got = [(r["page_id"], r["text"], r["rating"]) for r in cards.extract_reviews(df).orderBy("page_id").collect()]
    assert got == [(0, "Great phone and the Shipping was fast", 4.0), (2, "three stars", 3.0)]


def test_long_texts_differ_behind_the_start(spark):
    same = "word " * 60
    df = spark.createDataFrame([(1, "", same + "good", 5.0), (2, "", same + "bad", 5.0), (3, "", same + "good!", 5.0)], "n int, review_id string, text string, rating double")
    assert sorted(r["n"] for r in reviews.dedupe_reviews(df, ["n"]).collect()) == [1, 2]
    assert apply(spark, [same + "a", same + "b"], lambda c: text.fingerprint(c, 150) == text.fingerprint(F.lit(same), 150)) == [True, True]


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_requests_per_minute(spark):
    rows = [(1, "a", False, at(s)) for s in range(0, 50, 2)] + [(1, "b", True, at(s)) for s in range(59)]
    rows += [(1, "c", True, at(60)), (None, None, True, at(1)), (2, None, False, at(1)), (2, "d", None, at(1)), (2, "d", False, None)]
    df = spark.createDataFrame(rows, "user_id long, ip_address string, authenticated boolean, created_at timestamp")
    got = {(r["client"], r["minute"]): (r["requests"], r["allowed"], r["excess"]) for r in attempts.requests_per_minute(df).collect()}
    assert got == {
        ("ip:a", at(0)): (25, 20, 5), ("user:1", at(0)): (59, 60, 0), ("user:1", at(60)): (1, 60, 0), ("ip:d", at(0)): (1, 20, 0),
    }
    assert attempts.requests_per_minute(df.limit(0)).collect() == []


@pytest.mark.parametrize("memory_s", [None, 300])
def test_failure_runs(spark, memory_s):
    """A hot key, ties, pauses of just the limit and beyond, runs over several periods: as one pass over each key."""
    rng = random.Random(11)
    rows, clock = [], 0
    for i in range(4000):
        clock += rng.choice([0, 1, 60, 299, 300, 301, 4000])
        rows.append((i, None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 7}", at(clock), rng.random() < 0.9))
    rows += [(9001, "hot", None, True), (9002, "n", at(5), None)]
    df = spark.createDataFrame(rows, "id long, k string, created_at timestamp, failed boolean").repartition(5)
    found = attempts.failure_runs(df, "k", "failed", 4, memory_s).collect()
    runs, before = {}, {}
    for i, k, ts, failed in rows:
        if ts is None:
            continue
        mine = runs.setdefault(k, [[]])
        if not failed or (memory_s and k in before and ts - before[k] > dt.timedelta(seconds=memory_s)):
            mine.append([])
        if failed:
            mine[-1].append(ts)
        before[k] = ts
    want = [(k, r[0], r[-1], len(r), len(r) >= 4) for k, mine in runs.items() for r in mine if r]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found)
    assert {r["locked"] for r in found} == {True, False}


def test_robots_groups_and_status(spark):
    urls_ = spark.createDataFrame([(i, f"https://h{i}.example/a") for i in range(4)], "url_id int, url string")
    listed = [("h0.example", 1, "/a", False, "*"), ("h0.example", 2, "/a", True, "TrustBot"), ("h1.example", 1, "/a", False, "*")]
    listed += [("h1.example", 2, "/a", True, "other"), ("h2.example", 1, "/a", True, None)]
    table = spark.createDataFrame(listed, "host string, rule_no int, prefix string, allow boolean, agent string")
    status = spark.createDataFrame([("h0.example", 200), ("h1.example", 200), ("h2.example", 204), ("h3.example", 404)], "host string, fetch_status int")
    got = {r["url_id"]: r["allowed"] for r in sites.robots_filter(urls_, table, status, agent="trustbot/1.0").collect()}
    assert got == {0: True, 1: False, 2: False, 3: True}


def test_success_ends_a_run_in_the_stream(spark, tmp_path):
    """Nine failures, a success and a failure within five minutes lock nobody; ten failures in a row do."""
    start = dt.datetime(2024, 1, 1)
    kinds = {1: ["error"] * 9 + ["click", "error"], 2: ["error"] * 10}
    rows = [(100 * u + i, u, k, start + dt.timedelta(seconds=20 * i)) for u, ks in kinds.items() for i, k in enumerate(ks)]
    columns = pa.table(dict(zip(["event_id", "user_id", "event_type", "ts"], map(list, zip(*rows)))))
    pq.write_table(columns, f"{tmp_path}/events.parquet")
    got = sorted((r["user_id"], r["failures"], r["locked"]) for r in streams.lockout_runs_stream(spark, str(tmp_path)).collect())
    assert got == [(1, 1, False), (1, 9, False), (2, 10, True)]


def test_bodies_are_read_once(spark):
    """Lists and bodies without one are read in one pass; what removes repeats does not parse bodies again."""
    bodies = [json.dumps({"reviews": [{"text": "a fine thing", "rating": 4}] * 2}), json.dumps({"x": {"text": "another", "stars": 3}}), "no JSON"]
    frame = spark.createDataFrame(list(enumerate(bodies)), "body_id long, body string")
    for service in ("ajio", "flipkart"):
        found = api.api_reviews(frame, service)
        assert "parse_json" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((r["body_id"], r["text"], r["rating"]) for r in found.collect()) == [(0, "a fine thing", 4.0), (1, "another", 3.0)]
