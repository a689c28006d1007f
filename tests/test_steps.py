"""Steps that several queries share: done once, on all parts."""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from catalog import analytics, extraction
from trustgrain.operators import keywords, models, skew
from trustgrain.operators.extract import api, cards, embedded, markup


def test_one_row_group_is_dealt_over_all_parts(spark):
    rows = spark.range(100).coalesce(1)
    assert rows.rdd.getNumPartitions() == 1
    assert skew.dealt(rows).rdd.getNumPartitions() == skew.spread_over(rows)


def test_choices_are_listed_once_for_all_products():
    words = ["a", "b", "c", "a b", "b c", "c d"]
    first = keywords.least_alike(words, 4)
    before = keywords._left_out.cache_info().hits
    assert keywords.least_alike([w.upper() for w in words], 4) == first
    assert keywords._left_out.cache_info().hits == before + 1


def test_selectors_are_taken_apart_once():
    page = markup.tree('<div class="a"><i id="x"> one </i></div><div class="a"><i id="x">two</i></div>')
    assert markup.first_text(page, ["div.a #x"]) == "one"
    before = markup._tests.cache_info().misses
    assert markup.first_text(page, ["div.a #x"]) == "one" and len(markup.select(page, "div.a #x")) == 2
    assert markup._tests.cache_info().misses == before


def test_scripts_of_a_page_are_read_once_in_small_batches(spark):
    html = '<script id="__NEXT_DATA__"> {"a": 1} </script><script>window.__myx = {"b": [2]}; x</script><script>var y = 1</script>'
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    key, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    before = spark.conf.get(key, default)
    spark.conf.set(key, default)
    try:
        found = embedded.state_documents(pages)
        assert spark.conf.get(key) != default
        assert {(r["page_id"], r["doc"]) for r in found.collect()} == {(1, '{"a": 1}'), (1, '{"b": [2]}')}
        assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    finally:
        spark.conf.set(key, before)


def test_pages_are_made_once_for_all_readings(spark, tmp_path):
    ld = '<script type="application/ld+json">{"review": [{"reviewBody": "good thing", "reviewRating": {"ratingValue": 4}}]}</script>'
    pages = spark.createDataFrame([(1, "https://www.ajio.com/p/1", ld)], "page_id int, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages")
    found = cards.extract_reviews(spark.read.parquet(f"{tmp_path}/pages"))
    assert not [f for f in found.inputFiles() if str(tmp_path) in f]
    assert [(r["reading"], r["text"]) for r in found.select("reading", F.col("text")).collect()] == [("jsonld", "good thing")]


def test_levels_of_a_document_are_opened_in_its_row(spark):
    """Objects nested deeper than one pass goes are found in order, and no level is sent over a shuffle with what lies below it."""
    inner = {"text": "innermost", "rating": 1}
    for _ in range(2 * embedded.LEVELS):
        inner = {"list": [None, "text", inner]}
    doc = {"z": [{"text": "second", "rating": 4, "deep": {"text": "third", "rating": 5}}], "a": {"_": True, "text": "first", "stars": "3 stars"}, "zz": inner}
    docs = spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps([[doc["a"]]])), (3, "no JSON"), (4, None)], "i int, doc string")
    found = embedded.deep_reviews(docs, ["i"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "UnionLoop" not in plan and plan.count("Exchange hashpartitioning") == 1
    rows = [tuple(r) for r in found.select("i", "pos", "text", "rating").orderBy("i", "pos").collect()]
    assert rows == [(1, 0, "first", 3.0), (1, 1, "second", 4.0), (1, 2, "third", 5.0), (1, 3, "innermost", 1.0), (2, 0, "first", 3.0)]


def test_pages_said_in_deep_objects_are_found(spark):
    inner = {"totalPages": 5}
    for _ in range(embedded.LEVELS + 1):
        inner = {"x": [inner]}
    bodies = spark.createDataFrame([(1, json.dumps(inner), 3), (2, json.dumps(inner), 5), (3, None, 1)], "body_id int, body string, page int")
    assert sorted(tuple(r) for r in api.more_pages(bodies).collect()) == [(1, True), (2, False), (3, False)]


def test_blocks_have_as_many_parts_as_documents_are_read_in(spark, tmp_path):
    rows = [{"doc_id": i, "text": f"text {i}", "lang": "en", "source": f"src{i % 2}", "n_chars": i} for i in range(400)]
    pq.write_table(pa.Table.from_pylist(rows), f"{tmp_path}/documents.parquet")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
        found = extraction.blocks(spark, str(tmp_path))
        assert found.rdd.getNumPartitions() > skew.spread_over(found)
        assert sorted((r["body_id"], len(r["items"])) for r in found.collect()) == sorted((f"src{s}-{b}", 40) for s in range(2) for b in range(5))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_terms_are_counted_once_for_both_classifiers(spark, tmp_path):
    """Scores are those of models that read the texts themselves, but texts are read by the counting alone."""
    docs = [{"doc_id": i, "text": f"{'fine good' if i % 2 else 'poor bad'} thing {'rude ' * (i % 3)}number {i}", "lang": "en", "source": "s", "n_chars": i} for i in range(40)]
    marks = [{"doc_id": i, "quality": i % 2, "toxic": int(i % 3 > 0)} for i in range(30)]
    for name, rows in (("documents", docs), ("labels", marks)):
        pq.write_table(pa.Table.from_pylist(rows), f"{tmp_path}/{name}.parquet")
    found = analytics.score_reviews(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "term-counts" in plan
    texts = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text")
    labelled = texts.join(spark.read.parquet(f"{tmp_path}/labels.parquet"), "doc_id")
    scored = models.classify(models.fit_classifier(labelled, "toxic"), texts, ["Human", "AI Generated"], "ai")
    scored = models.classify(models.fit_classifier(labelled, "quality"), scored, ["negative", "positive"], "sentiment")
    want = {r["doc_id"]: (r["sentiment_label"], r["ai_label"], r["ai_conf"], (r["ai_conf"] + r["sentiment_conf"] + 0.5) / 3) for r in scored.collect()}
    got = {r["doc_id"]: r for r in found.collect()}
    assert sorted(got) == sorted(want) == list(range(40))
    for i, (feeling, ai, ai_conf, sure) in want.items():
        assert got[i]["sentiment"] == feeling and got[i]["predicted_rating"] == 3
        assert abs(got[i]["ai_probability"] - (ai_conf if ai == "AI Generated" else 1 - ai_conf)) < 1e-3
        assert abs(got[i]["confidence"] - sure) < 1e-3
