"""Functions for SQL text, and the search through JSON of unknown shape."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from trustgrain import sql
from trustgrain.functions import text
from trustgrain.operators.extract import api, embedded


def test_functions_equal_the_columns(spark):
    values = ["  a  b Read More ", "3.5 out of 5", "9 stars", "", None, "3 May 2024", "https://www.A.com/x", "नमस्ते दुनिया", "\\s 'quoted' \"x\""]
    df = spark.createDataFrame([(v,) for v in values], "x string")
    calls = ", ".join(f"{name}(x) AS {name}" for name in sql.FUNCTIONS)
    got = sql.query(spark, f"SELECT x, {calls} FROM sql_values", sql_values=df).collect()
    want = df.select("x", *[build(F.col("x")).alias(name) for name, (build, _) in sql.FUNCTIONS.items()]).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sql.expression(text.parse_rating(F.col("y")), spark, y="string").count("y") >= 1


def test_table_function_keeps_other_columns(spark):
    rows = [(1, '{"a": [{"text": "one", "rating": 4}, {"text": "two", "stars": "2 of 5"}]}', "x"), (2, "no json", "y"), (3, None, "z")]
    docs = spark.createDataFrame(rows, "id long, body string, note string")
    got = sql.query(spark, "SELECT * FROM reviews_in(TABLE(sql_docs), 'body')", sql_docs=docs)
    assert got.columns == ["id", "note", "pos", "text", "rating"]
    assert sorted(map(tuple, got.collect())) == [(1, "x", 0, "one", "4"), (1, "x", 1, "two", "2")]
    with pytest.raises(Exception, match="no column missing"):
        sql.query(spark, "SELECT * FROM reviews_in(TABLE(sql_docs), 'missing')", sql_docs=docs).collect()


def nest(rng, depth):
    if depth == 0 or rng.random() < 0.15:
        return rng.choice([1, "x", None, True, 2.5])
    if rng.random() < 0.4:
        return [nest(rng, depth - 1) for _ in range(rng.randrange(4))]
    node = {f"k{i}": nest(rng, depth - 1) for i in range(rng.randrange(4))}
    if rng.random() < 0.5:
        node[rng.choice(embedded.TEXT_KEYS)] = rng.choice(["good", " ", "", 5, "fine words", ["no"]])
    if rng.random() < 0.5:
        node[rng.choice(embedded.RATING_KEYS)] = rng.choice([4, "3.5 stars", 7, None, {"a": 1}, "none", 0.5])
    if rng.random() < 0.2:
        node["reviewRating"] = rng.choice([{"ratingValue": 2}, {"ratingValue": "9"}, 3, {}])
    return node


def in_order(node):
    """The same document with the members of objects in order of their names."""
    if isinstance(node, dict):
        return {k: in_order(node[k]) for k in sorted(node)}
    return [in_order(x) for x in node] if isinstance(node, list) else node


def test_deep_search_equals_a_plain_walk(spark):
    rng = random.Random(4)
    docs = [nest(rng, 6) for _ in range(150)] + [{"list": [{"text": f"review {i}", "rating": 1 + i % 5} for i in range(3000)]}]
    deep = {"text": "deep", "rating": 5}
    for _ in range(40):
        deep = {"m": [deep]}
    docs.append(deep)
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(-1, "{"), (-2, None), (-3, " ")], "id long, doc string")
    got = {}
    for r in embedded.deep_reviews(df, ["id"]).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append((r["text"], r["rating"]))
    want = {}
    for i, d in enumerate(docs):
        found = [(x["text"].strip(), float(x["rating"])) for x in embedded._reviews_in(in_order(d), 1)]
        if found:
            want[i] = found
    assert got == want and len(got[150]) == 3000 and got[151] == [("deep", 5.0)]
    assert {r["id"] for r in embedded.unreadable_documents(df, ["id"]).collect()} == {-1, -2, -3}


def test_repeats_in_a_body_go_and_pages_follow(spark):
    items = [{"reviewText": "good thing", "rating": 5}, {"reviewText": "Good thing!", "rating": 5}, {"reviewText": "good thing", "rating": 4}]
    bodies = spark.createDataFrame([(1, json.dumps({"reviews": items})), (2, json.dumps({"page": {"x": items}})), (3, "<html>")], "body_id long, body string")
    got = [(r["body_id"], r["text"], r["rating"]) for r in api.api_reviews(bodies, "ajio").orderBy("body_id", "pos").collect()]
    assert got == [(1, "good thing", 5.0), (1, "good thing", 4.0), (2, "good thing", 5.0), (2, "good thing", 4.0)]
    facts = [({"a": {"totalPages": 4}}, True), ({"totalPages": 3}, False), ({"total": 31}, True), ({"total": 30}, False), ({"total": "99"}, False), ({"total": 40, "pageSize": 20}, False), ([{"totalCount": 0, "total": 50}], True), ({}, False)]
    asked = spark.createDataFrame([(i, json.dumps(f), 3) for i, (f, _) in enumerate(facts)], "body_id long, body string, page int")
    assert {r["body_id"]: r["more"] for r in api.more_pages(asked).collect()} == {i: more for i, (_, more) in enumerate(facts)}
