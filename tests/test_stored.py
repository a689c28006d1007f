"""Tables by batch, keys seen for good, pages by index, erasure by file, crawl rules by prefix."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from trustgrain.operators import governance, sites, usage
from trustgrain.streaming import sinks, streams
from trustgrain.streaming.seen import SeenKeys


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    rows = spark.range(10).select("id", F.lit("x").alias("what"))
    path = f"{tmp_path}/t"
    for batch, df in ((0, rows), (1, rows.limit(3)), (0, rows), (1, rows.limit(4))):
        sinks.write_batch(df, path, batch)
    assert sinks.read_batches(spark, path, rows.schema).count() == 14
    rows.write.parquet(f"{path}/data/{sinks.BATCH}=2")  # a batch that was broken off before its end
    assert sinks.read_batches(spark, path, rows.schema, keep_batch=True).groupBy(sinks.BATCH).count().count() == 2


def test_a_replayed_micro_batch_adds_nothing(spark, tmp_path):
    schema = spark.range(1).select("id", F.lit("a").alias("product_id")).schema
    source, path, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    for i in range(3):
        spark.range(5 * i, 5 * i + 5).select("id", F.lit("a").alias("product_id")).coalesce(1).write.parquet(f"{source}/part={i}")
        stream = streams.read_events(spark, source, schema, files_per_trigger=1)
        sinks.run_batches(stream, path, state)
    once = sinks.read_batches(spark, path, schema, keep_batch=True)
    assert once.count() == 15 and once.select(sinks.BATCH).distinct().count() == 3
    again = once.filter(F.col(sinks.BATCH) == 1).drop(sinks.BATCH).collect()
    sinks.write_batch(spark.createDataFrame(again, schema), path, 1)
    assert sinks.read_batches(spark, path, schema).count() == 15


def test_seen_keys_find_what_came_long_before(spark, tmp_path):
    seen = SeenKeys(spark, f"{tmp_path}/seen", buckets=4)

    def new(batch, *ids):
        keys = spark.createDataFrame([(f"k{i}",) for i in ids], "key string")
        return {r["key"] for r in seen.add_new(keys, "key", batch).collect()}

    assert new(0, *range(50), 3, 4) == {f"k{i}" for i in range(50)}
    assert new(1, *range(40, 60)) == {f"k{i}" for i in range(50, 60)}
    assert new(1, *range(40, 60)) == {f"k{i}" for i in range(50, 60)}  # run again
    assert new(2, 7, 55, 99) == {"k99"}
    keys = spark.createDataFrame([(f"other{i}",) for i in range(2000)], "key string")
    assert seen.maybe_seen(keys, "key", 3).count() < 20  # the filter spares nearly all look-ups


def test_repeats_after_the_watermark_are_found(spark, tmp_path):
    """A repeat forty days later, in another run of the stream."""
    columns = "product_id string, review_id string, text string, rating double, created_at timestamp"
    batches = [
        [("p", "", "good", 5.0, "2024-01-01 00:00:00"), ("p", "", "good", 5.0, "2024-01-01 01:00:00"), ("q", "", "good", 5.0, "2024-01-01 00:00:00")],
        [("p", "", "other", 5.0, "2024-02-10 00:00:00")],
        [("p", "", "good", 5.0, "2024-02-11 00:00:00"), ("p", "r1", "good", 5.0, "2024-02-11 00:00:00")],
    ]
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, columns.replace("timestamp", "string")).withColumn("created_at", F.to_timestamp("created_at"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
        arriving = streams.read_events(spark, f"{tmp_path}/in", df.schema, files_per_trigger=1)
        kept = streams.dedupe_for_good(arriving, f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted((r["product_id"], r["review_id"], r["text"], str(r["created_at"])) for r in kept.collect())
    assert [g[:3] for g in got] == [("p", "", "good"), ("p", "", "other"), ("p", "r1", "good"), ("q", "", "good")]
    assert got[0][3] == "2024-01-01 00:00:00"


def test_closed_periods_are_appended_once(spark, tmp_path):
    rows = [(i, f"/{i % 3}", f"2024-01-{1 + i // 24:02} {i % 24:02}:30:00") for i in range(240)]
    events = spark.createDataFrame(rows, "id long, endpoint string, ts string").withColumn("ts", F.to_timestamp("ts"))
    counts = streams.replay(events, "closed", lambda e: streams.stream_visit_counts(e, "ts"), files=5)
    got = counts.collect()
    assert len(got) == 240 and {r["visits"] for r in got} == {1}


def test_pages_far_back_read_their_own_rows(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("k"))
    order = [F.desc("k"), F.asc("id")]
    index = usage.PageIndex(rows, order, f"{tmp_path}/pages", rows_per_part=90)
    want = [r["id"] for r in rows.orderBy(*order).collect()]
    assert len(index.parts) > 5 and sum(n for _, n in index.parts) == 1000
    for page, size in ((0, 25), (3, 100), (9, 100), (10, 100), (33, 30), (40, 25)):
        assert [r["id"] for r in index.page(page, size).collect()] == want[page * size : page * size + size]
    assert index.page(0, 10).columns == rows.columns
    assert usage.PageIndex(rows.limit(0), order, f"{tmp_path}/none").page(0, 10).count() == 0


def test_parts_of_a_listing_do_not_grow_with_it(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("k"))
    order = [F.desc("k"), F.asc("id")]
    index = usage.PageIndex(rows, order, f"{tmp_path}/pages", rows_per_part=2)
    assert len(index.parts) <= usage.MOST_PARTS and sum(n for _, n in index.parts) == 1000
    want = [r["id"] for r in rows.orderBy(*order).collect()]
    assert [r["id"] for r in index.page(7, 99).collect()] == want[693:792]


def test_maps_of_users_are_made_of_distinct_users(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 5).alias("user_id"), F.col("id").alias("n"))
    table = governance.UserFiles.create(rows, f"{tmp_path}/t", files=2)
    plan = table._added(rows, 9)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2
    assert table.concerned(spark.createDataFrame([(3,)], "user_id long"))


def test_erasing_rewrites_only_files_that_hold_the_user(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") % 500).alias("user_id"), F.col("id").alias("n"))
    table = governance.UserFiles.create(rows, f"{tmp_path}/t")
    files = {r["file"] for r in table.files().select("file").distinct().collect()}
    hit = table.erase(spark.createDataFrame([(7,), (7,), (100_000,)], "user_id long"))
    assert 1 <= len(hit) < len(files)
    left = {r["file"] for r in table.files().select("file").distinct().collect()}
    assert files - set(hit) < left and not set(hit) & left
    assert table.read().count() == 20_000 - 40 and table.read().filter("user_id = 7").count() == 0
    table.drop_replaced(hit)
    assert table.erase(spark.createDataFrame([(7,)], "user_id long")) == []
    assert table.read().select(F.sum("n")).first()[0] == sum(n for n in range(20_000) if n % 500 != 7)


def test_first_rule_that_fits(spark):
    rng = random.Random(1)
    rules = [("h", i, "/" + "".join(rng.choice("ab") for _ in range(rng.randrange(0, 7))), rng.random() < 0.5) for i in range(60)]
    rules += [("g", 1, "", True), ("g", 2, "/x", False)]
    urls = [(i, "http://h/" + "".join(rng.choice("abc") for _ in range(rng.randrange(0, 9)))) for i in range(300)]
    urls += [(1000, "http://g/x"), (1001, "http://h"), (1002, "http://none/x")]
    status = spark.createDataFrame([("h", 200), ("g", 200)], "host string, fetch_status int")
    got = sites.robots_filter(
        spark.createDataFrame(urls, "url_id long, url string"), spark.createDataFrame(rules, "host string, rule_no int, prefix string, allow boolean"), status
    )
    for r in got.collect():
        host, _, path = r["url"].removeprefix("http://").partition("/")
        fitting = [x for x in rules if x[0] == host and f"/{path}".startswith(x[2])]
        assert r["allowed"] == (min(fitting, key=lambda x: x[1])[3] if fitting else host != "none"), r


def test_history_of_a_user_is_decrypted_for_the_page_alone(spark):
    from trustgrain.functions import crypto

    reviews = spark.range(50).select(
        F.concat(F.lit("r"), "id").alias("id"), (F.col("id") % 2).alias("user_id"), crypto.encrypt(F.concat(F.lit("text "), "id"), "s").alias("review_text"),
        F.lit(10).alias("authenticity_score"), F.timestamp_seconds(F.col("id") * 10).alias("created_at"),
    )
    links = spark.range(50).select(F.concat(F.lit("l"), "id").alias("id"), (F.col("id") % 2).alias("user_id"), F.timestamp_seconds(F.col("id") * 10).alias("created_at"))
    page = usage.user_history(reviews, links, 1, page=1, size=7, secret="s").collect()
    assert [r["id"] for r in page] == ["l43", "r41", "l41", "r39", "l39", "r37", "l37"]
    assert [r["review_text"] for r in page if r["id"][0] == "r"] == ["text 41", "text 39", "text 37"]
