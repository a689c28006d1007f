"""Uneven data, very long texts and rows of every odd kind, for the operators and each stage of the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import math
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from trustgrain.llm import ann, arc, hosts, mixing, packing, quality, queries, secrets

FOLDER = "/root/testdata/sf0.01"


# nearest neighbours


def test_outliers_among_groups_get_all_their_neighbours(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal((1, 64)) + 0.01 * rng.standard_normal((100, 64)) for _ in range(60)])
    every = np.zeros((6060, 64))
    outlier = np.zeros(6060, dtype=bool)
    outlier[::101] = True
    every[outlier], every[~outlier] = rng.standard_normal((60, 64)), x[rng.permutation(6000)]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(6060), "embedding": list(every)}))
    got = defaultdict(list)
    for r in ann.nearest_neighbours(df, F.col("id") % 101 == 0).collect():
        got[r["query_id"]].append(r["vec_id"])
    hits = 0
    for q in range(0, 6060, 101):
        away = ((every - every[q]) ** 2).sum(1)
        away[q] = np.inf
        assert len(set(got[q])) == 10
        hits += len(set(np.argsort(away)[:10].tolist()) & set(got[q]))
    assert hits >= 0.9 * 600


def test_fewer_vectors_than_neighbours(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    got = Counter(r["query_id"] for r in ann.nearest_neighbours(df).collect())
    assert got == {i: 3 for i in range(4)}


def test_least_distance_is_a_bound():
    rng = np.random.default_rng(1)
    members = rng.standard_normal((500, 8))
    radius = np.sqrt((members**2).sum(1)).max()
    for _ in range(50):
        query = rng.standard_normal(8) * rng.uniform(0, 5)
        d = np.sqrt((query**2).sum())
        assert ann.least_distance(np.array([d]), np.array([radius]), 1.0)[0] <= np.sqrt(((members - query) ** 2).sum(1)).min() + 1e-9


# quality


def test_scores_of_some_texts_by_hand(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = quality.fit_classifier(quality.labelled_texts(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")))
    got = {r["doc_id"]: r["score"] for r in queries.op2_quality(spark, FOLDER).collect()}
    rows = docs.filter("doc_id % 50 = 0").collect()
    for r in [*rows, *docs.orderBy(F.desc("n_chars")).limit(2).collect()]:
        data = (r["text"] or "").encode()
        sizes = []
        for dictionary in (model.good, model.bad):
            zdict = zstandard.ZstdCompressionDict(dictionary)
            zdict.precompute_compress(level=3)
            c = zstandard.ZstdCompressor(dict_data=zdict, level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(data[i : i + 2048])) for i in range(0, len(data), 2048)))
        n = max(len(data), 1)
        a, b, c = model.coefficients
        want = 1 / (1 + math.exp(-(a + b * (sizes[1] - sizes[0]) / n + c * (sizes[1] + sizes[0]) / (2 * n))))
        assert abs(got[r["doc_id"]] - want) < 1e-12


def test_clashing_columns_are_replaced(spark, odd_docs):
    labels = spark.createDataFrame([(3, 1), (4, 0), (5, 1)], "doc_id long, quality int")
    got = quality.classify(odd_docs, labels)
    assert sorted(got.columns) == sorted(odd_docs.columns)
    for r in got.collect():
        assert r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


# secrets


def test_very_many_matches_in_one_text(spark):
    n = 32_000
    text = "é " + " ".join("0123456789abcdef" * 2 for _ in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    secrets.secret_digest(secrets.scan_secrets(df.limit(0))).collect()
    start = time.perf_counter()
    got = secrets.secret_digest(secrets.scan_secrets(df)).collect()[0]
    assert time.perf_counter() - start < 10
    spans = ",".join(f"hex:{2 + 33 * i}:{2 + 33 * i + 32}" for i in range(n))
    assert got["n_hex"] == n and got["spans"] == spans
    assert got["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()


@pytest.mark.parametrize("n", [255, 256, 257, 512, 513])
def test_positions_across_runs(spark, n):
    text = " x ".join(f"token={'a' * (3 + i % 9)}" for i in range(n))
    got = secrets.secret_digest(secrets.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()[0]
    want, at = [], 0
    for i in range(n):
        size = 6 + 3 + i % 9
        want += [f"assign:{at}:{at + size}"] if 3 + i % 9 >= 6 else []
        at += size + 3
    assert got["spans"] == ",".join(want)


# packing


@pytest.mark.parametrize("blank", [" ", "\n"])
def test_a_million_blanks(spark, blank):
    from tokenizers import Tokenizer

    text = "a" + blank * 1_000_000 + "b <|endoftext|> c"
    df = spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string")
    got = packing.token_pieces(df, queries.TOKENIZER, queries.PATTERN, tokens=True).orderBy("doc_id", "piece").collect()
    ids = [i for r in got if r["doc_id"] == 1 for i in r["ids"]]
    assert ids == [*Tokenizer.from_file(queries.TOKENIZER).encode(text, add_special_tokens=False).ids, packing.END]
    assert [r["start"] for r in got if r["doc_id"] == 1][1:] == np.cumsum([r["length"] for r in got if r["doc_id"] == 1])[:-1].tolist()


# archives


def test_archives_end_by_bytes(spark, tmp_path):
    size = arc.BYTES_PER_FILE // 10
    data = [(i, f"http://h/{i}", "x" * size + str(i % 20)) for i in range(40)] + [(99, "http://h/big", "y" * (20 * size))]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").coalesce(1)
    archives = [(len(r["content"]), b"yyy" in r["content"]) for r in arc.archive_pages(pages).collect()]
    assert len(archives) >= 5 and all(n < 1.1 * arc.BYTES_PER_FILE for n, big in archives if not big)
    arc.write_warc(arc.to_warc(arc.page_records(pages)), f"{tmp_path}/w")
    sizes = sorted(len(gzip.decompress(p.read_bytes())) for p in Path(f"{tmp_path}/w").glob("*.gz"))
    assert sizes[-2] < 1.1 * arc.BYTES_PER_FILE and 20 * size < sizes[-1] < 21 * size
    back = arc.resolve_revisits(arc.read_warc(spark, f"{tmp_path}/w").filter("record_type in ('response', 'revisit')")).collect()
    assert {r["id"]: r["refers_to_id"] for r in back} == {**{i: None if i < 20 else i % 20 for i in range(40)}, 99: None}
    assert {r["payload_bytes"] for r in back} == {size + 1, size + 2, 20 * size} and all(r["error"] is None for r in back)


def test_one_payload_on_all_pages(spark, tmp_path):
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), F.lit("").alias("html"))
    arc.write_warc(arc.to_warc(arc.page_records(pages)), f"{tmp_path}/w")
    back = arc.resolve_revisits(arc.read_warc(spark, f"{tmp_path}/w").filter("record_type in ('response', 'revisit')"))
    got = back.groupBy("record_type", "refers_to_id", "payload_bytes").count().collect()
    assert sorted(tuple(r) for r in got if r[0] == "revisit") == [("revisit", 0, 0, 1999)]
    assert [tuple(r) for r in got if r[0] == "response"] == [("response", None, 0, 1)]


# hosts


def test_registered_domains(spark):
    cases = {
        "a.b.example.com:80": ("example.com", "com"),
        "www.shop.co.uk": ("shop.co.uk", "co.uk"),
        "co.uk": ("co.uk", "co.uk"),
        "me.github.io": ("me.github.io", "github.io"),
        "x.me.github.io": ("me.github.io", "github.io"),
        "192.168.0.1:8080": ("192.168.0.1", "address"),
        "[2001:db8::1]:443": ("[2001:db8::1", "address"),
        "1.2.3.4.5": ("4.5", "5"),
        "localhost": ("localhost", "localhost"),
        "": ("", ""),
    }
    df = spark.createDataFrame([(h,) for h in cases], "host string")
    domain, suffix = hosts.registered_domain(F.col("host"))
    got = {r["host"]: (r["d"], r["s"]) for r in df.select("host", domain.alias("d"), suffix.alias("s")).collect()}
    assert got == cases


def test_sites_below_one_suffix_do_not_share_evidence(spark):
    data = [("bad.github.io", 1)] * 300 + [("new.github.io", None)] + [("fine.github.io", 0)] * 300 + [("sub.bad.github.io", None)]
    data += [("10.0.0.1", 1)] * 300 + [("10.0.0.2", None)] + [("10.0.0.3", 0)] * 300
    got = {r["host"]: r for r in hosts.host_reputation(spark.createDataFrame(data, "host string, bad int")).collect()}
    assert got["bad.github.io"]["blocked"] and got["10.0.0.1"]["blocked"]
    assert not any(got[h]["blocked"] for h in ("new.github.io", "fine.github.io", "10.0.0.2"))
    assert got["sub.bad.github.io"]["mean"] > got["new.github.io"]["mean"]


def test_certainty_against_the_beta_distribution(spark):
    def tail(x, a, b, n=20_000):
        power = max(1.0, 2 / a)
        u = np.linspace(0, 1, 2 * n + 1)[1:]
        t = x * u**power
        f = np.append(0, power * x**a * u ** (power * a - 1) * (1 - t) ** (b - 1))
        w = np.ones(2 * n + 1)
        w[1:-1:2], w[2:-1:2] = 4, 2
        return (f * w).sum() / (6 * n) / math.exp(math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b))

    cases = [(a, s - a) for s, most in ((4, 0.002), (8, 0.001), (40, 0.001), (900, 0.001)) for a in np.linspace(0.55, 0.8, 6) * s]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in cases], "a double, b double")
    for r in df.withColumn("z", hosts.certainty(F.col("a"), F.col("b"), 0.5)).collect():
        assert abs(0.5 * math.erfc(r["z"] / math.sqrt(2)) - tail(0.5, r["a"], r["b"])) < 0.002


def test_urls_repeated_rows_long_urls_and_ties(spark):
    long = "http://long.example.org/" + "p/" * 200_000
    data = [(1, long), (1, long), (2, "http://a.org/x"), (None, "http://a.org/y"), (3, None)]
    pages = spark.createDataFrame(data, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "verdict", "label_key")})
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, 0), (None, 0)], "doc_id long, quality int")
    got = hosts.filter_urls(pages, labels).collect()
    assert len(got) == 5 and sorted(len(r["path"]) for r in got) == [0, 2, 2, 400_001, 400_001]
    assert hosts.filter_urls(pages, labels.limit(0)).filter("verdict = 'block'").count() == 0


# pipeline


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_every_stage_on_odd_rows_and_none(spark, odd_docs, no_docs, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    got = run(spark, odd_docs, FOLDER)
    rows = got.collect()
    if stage != "best-fit packing":
        assert got.columns == list(corpus_pipeline.COLUMNS)
        assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in odd_docs.collect()}
    assert run(spark, no_docs, FOLDER).count() == 0
    if stage == "line dedup":
        assert len(rows) == odd_docs.count()
    if stage == "MinHash near-dedup":
        # 4 copies 3; null, empty and blank texts, rows without an id and rows that repeat one stay.
        assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd_docs.collect() if r["doc_id"] not in (4, 6))
    if stage == "mixing sources to target weights":
        assert sum(Counter(r["doc_id"] for r in rows).values()) == sum(r["copies"] for r in mixing.mix(odd_docs).collect())
    if stage == "best-fit packing":
        pairs = packing.BytePairs(queries.TOKENIZER, queries.PATTERN)
        assert sum(r["length"] for r in rows) == sum(len(pairs.ids(r["text"] or "")) + 1 for r in odd_docs.collect())
