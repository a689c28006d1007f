"""The report on random small products against a plain evaluation, and what must hold for any input."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import brute
from trustgrain import session
from trustgrain.operators import duplicates, similarity
from trustgrain.plans import report

BASE = dt.date(2024, 1, 1)
WORDS = "battery screen sound camera great poor arrived late box cheap value seller strap colour bright weak heavy".split()
SCHEMA = (
    "product_id string, review_idx long, text string, rating double, review_date date, sentiment string, confidence double"
)


def product(rng, pid):
    """Each product leans towards some of the branches: copies, bursts, few stars, uniform lengths, missing values."""
    n = rng.choice([1, 2, 3, 4, 5, 6, 10, 20, 40])
    copy, hot, fixed, stars = rng.random(), rng.random(), rng.random() < 0.3, rng.choice(["any", "ends", "one", "even"])
    texts, rows = [], []
    for i in range(n):
        if texts and rng.random() < copy * 0.6:
            words = list(rng.choice(texts))
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
        else:
            words = [rng.choice(WORDS + ["the", "is", f"item{rng.randrange(30)}"]) for _ in range(10 if fixed else rng.randint(1, 25))]
        texts.append(words)
        rating = {
            "any": lambda: float(rng.randint(1, 5)),
            "ends": lambda: rng.choice([1.0, 5.0, 5.0, 5.0, 3.5]),
            "one": lambda: 5.0 if rng.random() < 0.95 else 4.0,
            "even": lambda i=i: float(1 + i % 5),
        }[stars]()
        rows.append(
            {
                "idx": i * 3 + 1,
                "text": rng.choice([None, "", "   "]) if rng.random() < 0.05 else " ".join(words),
                "rating": None if rng.random() < 0.05 else rating,
                "day": None if rng.random() < 0.1 else (rng.randint(10, 12) if rng.random() < hot else rng.randint(0, 60)),
                "sentiment": rng.choice(["positive", "negative", "neutral"]),
                "confidence": rng.choice([None, 0.5, 0.55, 0.9]),
            }
        )
    return pid, rows


@pytest.fixture(scope="module")
def products():
    rng = random.Random(7)
    return dict(product(rng, f"p{i}") for i in range(150))


@pytest.fixture(scope="module")
def frame(spark, products):
    rows = [
        (p, r["idx"], r["text"], r["rating"], None if r["day"] is None else BASE + dt.timedelta(r["day"]), r["sentiment"], r["confidence"])
        for p, rs in products.items()
        for r in rs
    ]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def test_report_equals_plain_evaluation(frame, products):
    got = {r["product_id"]: r for r in report.trust_report(frame).collect()}
    assert set(got) == {p for p, rs in products.items() if len(rs) >= 3}
    reached = set()
    for p, row in got.items():
        score, parts = brute.report(products[p])
        for name, (detected, severity, points) in parts.items():
            d = row[name]
            assert (d["detected"], d["severity"], d["score"]) == (detected, severity, points), (p, name, d)
            reached.add((name, severity if detected else "clean"))
        assert row["trust_score"] == score, p
        assert row["issues_found"] == sum(x[0] for x in parts.values())
    # The random products must have reached the branches, or the comparison says little.
    for name in brute.DETECTORS:
        assert (name, "clean") in reached and len([x for x in reached if x[0] == name]) >= 2, (name, reached)


def test_flagged_reviews_equal_plain_evaluation(frame, products):
    got = {(r["product_id"], r["detector"], r["review_idx"]) for r in report.flagged_reviews(frame).collect()}
    for p, rows in products.items():
        texts = {r["idx"]: r["text"] or "" for r in rows}
        if sum(len(t.split()) >= 5 for t in texts.values()) >= 3:
            mine = {i for q, d, i in got if q == p and d == "duplicate_content"}
            assert mine == set(brute.clusters(texts)), p
        kept, where = brute.repeated(rows)
        assert {i for q, d, i in got if q == p and d == "phrase_repetition"} == {i for k in kept for i in where[k]}, p


def test_similar_pairs_equal_brute_force(frame, products):
    weights = similarity.term_weights(similarity.token_bags(frame.filter(F.col("text").isNotNull())))
    got = {(r["product_id"], r["a"], r["b"]): r["sim"] for r in similarity.similar_pairs(weights).collect()}
    for p, rows in products.items():
        texts = {r["idx"]: r["text"] for r in rows if r["text"]}
        bags = {}
        for i, v in sorted(brute.vectors(texts).items()):
            bags.setdefault(tuple(sorted(v.items())), i)
        want = {k: s for k, s in brute.pairs(texts).items() if k[0] in bags.values() and k[1] in bags.values()}
        mine = {(a, b): s for (q, a, b), s in got.items() if q == p}
        assert mine.keys() == want.keys(), p
        assert all(abs(mine[k] - want[k]) < 1e-9 for k in want)


def test_chain_of_near_copies_is_one_cluster(spark):
    words = [f"word{i}" for i in range(30)]
    chain = [" ".join(words[i : i + 20]) for i in range(0, 9, 3)]
    far = ["something else entirely was written over here", "nothing of that kind is found in this one"]
    rows = [("p", i, t, 5.0, None, "positive", 0.9) for i, t in enumerate(chain + far)]
    texts = dict(enumerate(chain + far))
    assert (0, 2) not in brute.pairs(texts) and {(0, 1), (1, 2)} <= set(brute.pairs(texts))
    got = duplicates.duplicate_reviews(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["review_idx"], r["cluster"]) for r in got} == {(0, 0), (1, 0), (2, 0)}


def test_copies_without_known_terms_are_no_duplicates(spark):
    rows = [("p", i, "it is that it was for them", 5.0, None, "positive", 0.9) for i in range(6)]
    got = duplicates.detect_duplicates(spark.createDataFrame(rows, SCHEMA)).first()
    assert (got["detected"], got["score"]) == (False, 90)


def test_flagged_arrays_keep_every_review(frame):
    flagged = report.flagged_reviews(frame)
    arrays = report.flagged_arrays(flagged, span=7)
    assert arrays.filter(F.size("review_indices") > 7).isEmpty()
    assert arrays.select(F.sum(F.size("review_indices"))).first()[0] == flagged.count()


def test_every_repeated_phrase_flags_its_reviews(spark):
    """Four reviews share 25 phrases, so three others that share one are beyond the 20 of the list."""
    word = lambda k: "w" + "abcdefghij"[k // 10] + "abcdefghij"[k % 10]
    texts = [" ".join(word(k) for k in range(27))] * 4 + ["xaa xbb xcc"] * 3 + [word(30 + k) for k in range(8)]
    rows = [("p", i, t, 5.0, None, "neutral", None) for i, t in enumerate(texts)]
    flagged = report.flagged_reviews(spark.createDataFrame(rows, SCHEMA), every_phrase=True).filter("detector = 'phrase_repetition'")
    assert sorted(r["review_idx"] for r in flagged.collect()) == list(range(7))


def test_pairs_and_members_give_all_similar_reviews(frame, products):
    """Pairs of representatives, carried over to their members, and the pairs inside a bag are all pairs there are."""
    known = frame.filter(F.col("text").isNotNull())
    weights = similarity.term_weights(similarity.token_bags(known))
    links = [(r["product_id"], r["a"], r["b"]) for r in similarity.similar_pairs(weights).collect()]
    members = {}
    for r in similarity.bag_members(known).collect():
        members.setdefault((r["product_id"], r["representative"]), []).append(r["review_idx"])
    got = {(p, *sorted((x, y))) for p, a, b in links for x in members[p, a] for y in members[p, b]}
    got |= {(p, x, y) for (p, _), bag in members.items() for x in bag for y in bag if x < y}
    want = {(p, *k) for p, rows in products.items() for k in brute.pairs({r["idx"]: r["text"] for r in rows if r["text"]})}
    assert got == want and len(want) > len(links)


def test_blocks_connect_what_all_pairs_connect(spark, monkeypatch):
    """Products of several blocks: short reviews out of few words, and a large group of near copies."""
    rng = random.Random(7)
    words = [f"word{i}" for i in range(30)]
    rows = [("p" if i % 4 else "q", i, " ".join(rng.sample(words, rng.randrange(5, 8)))) for i in range(500)]
    near = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows += [("p", 1000 + i, f"{near} {rng.choice(words)}") for i in range(200)]
    df = spark.createDataFrame(rows, "product_id string, review_idx long, text string")

    def clusters():
        return {(r["product_id"], r["bag_id"]): r["cluster"] for r in duplicates.clustered_bags(df).collect()}

    whole = clusters()
    monkeypatch.setattr(similarity.connecting_pairs, "__defaults__", (similarity.THRESHOLD, 40))
    assert clusters() == whole and len(set(whole.values())) > 3
    weights = similarity.term_weights(similarity.token_bags(df))
    pairs = [{(r["product_id"], r["a"], r["b"]) for r in similarity.similar_pairs(weights, block=b).collect()} for b in (10_000, 60)]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 100


def test_prefixes_miss_no_pair():
    """Pairs found by prefixes, tile by tile and with long lists, are those of the whole product."""
    rng = np.random.default_rng(5)
    n, terms = 1300, 400
    weights = rng.random((n, terms)) * (rng.random((n, terms)) < 40 / (np.arange(terms) + 20))
    weights[::3] = weights[0] + weights[::3] * rng.random((len(weights[::3]), 1))
    weights /= np.sqrt((weights**2).sum(axis=1))[:, None]
    order = np.lexsort((np.arange(terms), (weights > 0).sum(axis=0)))
    ids = [order[weights[r, order] > 0] for r in range(n)]
    ws = [weights[r, i] for r, i in enumerate(ids)]
    for split in (0, 500):
        whole = weights @ weights.T
        i, j = np.nonzero(whole > similarity.THRESHOLD)
        want = {(a, b) for a, b in zip(i, j) if (a < split <= b if split else a < b)}
        found = [x for t in similarity._cosines(ids, ws, split, similarity.THRESHOLD) for x in zip(*t)]
        assert {(a, b) for a, b, _ in found} == want and len(found) == len(want) > 1000
        assert all(abs(whole[a, b] - s) < 1e-9 for a, b, s in found)


def test_products_of_thousands_of_reviews_are_one_block(spark):
    rows = spark.range(6000).selectExpr("'p' product_id", "id doc", "array(named_struct('term_id', id, 'df', 2L, 'w', 1D)) terms")
    counted = similarity._lists(rows).groupBy("product_id").agg(similarity._blocks_of(similarity.BLOCK, F.size("ids")).alias("n"))
    assert counted.first()["n"] == 1


def test_weights_carry_their_terms(spark):
    """Names of terms come with the weights; they are not joined to them again."""
    rows = [("p", i, "alpha beta gamma delta epsilon zeta" + " omega" * (i % 3)) for i in range(4)]
    found = similarity.tfidf(spark.createDataFrame(rows, "product_id string, review_idx long, text string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
    assert {r["term"] for r in found.collect()} == set("alpha beta gamma delta epsilon zeta omega".split())


def _copied_product(spark):
    rng = random.Random(11)
    words = [f"word{i}" for i in range(40)]
    rows = [("p", i, " ".join(rng.sample(words, 6))) for i in range(400)]
    near = " ".join(f"near{i}" for i in range(70))
    rows += [("q", 1000 + i, f"{near} {rng.choice(words)}") for i in range(200)]
    return spark.createDataFrame(rows, "product_id string, review_idx long, text string"), rows


def test_blocks_meet_without_a_shuffle(spark, monkeypatch):
    """Reviews are not sent once per block: blocks are compared where they are read."""
    df, rows = _copied_product(spark)
    plans = []

    def noted(table, name, *rest):
        if name == "pairs":
            plans.append(table._jdf.queryExecution().executedPlan().toString())
        return session.written(table, name, *rest)

    monkeypatch.setattr(similarity, "written", noted)
    monkeypatch.setattr(similarity, "BLOCK_TERMS", 600)
    bags = similarity.numbered_bags(similarity.token_bags(df))
    found = [(r["product_id"], r["a"], r["b"]) for r in similarity.similar_pairs(bags, block=50).collect()]
    assert len(plans) > 4 and not any("Exchange" in p for p in plans)
    want = set()
    for product in "pq":
        texts = {i: t for p, i, t in rows if p == product}
        firsts = {" ".join(sorted(t.split())): i for i, t in reversed(texts.items())}
        want |= {(product, *k) for k in brute.pairs(texts) if set(k) <= set(firsts.values())}
    assert len(found) == len(set(found)) > 100 and set(found) == want


def test_written_tables_leave_no_shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {name for name in manager.getAllBlocks().mkString(" ").split() if name.startswith("shuffle_")}
    before = shuffled()
    rows = session.written(spark.range(1000).repartition(7, "id"), "rows")
    assert shuffled() <= before and rows.count() == 1000


def test_clusters_leave_no_vectors_behind(spark, tmp_path, monkeypatch):
    df, _ = _copied_product(spark)
    monkeypatch.setattr(session, "work_root", lambda spark: str(tmp_path))
    found = duplicates.clustered_bags(df).groupBy("product_id", "cluster").agg(F.count(F.lit(1)).alias("n"))
    assert max(r["n"] for r in found.collect()) > 10
    left = {p.name.rsplit("-", 1)[0] for p in (tmp_path / "trustgrain").iterdir()}
    assert not left & {"vectors", "vocabulary", "part-terms", "term-lists"}


def test_reviews_of_one_number_are_one_vector(spark):
    """Two texts of one number and product count together, in whatever block."""
    long = "alpha beta gamma delta epsilon zeta"
    rows = [("p", 1, long), ("p", 1, "eta theta iota kappa lambda omega"), ("p", 2, f"{long} eta theta iota kappa lambda omega"), ("p", 3, "nothing of that was ever written anywhere here")]
    bags = similarity.numbered_bags(similarity.token_bags(spark.createDataFrame(rows, "product_id string, review_idx long, text string")))
    for block in (10, 1):
        assert [(r["a"], r["b"]) for r in similarity.similar_pairs(bags, block=block).collect()] == [(1, 2)]


def test_report_leaves_out_reviews_without_a_product(spark):
    rows = [(p, i, "one two three four five six", 5.0, None, "positive", 0.9) for p in ("p", None) for i in range(4)] + [("few", 9, "one two three four five", 5.0, None, "positive", 0.9)]
    assert [r["product_id"] for r in report.trust_report(spark.createDataFrame(rows, SCHEMA)).collect()] == ["p"]
