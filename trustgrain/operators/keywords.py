"""Keywords and topics of a product's reviews."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TERM_STOP_WORDS, WORD, is_blank, word_count
from ..session import ROW_GROUP, written
from .skew import top_k

# Topics by words that a keyword may contain.
TOPICS = {
    "Product Quality": (
        "quality", "good", "bad", "excellent", "poor", "amazing", "worst", "best", "perfect", "terrible", "awesome",
    ),
    "Price & Value": ("price", "cheap", "expensive", "worth", "value", "money", "affordable", "cost", "deal", "budget"),
    "Delivery & Shipping": (
        "delivery", "shipping", "fast", "slow", "arrived", "package", "delivery", "courier", "tracking",
    ),
    "Battery & Performance": ("battery", "charge", "performance", "speed", "fast", "slow", "power", "drain", "lasting"),
    "Camera & Display": ("camera", "photo", "video", "display", "screen", "picture", "quality", "resolution", "bright"),
    "Customer Service": ("service", "support", "help", "response", "seller", "customer", "refund", "return"),
    "Build & Design": (
        "build", "design", "look", "feel", "material", "plastic", "metal", "glass", "sleek", "heavy", "lightweight",
    ),
    "Sound & Audio": ("sound", "audio", "speaker", "music", "bass", "volume", "headphone", "voice"),
    "Ease of Use": ("easy", "simple", "setup", "use", "interface", "app", "install", "connect", "friendly"),
}


@dataclass(frozen=True)
class Pass:
    """Phrases of ``shortest`` to ``longest`` words (1 to 3): the best ``candidates``, and how many of them are kept.

    Without ``candidates`` every phrase is kept. Choosing goes through all ways to keep ``kept`` of ``candidates``, so
    there must not be more than ``MOST_CHOICES`` of them.
    """

    shortest: int
    longest: int
    candidates: int | None
    kept: int | None = None


# The two passes and the keywords of a product.
PASSES = (Pass(1, 2, 20, 15), Pass(2, 3, 15, 10))
KEPT = 15
MOST_CHOICES = 200_000


def default_score() -> Column:
    """Weight of a phrase for a product: its share of use there times how few products use it.

    Any column expression over ``uses``, ``most`` (uses of the product's most used phrase), ``products_with`` and
    ``products`` can take its place, as long as it does not fall with ``uses`` nor rise with ``products_with``.
    """
    rarity = F.log((F.col("products") + 1).cast("double") / (F.col("products_with") + 1).cast("double")) + F.lit(1.0)
    return F.col("uses").cast("double") / F.col("most").cast("double") * rarity


def review_words(df: DataFrame, by: str, text: str = "text") -> DataFrame:
    """``(by, row, words)``: words of two characters or more that are no stop words, of every review that is not blank.

    ``row`` is a number of the row; it holds once this is written.
    """
    found = F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}{{2,}}"), F.lit(0))
    kept = F.filter(found, lambda t: ~t.isin(*TERM_STOP_WORDS))
    return df.filter(~is_blank(F.col(text))).select(by, F.monotonically_increasing_id().alias("row"), kept.alias("words"))


def _neighbours(items: Column, n: int, join: Callable[..., Column]) -> Column:
    """``join`` of every ``n`` neighbouring items of an array."""
    if n == 1:
        return F.transform(items, lambda x: join(x))
    at = F.sequence(F.lit(0), F.size(items) - n)
    runs = F.transform(at, lambda i: join(*[F.get(items, i + k) for k in range(n)]))
    return F.when(F.size(items) >= n, runs)


def _grams(words: DataFrame, by: str, n: int) -> DataFrame:
    """``(by, n, key)``: a row per run of ``n`` words, with a 64-bit hash in place of the words."""
    return words.select(by, F.lit(n).alias("n"), F.explode(_neighbours(F.col("words"), n, F.xxhash64)).alias("key"))


def _counted(grams: DataFrame, by: str) -> DataFrame:
    return grams.groupBy(by, "n", "key").agg(F.count(F.lit(1)).alias("uses"))


def _hopeful(counts: DataFrame, by: str, facts: DataFrame, p: Pass, scorer: Callable[[], Column], floor: DataFrame | None = None) -> DataFrame:
    """The counted phrases that can be among the best candidates of a pass, whatever products they are in.

    At best a phrase is in one product alone, at worst in all. The ``candidates``-th best score at worst is a floor for
    every product; phrases that do not reach it at best are out. The floor is read off the counts of equal numbers of
    uses, of which a product has few.
    """
    mine = counts.filter(F.col("n").between(p.shortest, p.longest))
    if p.candidates is None:
        return mine
    if floor is None:
        floor = _floor(mine, by, p.candidates)
    at_best = mine.join(facts, by).withColumn("products_with", F.lit(1).cast("long"))
    best = at_best.withColumn("at_best", F.round(scorer(), 4)).drop("products_with")
    limit = floor.join(facts, by).withColumn("products_with", F.col("products")).withColumn("limit", F.round(scorer(), 4))
    kept = best.join(limit.select(by, "limit"), by, "left").filter(F.col("limit").isNull() | (F.col("at_best") >= F.col("limit")))
    return kept.select(*mine.columns)


def _floor(counts: DataFrame, by: str, k: int) -> DataFrame:
    """``(by, uses)``: the uses of the ``k``-th most used phrase, for products that have so many."""
    same = counts.groupBy(by, "uses").agg(F.count(F.lit(1)).alias("phrases"))
    upto = F.sum("phrases").over(Window.partitionBy(by).orderBy(F.desc("uses")))
    return same.withColumn("upto", upto).filter(F.col("upto") >= k).groupBy(by).agg(F.max("uses").alias("uses"))


def keywords(
    df: DataFrame,
    by: str = "product_id",
    text: str = "text",
    scorer: Callable[[], Column] = default_score,
    passes: tuple[Pass, ...] = PASSES,
    kept: int | None = KEPT,
) -> DataFrame:
    """At most ``kept`` keywords per product with rank and score rounded to four places.

    Each pass takes its best candidates and keeps those that overlap least (``least_alike``). A phrase kept by several
    passes counts once. The scorer is replaceable because the meaning-based scorer of a language model is not part of
    this library. Without ``kept`` and ``candidates`` all phrases of all reviews are ranked.

    Words and pairs are counted once, as 64-bit hashes. What cannot reach the candidates is dropped by its count before
    the products of a phrase are looked up; triples are counted only where both of their pairs can, as no run of words
    is used more often than its parts. The words themselves are looked up for the candidates alone.
    """
    longest = max(p.longest for p in passes)
    words = written(review_words(df, by, text), "review-words", ROW_GROUP)
    counts = written(_counted(_grams(words, by, 1).union(_grams(words, by, 2)), by), "gram-counts")
    single = counts.filter("n = 1")
    products = single.select(by).distinct().agg(F.count(F.lit(1)).alias("products"))
    facts = written(single.groupBy(by).agg(F.max("uses").alias("most")).withColumn("products", products.scalar()), "gram-facts")

    entered = None
    for number, p in enumerate(passes):
        # Small beside the counts, and known to be so once written: the planner need not move the counts to join them.
        mine = counts.filter(F.col("n").between(p.shortest, p.longest))
        floor = None if p.candidates is None else written(_floor(mine, by, p.candidates), "gram-floor")
        hopeful = _hopeful(counts, by, facts, p, scorer, floor)
        if p.longest > 2 and p.candidates is not None:
            hopeful = written(hopeful, "hopeful-pairs")
        if p.longest > 2:
            pairs = hopeful.filter("n = 2") if p.shortest <= 2 else _hopeful(counts, by, facts, Pass(2, 2, p.candidates), scorer, floor)
            triples = _counted(_triples(words, by, pairs.select(by, F.col("key").alias("pair"))), by)
            hopeful = hopeful.union(_hopeful(triples, by, facts, Pass(3, 3, p.candidates), scorer, floor))
        mine = hopeful.withColumn("pass", F.lit(number))
        entered = mine if entered is None else entered.union(mine)
    entered = written(entered, "hopeful-grams")

    asked = entered.select("n", "key").distinct()
    held = counts.select(by, "n", "key")
    if longest > 2:
        held = held.union(_grams(words, by, 3).join(asked.filter("n = 3"), ["n", "key"], "left_semi").select(by, "n", "key").distinct())
    spread = held.join(asked, ["n", "key"], "left_semi").groupBy("n", "key").agg(F.count(F.lit(1)).alias("products_with"))
    rated = entered.join(spread, ["n", "key"]).join(facts, by).withColumn("score", F.round(scorer(), 4))
    # Ties at the last place need the words, so all of them stay until then.
    limits = F.create_map(*[F.lit(x) for i, p in enumerate(passes) for x in (i, p.candidates or -1)])[F.col("pass")]
    near = rated.withColumn("place", F.rank().over(Window.partitionBy(by, "pass").orderBy(F.desc("score"))))
    near = written(near.filter((limits < 0) | (F.col("place") <= limits)).select(by, "pass", "n", "key", "score"), "best-grams")
    named = near.join(_names(words, near.select("n", "key").distinct(), longest), ["n", "key"]).drop("key")

    order = [F.desc("score"), F.asc("phrase")]
    best = named.withColumn("rank", F.row_number().over(Window.partitionBy(by, "pass").orderBy(*order)))
    best = best.filter((limits < 0) | (F.col("rank") <= limits)).drop("place")
    merged = _chosen(best, by, passes).groupBy(by, F.col("phrase").alias("keyword")).agg(F.max("score").alias("score"))
    final = [F.desc("score"), F.asc("keyword")]
    if kept is None:
        return merged.withColumn("keyword_rank", F.row_number().over(Window.partitionBy(by).orderBy(*final)))
    return top_k(merged, [by], final, kept, ["keyword"], rank="keyword_rank")


def _triples(words: DataFrame, by: str, pairs: DataFrame) -> DataFrame:
    """``(by, n, key)`` of the runs of three words both of whose pairs are among ``pairs(by, pair)``."""
    runs = _neighbours(
        F.col("words"),
        3,
        lambda a, b, c: F.struct(F.xxhash64(a, b).alias("x"), F.xxhash64(b, c).alias("y"), F.xxhash64(a, b, c).alias("key")),
    )
    rows = words.select(by, F.inline(runs))
    for side in ("x", "y"):
        rows = rows.join(pairs.withColumnRenamed("pair", side), [by, side], "left_semi")
    return rows.select(by, F.lit(3).alias("n"), "key")


def _names(words: DataFrame, asked: DataFrame, longest: int) -> DataFrame:
    """``(n, key, phrase)`` for the asked hashes: the place of one run of each is found, then its words are read."""
    out = None
    for n in range(1, longest + 1):
        keys = _neighbours(F.col("words"), n, F.xxhash64)
        rows = words.select(F.lit(n).alias("n"), "row", F.posexplode(keys).alias("pos", "key"))
        out = rows if out is None else out.union(rows)
    places = out.join(asked, ["n", "key"], "left_semi").groupBy("n", "key").agg(F.min(F.struct("row", "pos")).alias("at"))
    places = written(places.select("n", "key", F.col("at.row").alias("row"), F.col("at.pos").alias("pos")), "gram-places")
    phrase = F.array_join(F.slice("words", F.col("pos") + 1, F.col("n")), " ").alias("phrase")
    return words.select("row", "words").join(places, "row").select("n", "key", phrase)


def _alike(x: set[str], y: set[str]) -> int:
    return math.floor(1_000_000 * (len(x & y) / math.sqrt(len(x) * len(y))))


def alike(a: str, b: str) -> int:
    """Cosine of the words of two phrases, in millionths, rounded down."""
    return _alike(set(a.split(" ")), set(b.split(" ")))


@lru_cache(maxsize=8)
def _choices(n: int, out: int) -> np.ndarray:
    """All ways to leave ``out`` of ``n`` phrases out: the same for every product with so many candidates."""
    return np.array(list(itertools.combinations(range(n), out)), dtype=np.int64)


@lru_cache(maxsize=4096)
def _left_out(n: int, kept: int, table: bytes) -> frozenset[int]:
    """The places that go, by the table of how alike two phrases are; many products have the same table."""
    pairs = np.frombuffer(table, dtype=np.int64).reshape(n, n)
    out = _choices(n, n - kept)
    # What the pairs of those left out take from the sum of all: once per member, but once too often among themselves.
    gone = pairs.sum(1)[out].sum(1) - sum(pairs[out[:, i], out[:, j]] for i in range(n - kept) for j in range(i + 1, n - kept))
    # Choices are in order of what is left out; the last of the best keeps the better phrases.
    return frozenset(out[len(gone) - 1 - int(gone[::-1].argmax())].tolist())


def least_alike(phrases: list[str], kept: int) -> list[int]:
    """Places of the ``kept`` phrases, given best first, whose pairs are least alike in sum.

    Of several such choices the one that keeps the better phrase at the first place where they differ.
    """
    n = len(phrases)
    if n <= kept:
        return list(range(n))
    if math.comb(n, kept) > MOST_CHOICES:
        raise ValueError(f"{math.comb(n, kept)} ways to keep {kept} of {n} phrases, more than {MOST_CHOICES}")
    words = [set(p.split(" ")) for p in phrases]
    pairs = np.zeros((n, n), dtype=np.int64)
    for i, j in itertools.combinations(range(n), 2):
        pairs[i, j] = pairs[j, i] = _alike(words[i], words[j])
    left_out = _left_out(n, kept, pairs.tobytes())
    return [i for i in range(n) if i not in left_out]


def _chosen(best: DataFrame, by: str, passes: tuple[Pass, ...]) -> DataFrame:
    """The candidates ``(by, pass, phrase, score, rank)`` that each pass keeps; a group has as many rows as candidates."""

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        return group.iloc[least_alike(group["phrase"].tolist(), passes[int(group["pass"].iloc[0])].kept)]

    sizes = F.create_map(*[F.lit(x) for i, p in enumerate(passes) for x in (i, p.kept if p.candidates else -1)])[F.col("pass")]
    rows = best.select(by, "pass", "phrase", "score", "rank").withColumn("of", F.max("rank").over(Window.partitionBy(by, "pass")))
    few = (sizes < 0) | (F.col("of") <= sizes)
    many = rows.filter(~few).drop("of")
    return rows.filter(few).drop("of").union(many.groupBy(by, "pass").applyInPandas(choose, many.schema))


def keyword_counts(df: DataFrame, by: str = "product_id", text: str = "text") -> DataFrame:
    """Words and non-blank reviews that the keywords were taken from."""
    return (
        df.filter(~is_blank(F.col(text)))
        .groupBy(by)
        .agg(F.sum(word_count(F.col(text))).cast("long").alias("word_count"), F.count(F.lit(1)).alias("review_count"))
    )


def topics(found: DataFrame, by: str = "product_id", k: int = 5, shown: int = 3) -> DataFrame:
    """Topics whose words occur inside keywords: count, first ``shown`` keywords, and the ``k`` largest topics.

    Ties keep the order in which topics are listed. A product has as many rows in its arrays as it has keywords.
    """
    listed = F.array(
        *[
            F.struct(F.lit(i).alias("topic_no"), F.lit(name).alias("topic"), F.array(*[F.lit(w) for w in words]).alias("words"))
            for i, (name, words) in enumerate(TOPICS.items())
        ]
    )
    hits = found.select(by, "keyword", "keyword_rank", F.explode(listed).alias("t")).filter(
        F.exists("t.words", lambda w: F.contains(F.col("keyword"), w))
    )
    counted = hits.groupBy(by, F.col("t.topic_no").alias("topic_no"), F.col("t.topic").alias("topic")).agg(
        F.count(F.lit(1)).alias("count"),
        F.array_sort(F.collect_list(F.struct("keyword_rank", "keyword"))).alias("ranked"),
    )
    named = counted.withColumn("keywords", F.slice("ranked.keyword", 1, shown)).drop("ranked")
    return top_k(named, [by], [F.desc("count"), F.asc("topic_no")], k, ["topic"], rank="topic_rank").drop("topic_no")
