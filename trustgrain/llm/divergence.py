"""Quality rules: how far a text's character classes and common words are from those of its language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import top_k
from ..session import written
from .common import fresh

#: Common words that a language's histogram holds (all others share one bin), and the words that a language needs for a
#: reference: with fewer, chance alone moves it. The share of a language in the input does not matter.
COMMON = 50
LEAST_REFERENCE_WORDS = 2_000
#: Largest Jensen-Shannon distances (0 to 1) of a kept text, and what short texts may have besides: this much divided
#: by the square root of the number of characters or words.
MOST_CHARS, CHARS_SLACK = 0.27, 0.5
MOST_WORDS, WORDS_SLACK = 0.25, 1.8
#: Texts with fewer characters or words are not compared.
LEAST_CHARS = 200
LEAST_WORDS = 50
#: Base rules: fewest words, and the largest share (per cent) of words in repeated windows of three.
BASE_WORDS = 50
BASE_REPEAT = 50

#: White space and symbols of the contract.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Character classes: lower, upper, digit, space, line end, sentence mark, symbol or other mark, beyond ASCII.
_CLASSES = 8
_CLASS_OF = np.full(129, 6, dtype=np.int64)
for _i, _chars in enumerate(
    ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:!?'\"()-")
):
    _CLASS_OF[[ord(c) for c in _chars]] = _i
_CLASS_OF[128] = 7

#: Distinct words that a task counts before it hands its counts on.
_FLUSH = 200_000
#: References that a task keeps unpacked.
_KNOWN = 1_000


def char_classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.bincount(_CLASS_OF[np.minimum(points, 128)], minlength=_CLASSES)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, from 0 (equal) to 1 (nothing in common), of two histograms."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2

    def divergence(a: np.ndarray) -> float:
        at = a > 0
        return float(np.sum(a[at] * np.log2(a[at] / m[at])))

    return float(np.sqrt(max(0.0, (divergence(p) + divergence(q)) / 2)))


@dataclass(frozen=True)
class Reference:
    """Character-class shares and common-word shares (last: all other words) of one language."""

    chars: np.ndarray
    words: dict[bytes, int]
    shares: np.ndarray


def reference_table(
    docs: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON, least_words: int = LEAST_REFERENCE_WORDS
) -> DataFrame:
    """``(lang, chars, words, counts)`` of all languages with at least ``least_words`` words in the texts of ``docs``.

    ``chars`` are the totals of the character classes, ``words`` the ``common`` most frequent words, ``counts`` their
    numbers and then that of all other words. Tasks count per language and hand on partial counts, which Spark sums; a
    row is under 2 KB whatever the corpus holds, as long as its common words are short, and a language's row depends on
    its own texts alone. A null language has no row.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = {}
        totals: dict[str, np.ndarray] = {}

        def flushed() -> pd.DataFrame:
            rows = [("word", g, w, n) for g, c in words.items() for w, n in c.items()]
            rows += [("total", g, b"%d" % i, int(n)) for g, c in totals.items() for i, n in enumerate(c)]
            words.clear()
            totals.clear()
            return pd.DataFrame(rows, columns=["kind", "lang", "item", "n"])

        for batch in batches:
            for t, g in zip(batch["text"], batch["lang"], strict=True):
                own = t.lower().encode("utf-8", "surrogatepass").split()
                words.setdefault(g, Counter()).update(own)
                total = totals.setdefault(g, np.zeros(_CLASSES + 1, dtype=np.int64))
                total[:_CLASSES] += char_classes(t)
                total[_CLASSES] += len(own)
            if sum(map(len, words.values())) + len(totals) > _FLUSH:
                yield flushed()
        yield flushed()

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        F.col("lang").isNotNull() & (F.length("text") > 0)
    )
    sums = (
        rows.mapInPandas(count, "kind string, lang string, item binary, n long")
        .groupBy("kind", "lang", "item")
        .agg(F.sum("n").alias("n"))
    )
    # The totals of a language are fewer than its common words, so the top of each kind is all that is needed.
    most = max(common, _CLASSES + 1)
    top = written(top_k(sums, ["kind", "lang"], [F.desc("n"), F.asc("item")], most, ["item"]), "counts")
    total, listed = F.col("kind") == "total", (F.col("kind") == "word") & (F.col("rank") <= common)
    parts = top.groupBy("lang").agg(
        F.array_sort(F.collect_list(F.when(total, F.struct(F.col("item").cast("string").cast("int").alias("i"), "n")))).alias("totals"),
        F.array_sort(F.collect_list(F.when(listed, F.struct("rank", "item", "n")))).alias("top"),
    )
    chars, number = F.slice("totals.n", 1, _CLASSES), F.col("totals.n")[_CLASSES]
    others = number - F.aggregate("top.n", F.lit(0).cast("long"), lambda a, n: a + n)
    found = parts.filter(number >= least_words).select(
        "lang", chars.alias("chars"), F.col("top.item").alias("words"), F.concat("top.n", F.array(others)).alias("counts")
    )
    return written(found, "references")


def reference(chars, words, counts) -> Reference:
    chars, counts = np.array(chars, dtype=float), np.array(counts, dtype=float)
    return Reference(chars / chars.sum(), {bytes(w): i for i, w in enumerate(words)}, counts / counts.sum())


def language_references(
    docs: DataFrame, text: str = "text", lang: str = "lang", common: int = COMMON, least_words: int = LEAST_REFERENCE_WORDS
) -> dict[str, Reference]:
    """``reference_table`` in the driver's memory, to look into few languages; documents are judged from the table."""
    return {r["lang"]: reference(*r[1:]) for r in reference_table(docs, text, lang, common, least_words).collect()}


@dataclass(frozen=True)
class Limits:
    most_chars: float = MOST_CHARS
    chars_slack: float = CHARS_SLACK
    most_words: float = MOST_WORDS
    words_slack: float = WORDS_SLACK
    least_chars: int = LEAST_CHARS
    least_words: int = LEAST_WORDS


def word_distance(words: list[bytes], reference: Reference) -> float:
    get, other = reference.words.get, len(reference.words)
    bins = np.bincount([get(w, other) for w in words], minlength=other + 1)
    return distance(bins, reference.shares)


def distances(text: str, own: Reference | None, limits: Limits) -> tuple[float, float]:
    """Character-class and common-word distance to the reference of the text's language; 0 for texts too short, and
    without a reference, as another language's says nothing about the text."""
    words = text.lower().encode("utf-8", "surrogatepass").split()
    if own is None or len(text) < limits.least_chars or len(words) < limits.least_words:
        return 0.0, 0.0
    return distance(char_classes(text), own.chars), word_distance(words, own)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three words that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
    pair = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)[1]
    windows, counts = np.unique(pair[:-1] * len(ids) + w[2:], return_inverse=True, return_counts=True)[1:]
    twice = counts[windows] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            n += line in seen
            seen.add(line)
    return n


def measure(docs: DataFrame, references: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance,
    base_failed, kept``.

    ``base_failed``: fewer than ``BASE_WORDS`` words, or more than ``BASE_REPEAT`` per cent of them in windows of three
    words found twice or more. A text is kept if it passes both base rules and neither distance is above its limit:
    ``most_chars + chars_slack / sqrt(characters)`` and ``most_words + words_slack / sqrt(words)``; chance moves the
    histograms of short texts that much. A null text has no words. Columns of these names that ``docs`` may have are
    replaced and every row stays.

    ``references`` (see ``reference_table``) is joined on the language. It is a written table of known size, so it is
    broadcast while it is small and each row is judged where it is read; beyond that adaptive execution splits a
    language that holds many texts. Texts of a language without a row there are held to the base rules alone.
    """

    def judge(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        known: dict[str, Reference] = {}
        for texts, langs, *facts in batches:
            rows = []
            for t, g, *fact in zip(texts, langs, *facts, strict=True):
                if fact[0] is not None and g not in known:
                    if len(known) >= _KNOWN:
                        known.clear()
                    known[g] = reference(*fact)
                own = known[g] if fact[0] is not None else None
                t = t or ""
                words = t.encode("utf-8", "surrogatepass").split()
                n, repeated = len(words), repeated_words(words)
                failed = n < BASE_WORDS or 100 * repeated > BASE_REPEAT * n
                chars, near = distances(t, own, limits)
                kept = (
                    not failed
                    and chars <= limits.most_chars + limits.chars_slack / max(1, len(t)) ** 0.5
                    and near <= limits.most_words + limits.words_slack / max(1, n) ** 0.5
                )
                spaces, symbols = sum(map(t.count, SPACE)), sum(map(t.count, SYMBOLS))
                rows.append((n, len(t) - spaces, symbols, duplicate_lines(t), repeated, chars, near, failed, kept))
            yield pd.DataFrame(rows, columns=_NAMES)

    kind = (
        "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "char_distance double, word_distance double, base_failed boolean, kept boolean"
    )
    base = docs.select(*[c for c in docs.columns if c not in _NAMES])
    found = fresh(base, "measured")
    facts = {c: fresh([*base.columns, found], f"reference_{c}") for c in ("lang", "chars", "words", "counts")}
    own = references.select([F.col(c).alias(name) for c, name in facts.items()])
    joined = base.join(own, F.col(lang) == F.col(facts["lang"]), "left")
    judged = F.pandas_udf(judge, kind)(
        F.coalesce(F.col(text), F.lit("")), F.col(lang), *[F.col(facts[c]) for c in ("chars", "words", "counts")]
    )
    return joined.withColumn(found, judged).select(*base.columns, f"{found}.*")


_NAMES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "char_distance",
    "word_distance",
    "base_failed",
    "kept",
)


def judge_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """References from all of ``docs``, then every document against them."""
    return measure(docs, reference_table(docs), limits)
