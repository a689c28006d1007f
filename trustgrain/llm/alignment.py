"""Cross-tokenizer alignment: where two tokenizations of a text end tokens at the same byte, found by galloping search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import small_batches, tidy
from .packing import byte_pairs

#: Characters of texts that are aligned together, and characters after which a long text is cut where that is exact.
BLOCK_CHARS = 2_000_000
PART_CHARS = 100_000
#: Elements of the shorter list that one step of the outer search covers.
STRIDE = 64


@dataclass(frozen=True)
class Tokens:
    """Ids of several texts one after the other, the bytes of each id, and the ids that each text has."""

    ids: np.ndarray
    ends: np.ndarray
    counts: np.ndarray


def gallop(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each of the ascending ``keys``, how many of the ascending ``values`` are smaller.

    Every ``STRIDE``-th key is searched from the place of the one before, in steps that double until they overshoot,
    then by halving the last step. The keys between two such places gallop inside them, all at once. The cost is that
    of the shorter list times the logarithm of the distance between neighbours in the longer one.
    """
    n, m = len(values), len(keys)
    if not m:
        return np.zeros(0, dtype=np.int64)
    outer = keys[::STRIDE]
    low = np.empty(len(outer) + 1, dtype=np.int64)
    at = 0
    for k, key in enumerate(outer.tolist()):
        step = 1
        while at + step <= n and values[at + step - 1] < key:
            at, step = at + step, 2 * step
        high = min(at + step, n + 1)
        while at + 1 < high:  # values[:at] are smaller; fewer than ``high`` are
            middle = (at + high) // 2
            if values[middle - 1] < key:
                at = middle
            else:
                high = middle
        low[k] = at
    low[-1] = n
    place = np.repeat(low[:-1], STRIDE)[:m].copy()
    limit = np.repeat(low[1:], STRIDE)[:m]
    step = np.ones(m, dtype=np.int64)
    active = np.arange(m)
    while len(active):  # exponential: the step doubles while the value at its end is smaller
        to = place[active] + step[active]
        inside = to <= limit[active]
        smaller = np.zeros(len(active), dtype=bool)
        smaller[inside] = values[to[inside] - 1] < keys[active[inside]]
        active = active[smaller]
        place[active] += step[active]
        step[active] *= 2
    high = np.minimum(place + step, limit + 1)
    active = np.nonzero(place + 1 < high)[0]
    while len(active):  # binary: between the last step that was smaller and the next
        middle = (place[active] + high[active]) >> 1
        smaller = values[middle - 1] < keys[active]
        place[active[smaller]] = middle[smaller]
        high[active[~smaller]] = middle[~smaller]
        active = active[place[active] + 1 < high[active]]
    return place


@dataclass(frozen=True)
class Alignment:
    """``group_a`` and ``group_b`` give the group of every token; ``link_a`` and ``link_b`` the places of the two tokens
    of every link, in order of the text."""

    group_a: np.ndarray
    group_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Alignment:
    """Groups and overlaps of two tokenizations of the same bytes, given the ascending end offsets of their tokens.

    Both lists end at the same offset. The shorter one is searched for in the longer: where a key is found, both end a
    token there and a group ends. The number of smaller values before each key gives the range of tokens of the longer
    list that overlap each token of the shorter one.
    """
    swapped = len(ends_b) < len(ends_a)
    short, long = (ends_b, ends_a) if swapped else (ends_a, ends_b)
    below = gallop(short, long)
    common = below < len(long)
    common[common] = long[below[common]] == short[common]
    # The group of a token is the number of common ends before its own.
    group_short = np.cumsum(common) - common
    cuts = np.zeros(len(long), dtype=np.int64)
    cuts[below[common]] = 1
    group_long = np.cumsum(cuts) - cuts
    # A token overlaps from the first value that ends after its start to the first that does not end before its end.
    first = np.zeros(len(short), dtype=np.int64)
    first[1:] = (below + common)[:-1]
    times = below - first + 1
    link_short = np.repeat(np.arange(len(short)), times)
    link_long = np.arange(len(link_short)) - np.repeat(np.cumsum(times) - times - first, times)
    if swapped:
        return Alignment(group_long, group_short, link_long, link_short)
    return Alignment(group_short, group_long, link_short, link_long)


def parts_of(text: str, size: int = PART_CHARS) -> list[str]:
    """A text cut before single blanks between ASCII letters, where neither tokenizer joins what is on both sides.

    Parts are about ``size`` characters long, longer where there is no such blank.
    """
    parts, at = [], 0
    while len(text) - at > 2 * size:
        cut = at + size
        while True:
            cut = text.find(" ", cut)
            if cut < 0 or cut + 1 >= len(text):
                return [*parts, text[at:]]
            before, after = text[cut - 1], text[cut + 1]
            if before.isascii() and before.isalpha() and after.isascii() and after.isalpha():
                break
            cut += 1
        parts.append(text[at:cut])
        at = cut
    return [*parts, text[at:]]


class Tokenizers:
    """The two tokenizers and the bytes of every id.

    ``a`` is a byte-level BPE in a ``tokenizers`` JSON file, which encodes the text after a blank; ``b`` a SentencePiece
    model, which adds that blank itself. Strings of special tokens inside texts are ordinary text to both.
    """

    def __init__(self, a: str, pattern: str, b: str):
        import sentencepiece

        self.a = byte_pairs(a, pattern)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.bytes_a = self.a.token_bytes()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        # Parts may be encoded alone only if no piece goes on over a blank.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        size = max(len(self.bytes_a), len(self.bytes_b))
        self.lengths = np.zeros((2, size), dtype=np.int64)
        for side, own in enumerate((self.bytes_a, self.bytes_b)):
            self.lengths[side, : len(own)] = [len(x) for x in own]
        names = [str(i) for i in range(size)]
        #: Every id in decimal, by what follows it: another of its side, the other side, the next group, nothing.
        self.shown = np.array([[n + c for n in names] for c in (",", "|", ";", "")], dtype=object)

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both sides; None where the bytes of either differ from those of a blank and the text."""
        whole = f" {text}".encode("utf-8", "surrogatepass")
        parts = parts_of(f" {text}") if self.cuts else [f" {text}"]
        a = np.concatenate([self.a.ids(p, special=False) for p in parts]).astype(np.int64)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != whole:
            return None
        found = [i for p in parts for i in self.b.encode(p[1:], num_threads=1)]
        if b"".join(map(self.bytes_b.__getitem__, found)) != whole:
            return None
        return a, np.array(found, dtype=np.int64)


@lru_cache(maxsize=1)
def tokenizers(a: str, pattern: str, b: str) -> Tokenizers:
    """One pair for all tasks of a Python worker."""
    return Tokenizers(a, pattern, b)


#: A row is a document, which names the id pairs that it links by their place in the list of its block and says how
#: often it links each; or, without those columns, that list, with the number of the block's documents that hold each.
ROW = (
    "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places array<int>, "
    "times array<int>, pairs array<long>, holders array<long>"
)
#: An id pair is one number, the A id above this bit.
SHIFT = 32


def align_block(texts: list[str | None], both: Tokenizers) -> tuple[dict, np.ndarray, np.ndarray]:
    """The columns of ``ROW`` that documents have, but their ids, and the pairs and holders of the block.

    The texts are laid end to end, so that one search covers all of them: a text's last tokens of both sides end at
    the same byte, and no group or link reaches into the next text.
    """
    encoded = [both.ids(t) if t else None for t in texts]
    some = [e for e in encoded if e is not None]
    doc = np.array([k for k, e in enumerate(encoded) if e is not None], dtype=np.int64)
    sides = [np.concatenate([np.zeros(0, dtype=np.int64), *[e[s] for e in some]]) for s in (0, 1)]
    docs = [np.repeat(doc, [len(e[s]) for e in some]) for s in (0, 1)]
    found = align(*[np.cumsum(both.lengths[s][sides[s]]) for s in (0, 1)])

    def per_text(at: np.ndarray) -> np.ndarray:
        return np.bincount(at, minlength=len(texts)).astype(np.int64)

    n_a, n_b, n_links = per_text(docs[0]), per_text(docs[1]), per_text(docs[0][found.link_a])
    last = np.ones(len(sides[0]), dtype=bool)
    last[:-1] = found.group_a[1:] != found.group_a[:-1]
    n_groups = per_text(docs[0][last])

    hashes = _digests(found, sides, docs, both, n_a + n_b)
    key = (sides[0][found.link_a] << SHIFT) | sides[1][found.link_b]
    pairs, place = np.unique(key, return_inverse=True)
    # One entry per text and pair, in order of both; its times are the links.
    entry, times = np.unique(docs[0][found.link_a] * max(len(pairs), 1) + place, return_counts=True)
    own, place = np.divmod(entry, max(len(pairs), 1))
    cuts = np.cumsum(per_text(own))[:-1]
    columns = {
        "n_a": n_a,
        "n_b": n_b,
        "n_groups": n_groups,
        "n_links": n_links,
        "groups_sha256": hashes,
        "places": np.split(place.astype(np.int32), cuts),
        "times": np.split(times.astype(np.int32), cuts),
    }
    return columns, pairs, np.bincount(place, minlength=len(pairs))


def _digests(found: Alignment, sides: list[np.ndarray], docs: list[np.ndarray], both: Tokenizers, tokens: np.ndarray) -> list[str]:
    """The SHA-256 of each text's groups, written as ``a1,a2|b1;a3|b2,b3``; '' for texts without tokens."""
    # Tokens of both sides in the order in which they are written: by group, A before B.
    n = len(sides[0]) + len(sides[1])
    groups = int(found.group_a[-1]) + 1 if len(found.group_a) else 0
    size_a, size_b = np.bincount(found.group_a, minlength=groups), np.bincount(found.group_b, minlength=groups)
    upto_a, upto_b = np.cumsum(size_a), np.cumsum(size_b)
    at_a = np.arange(len(sides[0])) + (upto_b - size_b)[found.group_a]
    at_b = np.arange(len(sides[1])) + upto_a[found.group_b]
    ids, what = np.empty(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    ids[at_a], ids[at_b] = sides[0], sides[1]
    what[(upto_a + upto_b - size_b) - 1] = 1  # the last A token of each group
    what[(upto_a + upto_b) - 1] = 2  # the last B token of each group
    ends = np.cumsum(tokens)
    filled = tokens > 0
    what[ends[filled] - 1] = 3
    shown = both.shown[what, ids].tolist()
    out = []
    for start, end in zip((ends - tokens).tolist(), ends.tolist(), strict=True):
        out.append(hashlib.sha256("".join(shown[start:end]).encode()).hexdigest() if end > start else "")
    return out


def aligned_blocks(docs: DataFrame, a: str, pattern: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents in blocks of about ``BLOCK_CHARS`` characters, aligned, as rows of ``ROW``.

    Blocks follow the partitions that are read, so texts are not shuffled.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list]]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch["doc_id"], batch["text"], strict=True):
                if texts and size + len(t or "") > BLOCK_CHARS:
                    yield ids, texts
                    ids, texts, size = [], [], 0
                ids.append(None if i is None or i != i else int(i))
                texts.append(t)
                size += len(t or "")
        if texts:
            yield ids, texts

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = tokenizers(a, pattern, b)
        first = TaskContext.get().partitionId() << 32
        for k, (ids, texts) in enumerate(cut(batches)):
            columns, pairs, holders = align_block(texts, both)
            rows = pd.DataFrame({"block": first + k, "doc_id": ids, **columns, "pairs": None, "holders": None})
            of_block = {"block": [first + k], "pairs": [pairs], "holders": [holders]}
            for part in (rows, pd.DataFrame(of_block).reindex(columns=rows.columns)):
                yield part.astype(dict.fromkeys(["doc_id", "n_a", "n_b", "n_groups", "n_links"], "Int64")).replace({float("nan"): None})

    small_batches(docs.sparkSession)
    named = docs.select(F.col(doc_id).cast("long").cast("string").alias("doc_id"), F.col(text).alias("text"))
    return named.mapInPandas(tidy(run), ROW)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``(pair, n, best)``: how many documents hold each id pair linked, and whether no pair of its A id is in more."""
    held = blocks.filter(F.col("pairs").isNotNull()).select(F.inline(F.arrays_zip("pairs", "holders")))
    counts = written(held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holders").alias("n")), "pair-counts")
    of_a = F.shiftright("pair", SHIFT).alias("a")
    most = counts.groupBy(of_a).agg(F.max("n").alias("most"))
    return counts.withColumn("a", F.shiftright("pair", SHIFT)).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokens(
    docs: DataFrame, a: str, pattern: str, b: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` of every row of ``docs``.

    ``a`` is the file of a byte-level BPE with its ``pattern``, ``b`` a SentencePiece model. Whole texts are encoded by
    both; the byte offsets at which tokens of both end cut them into groups, and all pairs of an A and a B token whose
    bytes overlap are links. ``n_best`` counts the links whose id pair is held by as many documents of ``docs`` as any
    pair of its A id, ``count_sum`` adds up the documents that hold the pair of each link.

    Null and empty texts, and texts whose bytes a tokenizer does not give back, have zeros and the digest ''. Rows that
    repeat an id are documents of their own, and a null id stays null. Other columns are ignored, whatever their names;
    an empty table gives an empty result.

    1. Texts are aligned where they are read, in blocks, and blocks are written.
    2. The pairs of all blocks are summed, so a pair reaches the shuffle once per block however many links it has.
    3. Every block looks up the counts of its own pairs, and its documents add them up.
    """
    blocks = written(aligned_blocks(docs, a, pattern, b, doc_id, text), "token-blocks")
    counts = written(pair_counts(blocks), "best-pairs")
    asked = blocks.filter(F.col("pairs").isNotNull()).select("block", F.explode("pairs").alias("pair"))
    found = written(asked.join(counts, "pair").select("block", "pair", "n", "best"), "block-pairs")
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    kind = ", ".join(f"{c} long" for c in [*own, "n_best", "count_sum"]) + ", groups_sha256 string"

    def add_up(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("pair")  # the order of the block's list
        n, best = right["n"].to_numpy(dtype=np.int64), right["best"].to_numpy(dtype=bool)
        sums = [(int(t @ best[p]), int(t @ n[p])) for p, t in zip(left["places"], left["times"], strict=True)]
        out = left[own].astype("Int64")
        out[["n_best", "count_sum"]] = np.array(sums, dtype=np.int64).reshape(-1, 2)
        return out.assign(groups_sha256=left["groups_sha256"])

    # A null id would turn its column into rounded doubles, so ids go as strings.
    rows = blocks.filter(F.col("places").isNotNull()).drop("pairs", "holders")
    return (
        rows.withColumn("doc_id", F.col("doc_id").cast("string"))
        .groupBy("block")
        .cogroup(found.groupBy("block"))
        .applyInPandas(add_up, kind)
    )
