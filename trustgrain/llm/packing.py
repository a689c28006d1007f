"""Best-fit packing of token sequences: combinations of lengths that fill a sequence exactly, then best fit."""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import fresh, small_batches, tidy

#: Tokens of a sequence, and the id that ends a document.
CAPACITY = 2048
END = 0
#: Documents whose tokens a task holds at a time.
ROWS = 256
#: Pieces that are numbered together.
PART_ROWS = 100_000


class BytePairs:
    """Byte-level BPE from a ``tokenizers`` JSON file. Encoding runs in ``tiktoken``, which gives the same ids several
    times faster; the vocabulary and merges are those of the file. Special tokens in a text are recognised, as
    ``tokenizers`` does by default, unless ``special`` is false.

    A run of white space of about a million characters exceeds the stack that ``tiktoken`` gives its pattern; such
    texts are encoded by ``tokenizers`` itself.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            parsed = json.load(f)
        special = {x["content"]: x["id"] for x in parsed["added_tokens"]}
        of_char = {c: b for b, c in self._byte_characters().items()}
        ranks = {
            bytes(of_char[c] for c in token): rank
            for token, rank in parsed["model"]["vocab"].items()
            if token not in special
        }
        self.ranks = ranks
        self.encoding = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        self.path = path

    @staticmethod
    def _byte_characters() -> dict[int, str]:
        """The printable character that stands for each byte in such files: itself, or one above U+0100 in turn."""
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in shown]
        return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(rest)}

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id; special tokens stand for the bytes of their names."""
        size = self.encoding.n_vocab
        found = {i: t for t, i in self.ranks.items()} | {self.encoding.encode_single_token(t): t.encode() for t in self.special}
        return [found.get(i, b"") for i in range(size)]

    def ids(self, text: str, special: bool = True) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, allowed_special=self.special if special else set(), disallowed_special=())
        except ValueError:
            return np.array(self._slow(special).encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    @lru_cache(maxsize=2)  # noqa: B019
    def _slow(self, special: bool):
        import tokenizers

        found = tokenizers.Tokenizer.from_file(self.path)
        found.encode_special_tokens = not special
        return found


@lru_cache(maxsize=1)
def byte_pairs(path: str, pattern: str) -> BytePairs:
    """One encoder for all tasks of a Python worker."""
    return BytePairs(path, pattern)


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    pattern: str,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    tokens: bool = False,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` for every piece of every document, with ``tokens`` also the ids.

    A document's ids are those of its whole text and ``end``; null counts as empty text. Longer ones are cut from the
    back into pieces of ``capacity``, so only the first piece may be shorter. The checksum is over little-endian
    unsigned 32-bit ids.
    """
    small_batches(docs.sparkSession)
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * tokens

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = byte_pairs(tokenizer, pattern)
        for batch in (b.iloc[at : at + ROWS] for b in batches for at in range(0, len(b), ROWS)):
            rows = []
            for i, t in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(pairs.ids(t or ""), np.uint32(end)).astype("<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    part = ids[a:b]
                    rows.append((i, k, a, b - a, zlib.crc32(part), *([part.astype(np.int32)] if tokens else [])))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")]).astype({"doc_id": "Int64"})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(tidy(cut), kind)


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """How to pack ``counts`` (length: number of pieces) into few sequences: ``(lengths, repetitions)`` patterns.

    From the longest length down, the gap that a piece leaves is looked up in an index of exact complements: a single
    length, then a pair sum, then a triple sum that equals the gap and is available; a combination is used as often as
    its counts allow, largest parts first, so that small pieces stay for later gaps. What no combination fills exactly
    goes, longest first, into the open sequence with the smallest sufficient gap (best fit).

    The work depends on the number of different lengths, at most ``capacity``, not on the number of pieces.
    """
    have = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        have[length] += n
    patterns: list[tuple[tuple[int, ...], int]] = []
    if have[capacity]:
        patterns.append(((capacity,), int(have[capacity])))
        have[capacity] = 0

    def available(parts: tuple[int, ...]) -> int:
        return min(int(have[p]) // parts.count(p) for p in set(parts))

    def pair(total: int, most: int) -> tuple[int, int] | None:
        """The available pair with this sum and the largest part at most ``most``."""
        a = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        b = total - a
        good = (have[a] > 0) & (have[b] > 0) & ((a != b) | (have[a] > 1))
        at = int(good.argmax()) if len(good) else 0
        return (int(a[at]), int(b[at])) if len(good) and good[at] else None

    def complement(gap: int) -> tuple[int, ...] | None:
        if have[gap]:
            return (gap,)
        found = pair(gap, gap)
        if found:
            return found
        for a in np.nonzero(have[: max(gap - 1, 0)])[0][::-1]:
            if 3 * a < gap:
                break
            have[a] -= 1
            rest = pair(gap - int(a), int(a))
            have[a] += 1
            if rest:
                return (int(a), *rest)
        return None

    left = np.zeros(capacity + 1, dtype=np.int64)
    for length in range(capacity - 1, 0, -1):
        while have[length]:
            have[length] -= 1
            parts = complement(capacity - length)
            have[length] += 1
            if parts is None:
                left[length], have[length] = have[length], 0
                break
            whole = (length, *parts)
            n = available(whole)
            patterns.append((whole, n))
            for p in whole:
                have[p] -= n
    return patterns + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit on counts: open sequences with equal contents are handled together."""
    open_bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    gaps = np.zeros(capacity + 1, dtype=bool)

    def put(parts: tuple[int, ...], n: int) -> None:
        gap = capacity - sum(parts)
        open_bins[gap][parts] = open_bins[gap].get(parts, 0) + n
        gaps[gap] = True

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fitting = np.nonzero(gaps[length:])[0]
            if not len(fitting):
                each = capacity // length
                whole, rest = divmod(n, each)
                if whole:
                    put((length,) * each, whole)
                if rest:
                    put((length,) * rest, 1)
                break
            gap = int(fitting[0]) + length
            parts, bins = next(iter(open_bins[gap].items()))
            used = min(n, bins)
            if used == bins:
                del open_bins[gap][parts]
                gaps[gap] = bool(open_bins[gap])
            else:
                open_bins[gap][parts] = bins - used
            put((*parts, length), used)
            n -= used
    return [(parts, n) for own in open_bins.values() for parts, n in own.items()]


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, order: tuple[str, ...] = ("doc_id", "piece")
) -> DataFrame:
    """``pieces`` (with ``length``, 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Only the number of pieces of each length, at most ``capacity`` numbers, comes to the driver, where the sequences
    are planned. The pieces of a length are numbered in parts dealt out by a hash of ``order`` (the number of parts
    follows the number of pieces, so no part grows with the input) and shifted by the parts before; the number names
    the pattern, the sequence and the place in it. All rows stay; columns named like the two new ones are replaced.
    """
    base = pieces.select(*[c for c in pieces.columns if c not in ("sequence_id", "offset")])
    part, number = fresh(base, "pack_part"), fresh(base, "pack_number")
    counts = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_sequences(counts, capacity)
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    first = 0
    for lengths, n in plan:
        offset = 0
        for length in lengths:
            slots[length].append((n, first, offset))
            offset += length
        first += n
    found = {
        length: (np.cumsum([x[0] for x in own]), np.array([x[1] for x in own]), np.array([x[2] for x in own]))
        for length, own in slots.items()
    }
    parts = max(1, -(-sum(counts.values()) // part_rows))
    dealt = base.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(parts)))
    inside = Window.partitionBy("length", part).orderBy(*base.columns)
    before = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        dealt.groupBy("length", part)
        .agg(F.count("*").alias("n"))
        .select("length", part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    )
    ranked = dealt.withColumn(number, F.row_number().over(inside) - 1).join(
        shifts.withColumnRenamed("length", "pack_length").withColumnRenamed(part, "shift_part"),
        (F.col("length") == F.col("pack_length")) & (F.col(part) == F.col("shift_part")),
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, at = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
        sizes, ranks = length.to_numpy(), rank.to_numpy()
        for one in np.unique(sizes):
            ends, starts, offsets = found[one]
            mine = sizes == one
            slot = np.searchsorted(ends, ranks[mine], side="right")
            begin = np.where(slot > 0, ends[slot - 1], 0)
            seq[mine] = starts[slot] + ranks[mine] - begin
            at[mine] = offsets[slot]
        return pd.DataFrame({"sequence_id": seq, "offset": at})

    placed = fresh(base, "placed")
    return ranked.withColumn(placed, place(F.col("length"), F.col(number) + F.col("shift"))).select(
        *base.columns, f"{placed}.*"
    )


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents, written once, and their places in the sequences."""
    return pack(written(token_pieces(docs, tokenizer, pattern, capacity=capacity), "pieces"), capacity)
