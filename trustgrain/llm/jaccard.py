"""Set similarity join by PartEnum signatures.

After Arasu, Ganti and Kaushik, "Efficient Exact Set-Similarity Joins" (VLDB 2006).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import written
from .common import small_batches, tidy
from .neardup import (
    BLOCK,
    SHINGLE,
    cut_sets,
    filter_place,
    full_sets,
    id_filter,
    in_filter,
    shingle_sets,
    similar,
    sorted_groups,
    verified,
)

#: Links need 100 * |A and B| >= SIMILARITY * |A or B|.
SIMILARITY = 80
#: Largest size of a band in percent of its smallest: no less than 100 / similarity.
BAND_PERCENT = 125
#: What a plan of signatures aims at: elements that a signature of a band's smallest sets covers on average, and the
#: share of such sets that have to show signatures without elements.
LEAST_COVERED = 3.0
MOST_BARE = 5e-3
#: Fewest bits of the sketch that bounds the difference of two sets from below; it has at least ``ODD_BITS_EACH`` bits
#: for every element of a set.
ODD_BITS = 256
ODD_BITS_EACH = 2
#: Bits of a second, shorter sketch of every set, which is what open signatures are searched with first.
SHORT_BITS = 1024
#: Signatures that one group of the shuffle holds, about; groups are at least so many.
PLACE_ROWS = 500_000
LEAST_PLACES = 64

_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * _MIX1
    x = (x ^ (x >> _HALF)) * _MIX2
    return x ^ (x >> np.uint64(29))


def most_different(size_a: int, size_b: int, similarity: int = SIMILARITY) -> int:
    """The largest number of elements in one of two similar sets only."""
    return (100 - similarity) * (size_a + size_b) // (100 + similarity)


@dataclass(frozen=True)
class Plan:
    """How sets of one size band, and larger ones that may be similar to them, are signed.

    The domain is hashed into ``first`` partitions and each of them into ``second`` parts; a signature is made of the
    elements in one partition and all of its parts but ``left_out``. Sets that differ in at most ``different`` elements
    agree on some signature in more than ``spare`` partitions: fewer than ``first - spare`` partitions can have more
    than ``left_out`` differences, and in the others the differences leave enough parts untouched.
    """

    band: int
    different: int
    first: int
    second: int
    left_out: int
    spare: int

    @property
    def subsets(self) -> np.ndarray:
        """One column per choice of parts, 1 where the part is taken."""
        taken = list(itertools.combinations(range(self.second), self.second - self.left_out))
        out = np.zeros((self.second, len(taken)), dtype=np.uint64)
        for c, parts in enumerate(taken):
            out[list(parts), c] = 1
        return out


def bands(upto: int, similarity: int = SIMILARITY, percent: int = BAND_PERCENT) -> list[tuple[int, int]]:
    """Size bands from 1 on, as (smallest, largest), up to that which holds ``upto``.

    They are wide enough that a similar set which is larger than its partner is in the same band or the next.
    """
    out = [(1, max(1, 100 // similarity))]
    while out[-1][1] < upto:
        low = out[-1][1] + 1
        out.append((low, max(low * 100 // similarity, low * percent // 100)))
    return out


def _more_than(n: int, p: float, most: int) -> float:
    """The chance of more than ``most`` successes in ``n`` trials (by a normal bound where ``n`` is large)."""
    if p >= 1:
        return 1.0
    if n * p > 200:
        return 0.0 if most > n * p + 5 * math.sqrt(n * p) else 1.0
    term = upto = math.exp(n * math.log1p(-p))
    for i in range(min(most, n)):
        term *= (n - i) / (i + 1) * p / (1 - p)
        upto += term
    return max(0.0, 1 - upto)


@lru_cache(maxsize=1000)
def plan(band: int, low: int, high: int, similarity: int = SIMILARITY) -> Plan | None:
    """The plan with the fewest signatures for the sets of a band; None where similar sets have to be equal.

    ``spare`` partitions are added so that sets need not show signatures without elements, which all sets of a band
    would share: a set that has such in at most ``spare`` partitions leaves them out, since one of the signatures that
    it shares with a similar set then has elements.
    """
    different = most_different(high, high * 100 // similarity, similarity)
    if different == 0:
        return None
    best, fewest = None, math.inf
    for left_out in range(5):
        for second in range(left_out + 2, 13):
            choices = math.comb(second, left_out)
            least = different // (left_out + 1) + 1
            covered = (second - left_out) / second
            if choices > 300:
                break
            for spare in (0, 1, 2, 3, 4, 6, 8, *(2 ** (i // 4) * (4 + i % 4) for i in range(5, 60))):
                first = least + spare
                if first * choices >= fewest or low * covered / first < min(LEAST_COVERED, low / 2):
                    break
                bare = (1 - covered / first) ** low
                share = _more_than(first, min(1.0, choices * bare), spare) * (spare + 1) / (first * choices)
                if share <= MOST_BARE:
                    best, fewest = Plan(band, different, first, second, left_out, spare), first * choices
                    break
    if best is None:  # very small sets: one partition, as many parts as keep the number of choices low
        best = Plan(band, different, 1, different + 2, different, 0) if different < 6 else Plan(band, different, different + 1, 1, 0, 0)
    return best


class Signer:
    """Signatures of sets of any size: those of the own band and, for partners that are smaller, of the band below."""

    def __init__(self, similarity: int = SIMILARITY, percent: int = BAND_PERCENT):
        self.similarity, self.percent = similarity, percent
        self.bands: list[tuple[int, int]] = []
        self.plans: dict[int, tuple[Plan, np.ndarray] | None] = {}

    def _plan(self, band: int) -> tuple[Plan, np.ndarray] | None:
        if band not in self.plans:
            p = plan(band, *self.bands[band], self.similarity)
            self.plans[band] = p and (p, p.subsets)
        return self.plans[band]

    def sign(self, elements: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of many sets, one after the other in ``elements``, as 64-bit keys, and the set of each."""
        largest = int(sizes.max(initial=1))
        if not self.bands or self.bands[-1][1] < largest:
            self.bands = bands(2 * largest, self.similarity, self.percent)
        high = np.array([h for _, h in self.bands])
        own = np.searchsorted(high, sizes)
        below = np.where((own > 0) & (self.similarity * sizes <= 100 * high[own - 1]), own - 1, -1)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        where = _mix(elements, 1)
        keys, sets = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        for band in np.unique(np.concatenate([own, below])).tolist():
            found = self._plan(band) if band >= 0 else None
            if found is None:
                continue
            chosen = ((own == band) | (below == band)) & (sizes > 0)
            number = np.cumsum(chosen) - 1
            mine = chosen[owner]
            of_key, key = signatures(elements[mine], where[mine], number[owner[mine]], int(chosen.sum()), *found)
            keys.append(key)
            sets.append(np.nonzero(chosen)[0][of_key])
        return np.concatenate(keys), np.concatenate(sets)


def signatures(
    elements: np.ndarray, where: np.ndarray, owner: np.ndarray, n: int, p: Plan, subsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The signatures of ``n`` sets under one plan: the set of each and the key. ``where`` places the elements."""
    partition = ((where >> _HALF) * np.uint64(p.first)) >> _HALF
    part = ((where & _LOW) * np.uint64(p.second)) >> _HALF
    cells = p.first * p.second
    at = owner * cells + (partition * np.uint64(p.second) + part).astype(np.int64)
    sums = np.zeros(n * cells, dtype=np.uint64)
    np.add.at(sums, at, elements)
    held = np.bincount(at, minlength=n * cells) > 0
    taken = subsets.astype(bool)
    full = np.stack([held.reshape(-1, p.second)[:, t].any(1) for t in taken.T], 1).reshape(n, p.first, -1)
    keys = (sums.reshape(-1, p.second) @ subsets).reshape(n, p.first, -1)
    number = np.arange(p.first * keys.shape[2], dtype=np.uint64).reshape(1, p.first, -1)
    keys = _mix(keys ^ _mix(number + (np.uint64(p.band) << np.uint64(40)), 3), 2)
    # Signatures without elements are shown only by sets that have them in more than ``spare`` partitions.
    full |= ((~full).any(2).sum(1) > p.spare)[:, None, None]
    return np.nonzero(full)[0], keys[full]


def odd_bits(elements: np.ndarray, bits: int | None = None) -> bytes:
    """For each of a number of cells, whether an odd number of elements falls into it. Where two sets differ in a cell,
    at least one element is in one of them only. Unless ``bits`` are given, a set twice as large has twice as many."""
    bits = bits or max(ODD_BITS, 1 << (ODD_BITS_EACH * len(elements) - 1).bit_length())
    at = (elements & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(cells: bytes, size: int) -> np.ndarray:
    """Odd bits of a larger number of cells as those of ``size`` bytes: cells that fall together are added."""
    return np.bitwise_xor.reduce(np.frombuffer(cells, dtype=np.uint64).reshape(-1, size // 8), axis=0)


def _may_link(n_a, n_b, odd_a: np.ndarray, odd_b: np.ndarray, similarity: int) -> np.ndarray:
    """Pairs that sizes and odd bits allow; no similar pair is left out."""
    most = (100 - similarity) * (n_a + n_b) // (100 + similarity)
    return (np.abs(n_a - n_b) <= most) & (np.bitwise_count(odd_a ^ odd_b).sum(-1, dtype=np.int64) <= most)


def _measured(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    def one_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = cut_sets(*shingle_sets(batch["text"], words_per_shingle))
            yield pd.DataFrame({
                "id": batch["id"],
                "n": [len(s) for s in sets],
                "digest": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "odd": [odd_bits(s) if len(s) else None for s in sets],
                "short": [odd_bits(s, SHORT_BITS) if len(s) else None for s in sets],
            })

    return docs.mapInPandas(tidy(one_batch), "id long, n long, digest binary, odd binary, short binary")


#: Signatures of a batch that meet those of other batches in one group, ``place``. ``keys`` has 6 bytes of every key, of
#: which ``place`` is the rest; ids are ``width`` bytes each above ``least``; ``many`` is a bit. Rows with ``leaders``
#: need not meet any others.
SIGNED = "place long, keys binary, ids binary, width int, least long, many binary, leaders binary"


def _packed(ids: np.ndarray) -> tuple[bytes, int, int]:
    least = int(ids.min())
    away = ids.astype(np.uint64) - np.uint64(least & (2**64 - 1))
    width = next(w for w in (2, 4, 8) if w == 8 or int(away.max()) < 1 << 8 * w)
    return away.astype(f"<u{width}").tobytes(), width, least


def _unpacked(data: bytes, width: int, least: int) -> np.ndarray:
    return (np.frombuffer(data, dtype=f"<u{width}").astype(np.uint64) + np.uint64(least & (2**64 - 1))).astype(np.int64)


def _signed(docs: DataFrame, ids: DataFrame, places: int, words_per_shingle: int, similarity: int) -> DataFrame:
    """Rows of ``SIGNED``: signatures of the sets of those ``docs(id, text)`` that have one of ``ids``.

    Signatures that several sets of a batch share are gathered there: the smallest id is their leader and goes on, marked
    as having ``many``; the others name it and stay behind. A group gets one row per batch, keys packed.

    Copies of a text that pass the fixed-size filter of ids are signed too; they are like the id that stands for them.
    """
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def one_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(similarity)
        apart = TaskContext.get().partitionId() << 20
        for batch in batches:
            batch = batch[in_filter(batch["place"], bits.value)]
            if not len(batch):
                continue
            key, at = signer.sign(*shingle_sets(batch["text"], words_per_shingle))
            # Of a key, 48 bits and its place are sent; whatever else it has is dropped here, so that all agree.
            key = (key & ~np.uint64(0xFFFF)) | (key & np.uint64((places - 1) & 0xFFFF))
            own = batch["id"].to_numpy(dtype=np.int64)[at]
            order = np.argsort(key)
            key, own = key[order], own[order]
            start = np.ones(len(key), dtype=bool)
            start[1:] = key[1:] != key[:-1]
            first, group = np.nonzero(start)[0], np.cumsum(start) - 1
            leader = np.minimum.reduceat(own, first) if len(own) else own
            sizes = np.diff(np.append(first, len(key)))
            member = own != leader[group]
            yield pd.DataFrame(_rows(key[first], leader, sizes > 1, places), columns=[c.split()[0] for c in SIGNED.split(", ")])
            if member.any():
                yield pd.DataFrame({
                    "place": [-1 - apart], "keys": [key[member].tobytes()], "ids": [own[member].tobytes()], "width": [8], "least": [0],
                    "many": [b""], "leaders": [leader[group][member].tobytes()],
                })
                apart += 1

    found = docs.filter(F.col("id").isNotNull()).select("id", "text", filter_place().alias("place"))
    return found.mapInPandas(tidy(one_batch), SIGNED)


def _rows(key: np.ndarray, ids: np.ndarray, many: np.ndarray, places: int) -> list[dict]:
    place = key & np.uint64(places - 1)
    order = np.argsort(place, kind="stable")
    out = []
    for part in np.split(order, np.nonzero(np.diff(place[order]))[0] + 1):
        if len(part):
            packed, width, least = _packed(ids[part])
            keys = key[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
            bits = np.packbits(many[part]).tobytes()
            out.append({"place": int(place[part[0]]), "keys": keys, "ids": packed, "width": width, "least": least, "many": bits, "leaders": None})
    return out


def _buckets(signed: DataFrame) -> DataFrame:
    """``(key, id, leader)`` for the signatures that more than one id has; each leader names the smallest leader.

    Only leaders and signatures that were alone in their batch meet by key, so of a signature that is everywhere one
    entry per batch reaches a task. A group holds about ``PLACE_ROWS`` entries.
    """
    kind = "key long, id long, leader long"

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        if group["place"].iloc[0] < 0:
            columns = [np.frombuffer(b"".join(group[c]), dtype=np.int64) for c in ("keys", "ids", "leaders")]
            return pd.DataFrame(dict(zip(["key", "id", "leader"], columns, strict=True)))
        cut = np.frombuffer(b"".join(group["keys"]), dtype=np.uint8).reshape(-1, 6)
        key = np.zeros((len(cut), 8), dtype=np.uint8)
        key[:, 2:] = cut
        key = key.view("<u8").ravel().astype(np.uint64) | np.uint64(int(group["place"].iloc[0]) & 0xFFFF)
        parts = [_unpacked(*x) for x in zip(group["ids"], group["width"].astype(int), group["least"].astype(int), strict=True)]
        ids = np.concatenate(parts)
        many = np.concatenate(
            [np.unpackbits(np.frombuffer(m, dtype=np.uint8), count=len(p)) for m, p in zip(group["many"], parts, strict=True)]
        ).astype(bool)
        order = np.argsort(key)
        key, ids, many = key[order], ids[order], many[order]
        start = np.ones(len(key), dtype=bool)
        start[1:] = key[1:] != key[:-1]
        first, at = np.nonzero(start)[0], np.cumsum(start) - 1
        leader = np.minimum.reduceat(ids, first)[at]
        shown = (np.diff(np.append(first, len(key)))[at] > 1) | np.logical_or.reduceat(many, first)[at]
        return pd.DataFrame({"key": key.view(np.int64), "id": ids, "leader": leader})[shown]

    return signed.groupBy("place").applyInPandas(meet, kind)


def _possible(pairs: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """The distinct ``pairs(a, b)`` that sizes and odd bits allow."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            keep = []
            for n_a, n_b, a, b in zip(x["na"], x["nb"], x["oa"], x["ob"], strict=True):
                size = min(len(a), len(b))
                keep.append(bool(_may_link(n_a, n_b, _folded(a, size), _folded(b, size), similarity)))
            yield x.loc[np.array(keep, dtype=bool), ["a", "b"]]

    a = nodes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("odd").alias("oa"))
    b = nodes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("odd").alias("ob"))
    return pairs.join(a, "a").join(b, "b").mapInPandas(tidy(check), "a long, b long").distinct()


def _classed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    own = classes.select(F.col("node").alias("id"), "component")
    return rows.join(own, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes(node, component)`` after further ``links(a, b)``: only links between classes are followed."""
    a, b = (classes.select(F.col("node").alias(x), F.col("component").alias(f"class_{x}")) for x in ("a", "b"))
    own = [F.coalesce(f"class_{x}", x).alias(x) for x in ("a", "b")]
    across = written(links.join(a, "a", "left").join(b, "b", "left").select(*own).filter("a <> b").distinct(), "class-links")
    if across.isEmpty():
        return classes
    moved = written(components(across, []), "merged-classes").select(F.col("node").alias("component"), F.col("component").alias("merged"))
    known = classes.join(moved, "component", "left").select("node", F.coalesce("merged", "component").alias("component"))
    fresh = moved.join(classes.select("component").distinct(), "component", "left_anti").select("component", "merged")
    return written(known.union(fresh), "set-classes")


def _open_members(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """``(key, blocks, id, component)``: members of signatures that three or more sets in several classes have.

    Of signatures with the same members one is named. Sets that have only two members were compared with their leader.
    """
    sizes = buckets.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 2").select("key")
    classed = written(_classed(buckets.join(sizes, "key", "left_semi").select("key", "id").distinct(), classes), "bucket-classes")
    chosen = (
        classed.groupBy("key")
        .agg(
            F.count("*").alias("members"),
            F.min("component").alias("lo"),
            F.max("component").alias("hi"),
            *[F.sum(F.xxhash64("id", F.lit(i)).cast("decimal(38,0)")).alias(f"sum{i}") for i in (1, 2)],
        )
        .filter("lo < hi and members > 2")
        .groupBy("members", "sum1", "sum2")
        .agg(F.min("key").alias("key"))
        .select("key", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    )
    return classed.join(written(chosen, "open-keys"), "key")


def _in_blocks(members: DataFrame) -> DataFrame:
    """Members with the two blocks, ``p`` and ``q``, that a task compares; large signatures have many pairs of blocks."""
    return (
        members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("p", F.least("block", "other"))
        .withColumn("q", F.greatest("block", "other"))
        .drop("block", "other")
        .repartition("key", "p", "q")
        .sortWithinPartitions("key", "p", "q")
    )


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted rows so that no group of equal ``keys`` is cut, with the places where groups start."""
    held = None
    for batch in batches:
        batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if len(batch):
            k = batch[keys].to_numpy()
            starts = np.nonzero(np.append(True, (k[1:] != k[:-1]).any(1)))[0]
            held = batch.iloc[starts[-1] :].reset_index(drop=True)
            if len(starts) > 1:
                yield batch.iloc[: starts[-1]], starts[:-1]
    if held is not None and len(held):
        yield held, np.zeros(1, dtype=np.int64)


def _pairs(rows: pd.DataFrame, starts: np.ndarray, odd: np.ndarray, similarity: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, differing cells)`` of the rows of one group and different classes that sizes and ``odd`` bits allow, some
    groups or parts of one at a time."""
    n, own = rows["n"].to_numpy(dtype=np.int64), rows["component"].to_numpy(dtype=np.int64)
    ends = np.repeat(np.append(starts[1:], len(rows)), np.diff(np.append(starts, len(rows))))
    later = ends - np.arange(len(rows)) - 1
    upto = np.cumsum(later)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 500_000, side="right")))
        count = later[at:to]
        i = np.repeat(np.arange(at, to), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        most = (100 - similarity) * (n[i] + n[j]) // (100 + similarity)
        near = (own[i] != own[j]) & (np.abs(n[i] - n[j]) <= most)
        i, j, most = i[near], j[near], most[near]
        away = np.zeros(len(i), dtype=np.int64)
        for part in range(0, len(i), 16_384):
            cut = slice(part, part + 16_384)
            away[cut] = np.bitwise_count(odd[i[cut]] ^ odd[j[cut]]).sum(1, dtype=np.int64)
        fits = away <= most
        yield i[fits], j[fits], away[fits]
        at = to


def _one_group(group: pd.DataFrame) -> np.ndarray:
    """The odd bits of a group's members, folded to the fewest that one of them has."""
    size = min(map(len, group["odd"]))
    return np.stack([_folded(x, size) for x in group["odd"]])


GROUP = ["key", "p", "q"]


def _suspects(members: DataFrame, nodes: DataFrame, similarity: int, short: bool) -> DataFrame:
    """The members ``(key, blocks, id, component)`` that sizes and odd bits allow to be similar to one of another class; with
    ``short``, the shorter sketch."""
    bits = "short" if short else "odd"

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups = _whole_groups(batches, GROUP) if short else ((g, np.zeros(1, dtype=np.int64)) for g in sorted_groups(batches, GROUP))
        for rows, starts in groups:
            odd = np.frombuffer(b"".join(rows["short"]), dtype=np.uint64).reshape(len(rows), -1) if short else _one_group(rows)
            found = np.zeros(len(rows), dtype=bool)
            for i, j, _ in _pairs(rows, starts, odd, similarity):
                found[i] = found[j] = True
            yield rows.loc[found, ["key", "blocks", "id", "component"]]

    sent = _in_blocks(members.join(nodes.select("id", "n", bits), "id"))
    return sent.mapInPandas(tidy(search), "key long, blocks int, id long, component long").distinct()


class _Forest:
    """Which members of a block are connected so far; a pair is worth a link only if it connects two others."""

    def __init__(self, classes: np.ndarray):
        self.parent = {int(c): int(c) for c in classes}

    def find(self, c: int) -> int:
        while self.parent[c] != c:
            self.parent[c] = self.parent[self.parent[c]]
            c = self.parent[c]
        return c

    def connect(self, a: int, b: int) -> None:
        self.parent[self.find(a)] = self.find(b)

    def connected(self, a: int, b: int) -> bool:
        return self.find(a) == self.find(b)


def _likely(members: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """``(key, a, b)``: for each pair of blocks as many pairs as connect whatever sizes and odd bits allow, the nearest
    first; at most one less than the members."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(batches, GROUP):
            ids, own = group["id"].to_numpy(), group["component"].to_numpy()
            forest, out = _Forest(own), []
            for i, j, away in _pairs(group, np.zeros(1, dtype=np.int64), _one_group(group), similarity):
                for k in np.argsort(away, kind="stable"):
                    x, y = int(own[i[k]]), int(own[j[k]])
                    if not forest.connected(x, y):
                        forest.connect(x, y)
                        out.append((group["key"].iloc[0], min(ids[i[k]], ids[j[k]]), max(ids[i[k]], ids[j[k]])))
            yield pd.DataFrame(out, columns=["key", "a", "b"]).astype("int64")

    sent = _in_blocks(members.join(nodes.select("id", "n", "odd"), "id"))
    return sent.mapInPandas(tidy(search), "key long, a long, b long")


def _exact(members: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links ``(a, b)``, as many as connect what is similar within each pair of blocks, decided on full sets."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(batches, GROUP):
            ids, own = group["id"].to_numpy(), group["component"].to_numpy()
            whole = [np.frombuffer(x, dtype=np.uint64) for x in group["shingles"]]
            forest, out = _Forest(own), []
            for i, j, _ in _pairs(group, np.zeros(1, dtype=np.int64), _one_group(group), similarity):
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    if not forest.connected(int(own[x]), int(own[y])) and similar(whole[x], whole[y], similarity):
                        forest.connect(int(own[x]), int(own[y]))
                        out.append((ids[x], ids[y]))
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    sent = _in_blocks(members.join(nodes.select("id", "n", "odd"), "id").join(sets, "id"))
    return sent.mapInPandas(tidy(search), "a long, b long").distinct()


def similar_classes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words_per_shingle: int = SHINGLE,
    similarity: int = SIMILARITY,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: the size of each row's shingle set and the smallest ``doc_id`` that it
    reaches over links, itself included.

    Two documents are linked when ``100 * |A and B| >= similarity * |A or B|`` for their sets of word shingles. A-Z are
    lower-cased; a text with fewer words than a shingle has its whole word sequence as the one. One row comes back per
    row of ``docs``; rows with a null id have a null component, rows without words (or with a null text) are linked
    with nothing. Rows that repeat an id are one node of the graph. Other columns are ignored, whatever their names. An
    empty table gives an empty table.

    The join is exact, but for sets that 64-bit hashes of shingles do not tell apart:

    1. Every text is reduced, where it is read, to its set's size, digest and odd bits; equal sets are folded.
    2. Sets are signed by size band (``Plan``): any two similar sets share a signature. Signatures of a batch are
       gathered before they are sent, so one that very many sets share is not one task's work.
    3. Every member of a signature is compared with its leader: each first with the one leader that it has most
       signatures in common with, then, where classes still differ, with all. Sizes, odd bits (a lower bound of the
       difference) and then the full sets decide.
    4. In signatures whose members are still in different classes, all pairs of these are compared by sizes and odd bits,
       block by block inside tasks. Only members that may be similar leave a task, then a few pairs, those that would
       connect them; their full sets decide. Where some may be similar even then, full sets are compared inside the tasks.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    measured = written(_measured(base, words_per_shingle), "set-sizes")
    nodes = written(
        measured.filter(F.col("id").isNotNull() & (F.col("n") > 0))
        .groupBy("digest")
        .agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("odd").alias("odd"), F.first("short").alias("short")),
        "sets",
    )
    total = nodes.agg(F.sum("n")).first()[0] or 0
    places = max(LEAST_PLACES, 1 << (total // PLACE_ROWS).bit_length())
    buckets = written(_buckets(_signed(base, nodes.select("id"), places, words_per_shingle, similarity)), "signatures")
    to_leader = written(
        buckets.filter("id <> leader").groupBy(F.col("leader").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("shared")),
        "leaders",
    )

    def confirmed(pairs: DataFrame) -> DataFrame | None:
        """The links among ``pairs``."""
        possible = written(_possible(pairs, nodes, similarity), "possible-pairs")
        if possible.isEmpty():
            return None
        ids = possible.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        return written(verified(possible, full_sets(base, ids, words_per_shingle), similarity), "set-links")

    classes = docs.sparkSession.createDataFrame([], "node long, component long")

    def linked(pairs: DataFrame) -> None:
        nonlocal classes
        found = confirmed(pairs)
        if found is not None:
            classes = _merged(classes, found)

    linked(to_leader.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b"))
    of_a = classes.select(F.col("node").alias("a"), F.col("component").alias("class_a"))
    of_b = classes.select(F.col("node").alias("b"), F.col("component").alias("class_b"))
    apart = F.coalesce("class_a", "a") != F.coalesce("class_b", "b")
    linked(to_leader.join(of_a, "a", "left").join(of_b, "b", "left").filter(apart).select("a", "b"))

    members = written(_suspects(_open_members(buckets, classes), nodes, similarity, short=True), "suspects")
    likely = written(_likely(members, nodes, similarity), "likely-pairs")
    linked(likely.select("a", "b"))
    if not likely.isEmpty():
        # Only signatures that had some pair can still have one.
        again = members.drop("component").join(likely.select("key").distinct(), "key", "left_semi")
        again = _classed(again, classes).select("key", "blocks", "id", "component")
        last = written(_suspects(again, nodes, similarity, short=False), "suspects")
        if not last.isEmpty():
            sets = full_sets(base, last.select("id").distinct(), words_per_shingle)
            classes = _merged(classes, _exact(last, nodes, sets, similarity))

    member = nodes.join(classes.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("digest").alias("set"), F.coalesce("component", "id").alias("component")
    )
    out = measured.select("id", "n", "digest").join(member, F.col("digest") == F.col("set"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"))
