"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

The sketch follows Dahlgaard, Knudsen and Thorup, "Fast Similarity Sketching" (FOCS 2017).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import written
from .common import small_batches, tidy

#: Words of a shingle; links need 100 * |A and B| >= SIMILARITY * |A or B|.
SHINGLE = 5
SIMILARITY = 75
#: Bands of the sketch and coordinates of a band. A pair at the limit shares no band once in 200,000 cases
#: ((1 - 0.75 ** 4) ** 32 = 5e-6), and more similar pairs far more rarely.
BANDS = 32
ROWS = 4

_MASK = (1 << 64) - 1
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(33)
#: Bits of the filter that picks the documents whose full sets are needed, as a power of two; bits of one slice of it.
FILTER_BITS = 27
_SLICE = 32768
#: Members of a block of full sets, and of a block of sketches, two of which one task compares; the share of sketch coordinates below which a pair is not compared in
#: full: five standard deviations of a 128-coordinate sketch below the similarity (a miss once in two million pairs).
BLOCK = 512
SKETCH_BLOCK = 2048
LEAST_AGREEMENT = 0.56


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> _SHIFT)) * _MIX1
    x = (x ^ (x >> _SHIFT)) * _MIX2
    return x ^ (x >> _SHIFT)


def shingle_sets(texts: Iterable[str | None], words_per_shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct 64-bit hashes of the word shingles of each text, one text after the other, and how many each
    text has; A-Z are lower-cased.

    A text with fewer words has its whole word sequence as the one shingle, a text without words or null has none.
    """
    words = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in texts]
    n = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), dtype=np.uint64, count=int(n.sum()))
    begin = np.cumsum(n) - n

    def hashed(k: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the ``k`` words from each place on."""
        h = np.full(len(at), k, dtype=np.uint64)
        for i in range(k):
            h = _mix(h * _STEP + w[at + i])
        return h

    long = n >= words_per_shingle
    sizes = np.where(long, n - words_per_shingle + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), sizes)
    at = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    found = np.empty(len(at), dtype=np.uint64)
    whole = long[owner]
    found[whole] = hashed(words_per_shingle, at[whole])
    for k in range(1, words_per_shingle):
        short = n[owner] == k
        if short.any():
            found[short] = hashed(k, at[short])
    ends = np.cumsum(sizes)
    for i, j in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        found[i:j].sort()
    first = np.ones(len(found), dtype=bool)
    first[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[first], np.bincount(owner[first], minlength=len(n))


def cut_sets(found: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """The sets of ``shingle_sets`` one by one."""
    return np.split(found, np.cumsum(sizes)[:-1]) if len(sizes) else []


def shingle_set(text: str | None, words_per_shingle: int = SHINGLE) -> np.ndarray:
    """The set of one text (see ``shingle_sets``)."""
    return shingle_sets([text], words_per_shingle)[0]


def sketch(elements: np.ndarray, size: int) -> np.ndarray:
    """The fast similarity sketch of a set of 64-bit hashes: ``size`` coordinates, of which two sets share a fraction
    that is concentrated around their Jaccard similarity.

    In round ``i`` of the first ``size`` rounds every element falls into the bin that its hash of that round names, in
    the later rounds all elements fall into bin ``i - size``; a bin keeps the smallest pair (round, value). Rounds end
    when every bin is filled, which two times ``size`` rounds guarantee; a set of more than ``size`` log ``size``
    elements mostly needs one or two.
    """
    bins = np.zeros(size, dtype=np.uint64)
    empty = np.ones(size, dtype=bool)
    salt, lim = 0, np.uint64(size)
    for i in range(2 * size):
        salt = (salt + int(_STEP)) & _MASK
        h = _mix(elements ^ np.uint64(salt))
        if i < size:
            at = (h % lim).astype(np.int64)
            new = empty[at]
            if not new.any():
                continue
            at, h = at[new], h[new]
            least = np.full(size, _MASK, dtype=np.uint64)
            np.minimum.at(least, at, h)
            filled = np.zeros(size, dtype=bool)
            filled[at] = True
            bins[filled] = _mix(least[filled] ^ np.uint64(i))
            empty &= ~filled
        elif empty[i - size]:
            bins[i - size] = _mix(h.min(keepdims=True) ^ np.uint64(i))[0]
            empty[i - size] = False
        if not empty.any():
            break
    return bins


def band_keys(coordinates: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, different for different bands."""
    grid = coordinates[: bands * rows].reshape(bands, rows)
    h = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        h = _mix(h * _STEP + grid[:, i])
    return h


def _sketched(docs: DataFrame, words_per_shingle: int, bands: int, rows: int) -> DataFrame:
    """``docs(id, text)`` as ``(id, n, digest, bands, marks)``: ``digest`` (128 bits) stands for the whole shingle set,
    ``marks`` has one byte of every sketch coordinate."""

    def one_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, digests, keys, marks = [], [], [], []
            for s in cut_sets(*shingle_sets(batch["text"], words_per_shingle)):
                c = sketch(s, bands * rows) if len(s) else None
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(band_keys(c, bands, rows).view(np.int64) if len(s) else None)
                marks.append(c.astype(np.uint8).tobytes() if len(s) else None)
            yield pd.DataFrame({"id": batch["id"], "n": n, "digest": digests, "bands": keys, "marks": marks})

    return docs.mapInPandas(tidy(one_batch), "id long, n long, digest binary, bands array<long>, marks binary")


def filter_place() -> Column:
    """The bit of an id in the filter."""
    return F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))


def in_filter(place: pd.Series, bits: np.ndarray) -> np.ndarray:
    at = place.to_numpy()
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def id_filter(ids: DataFrame) -> np.ndarray:
    """A fixed number of bits, ``2 ** FILTER_BITS``, in which that of every id's hash is set (lowest bit of a byte first)."""
    number = filter_place() + 1  # slices and bits are counted from 1
    # Each row of the answer holds a fixed slice of the bits, so at most 16 MB come to the driver.
    slices = (
        ids.groupBy(F.bitmap_bucket_number(number).alias("slice"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
        .collect()
    )
    out = np.zeros(((1 << FILTER_BITS) // _SLICE, _SLICE // 8), dtype=np.uint8)
    for r in slices:
        out[r["slice"] - 1] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out.ravel()


def full_sets(docs: DataFrame, ids: DataFrame, words_per_shingle: int) -> DataFrame:
    """``(id, shingles)`` of the documents with these ``ids``, written.

    A filter of fixed size goes to the tasks that read the texts, so the texts are not shuffled; the few other
    documents that pass it are left out by the join that follows. With very many ids the filter passes more of them.
    """
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(id_filter(ids))

    def one_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[in_filter(batch["place"], bits.value)]
            own = [s.tobytes() for s in cut_sets(*shingle_sets(batch["text"], words_per_shingle))]
            yield pd.DataFrame({"id": batch["id"], "shingles": own})

    found = docs.filter(F.col("id").isNotNull()).select("id", "text", filter_place().alias("place"))
    sets = written(found.mapInPandas(tidy(one_batch), "id long, shingles binary").join(ids, "id", "left_semi"), "shingle-sets")
    bits.destroy()  # the sets are written, no task needs it again
    return sets


def similar(x: np.ndarray, y: np.ndarray, similarity: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = int((y[at] == x).sum())
    return 100 * both >= similarity * (len(x) + len(y) - both)


def verified(pairs: DataFrame, sets: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """The ``pairs(a, b)`` whose full shingle sets are similar enough. Sizes, then the sets themselves decide."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = np.zeros(len(batch), dtype=bool)
            for i, (x, y) in enumerate(zip(batch["sa"], batch["sb"], strict=True)):
                keep[i] = similar(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), similarity)
            yield batch.loc[keep, ["a", "b"]]

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInPandas(tidy(check), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words_per_shingle: int = SHINGLE,
    similarity: int = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: the size of each row's shingle set and the smallest ``doc_id`` that it
    reaches over links, itself included.

    Two documents are linked when ``100 * |A and B| >= similarity * |A or B|`` for their sets of word shingles. One row
    comes back per row of ``docs``; rows with a null id have a null component, rows without words (or with a null
    text) are linked with nothing. Rows that repeat an id are documents of their own with that id. Other columns are
    ignored. An empty table gives an empty table.

    1. Every text is reduced, where it is read, to its set size, a digest of its set, its band keys and sketch.
    2. Documents with equal sets are folded to the smallest id; from here on a group of copies is one row.
    3. Documents that share a band key are candidates. The members of a bucket are first compared with two leaders, so
       a bucket of n near copies gives about 2 n pairs; sizes that cannot reach the similarity are left out. Full
       shingle sets, computed only for candidates, decide, and links give components. Buckets of up to three members
       are complete by then.
    4. In buckets whose members still belong to different components, each member is compared in full with the member
       of another component that its sketch agrees with most. After that groups of near copies are one component.
    5. What is left is searched without exception: buckets name the pairs of components between which some sketches
       agree enough, and for these all members of the one are compared with all members of the other, block by block
       inside tasks, where sketches and then full sets decide. Only links leave a task, never pairs.
    6. Components are joined back to all documents by set digest.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    marked = written(_sketched(base, words_per_shingle, bands, rows), "sketches")
    nodes = written(
        marked.filter(F.col("id").isNotNull() & (F.col("n") > 0))
        .groupBy("digest")
        .agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("marks").alias("marks")),
        "sketch-nodes",
    )
    linked = _linked(nodes, base, words_per_shingle, similarity).select(F.col("node").alias("id"), "component")
    classes = nodes.select("digest", "id").join(linked, "id", "left").select(
        F.col("digest").alias("set"), F.coalesce("component", "id").alias("component")
    )
    out = marked.select("id", "n", "digest").join(classes, F.col("digest") == F.col("set"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _linked(nodes: DataFrame, base: DataFrame, words_per_shingle: int, similarity: int) -> DataFrame:
    """Steps 3 to 5: ``(node, component)`` for the nodes that have a link."""
    sizes = nodes.select("id", "n")
    rows = nodes.select("id", F.explode("bands").alias("key"))

    def possible(pairs: DataFrame) -> DataFrame:
        """Distinct pairs whose sizes allow the similarity."""
        a, b = sizes.toDF("a", "na"), sizes.toDF("b", "nb")
        fits = 100 * F.least("na", "nb") >= similarity * F.greatest("na", "nb")
        ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        return ordered.join(a, "a").join(b, "b").filter(fits).select("a", "b")

    def links(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        return written(verified(pairs, full_sets(base, ids, words_per_shingle), similarity), "links")

    ends = rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi")
    to_leaders = (
        rows.join(ends, "key")
        .select(F.col("id").alias("a"), F.explode(F.array("lo", "hi")).alias("b"))
        .filter("a <> b")
    )
    found = links(written(possible(to_leaders), "pairs"))
    linked = written(components(found, []), "classes")

    best = _in_buckets(nodes, linked, similarity, pairs_of_classes=False)
    more = links(written(best.select("a", "b").distinct(), "pairs"))
    found = found.union(more)
    linked = written(components(found, []), "classes")

    across = written(_in_buckets(nodes, linked, similarity, pairs_of_classes=True).distinct(), "class-pairs")
    if across.isEmpty():
        return linked
    rest = written(_between_classes(across, nodes, linked, base, words_per_shingle, similarity), "links")
    return components(found.union(rest), [])


def _with_class(nodes: DataFrame, linked: DataFrame) -> DataFrame:
    own = linked.select(F.col("node").alias("id"), "component")
    return nodes.join(own, "id", "left").withColumn("component", F.coalesce("component", "id"))


def sorted_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows with equal keys, from batches sorted by them."""
    held = None
    for batch in batches:
        batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        cuts = [0, *(np.nonzero((k[1:] != k[:-1]).any(1))[0] + 1)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.iloc[a:b]
        held = batch.iloc[cuts[-1] :].reset_index(drop=True)
    if held is not None:
        yield held


def _agreeing(group: pd.DataFrame, similarity: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each member, which members of other classes it may be similar to by size and sketch, and the agreements."""
    marks = np.frombuffer(b"".join(group["marks"]), dtype=np.uint8).reshape(len(group), -1)
    n, classes = group["n"].to_numpy(), group["component"].to_numpy()
    least = LEAST_AGREEMENT * marks.shape[1]
    for i in range(len(group)):
        fits = (classes != classes[i]) & (100 * np.minimum(n, n[i]) >= similarity * np.maximum(n, n[i]))
        same = np.zeros(len(group), dtype=np.int64)
        same[fits] = (marks[fits] == marks[i]).sum(1)
        yield i, fits & (same >= least), same


def _in_buckets(nodes: DataFrame, linked: DataFrame, similarity: int, pairs_of_classes: bool) -> DataFrame:
    """``(a, b)`` from buckets with members of several classes: for each member and the member of another class whose
    sketch agrees with its own most, their ids; or, with ``pairs_of_classes``, the classes of any two that agree.

    Large buckets are cut into blocks; a task compares two blocks and holds no more.
    """
    classed = _with_class(nodes, linked)
    narrow = classed.select("id", "component", F.explode("bands").alias("key"))
    mixed = (
        narrow.groupBy("key")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"))
        .filter("lo < hi and members > 3")
        .select("key", F.ceil(F.col("members") / SKETCH_BLOCK).cast("int").alias("blocks"))
    )
    # Sketches join after the buckets are chosen, so only those of members of open buckets are sent.
    chosen = written(narrow.select("id", "key").join(mixed, "key"), "open-buckets")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    sent = (
        chosen.join(classed.select("id", "n", "marks", "component"), "id")
        .withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "id", "n", "marks", "component")
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for group in sorted_groups(batches, ["key", "p", "q"]):
            ids, classes = group["id"].to_numpy(), group["component"].to_numpy()
            for i, fits, same in _agreeing(group, similarity):
                if fits.any():
                    others = classes[fits] if pairs_of_classes else [ids[np.where(fits, same, -1).argmax()]]
                    own = classes[i] if pairs_of_classes else ids[i]
                    out += {(min(own, x), max(own, x)) for x in others}
            if len(out) > 10_000:
                yield pd.DataFrame(sorted(set(out)), columns=["a", "b"])
                out = []
        yield pd.DataFrame(sorted(set(out)), columns=["a", "b"]).astype("int64")

    keys = ["key", "p", "q"]
    return sent.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(tidy(search), "a long, b long")


def _between_classes(
    across: DataFrame, nodes: DataFrame, linked: DataFrame, base: DataFrame, words_per_shingle: int, similarity: int
) -> DataFrame:
    """The links ``(a, b)`` between members of each pair of classes ``across(a, b)``.

    The members of the larger class of a pair are cut into blocks, and so are the members of all smaller classes that
    it is paired with; each task compares one block with one block.
    """
    members = _with_class(nodes, linked).select("id", "n", "marks", "component")
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    a, b = sizes.toDF("a", "size_a"), sizes.toDF("b", "size_b")
    larger = F.col("size_a") >= F.col("size_b")
    pairs = written(
        across.join(a, "a")
        .join(b, "b")
        .select(
            F.when(larger, F.col("a")).otherwise(F.col("b")).alias("key"),
            F.when(larger, F.col("b")).otherwise(F.col("a")).alias("component"),
            F.greatest("size_a", "size_b").alias("size"),
            F.least("size_a", "size_b").alias("size_other"),
        ),
        "class-pairs",
    )

    def blocks(size: str):
        return F.ceil(F.col(size) / BLOCK).cast("int")

    grid = pairs.groupBy("key").agg(F.max("size").alias("size"), F.sum("size_other").alias("size_other")).select(
        "key", blocks("size").alias("ps"), blocks("size_other").alias("qs")
    )
    involved = pairs.select(F.explode(F.array("key", "component")).alias("component")).distinct()
    chosen = members.join(involved, "component", "left_semi")
    full = chosen.join(full_sets(base, chosen.select("id"), words_per_shingle), "id")

    def every(n: str):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def own(n: str):
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    columns = ["key", "p", "q", "id", "n", "marks", "component", "shingles"]
    left = full.join(grid, F.col("component") == F.col("key")).withColumn("p", own("ps")).withColumn("q", every("qs"))
    right = (
        full.join(pairs.select("key", "component"), "component")
        .join(grid, "key")
        .withColumn("p", every("ps"))
        .withColumn("q", own("qs"))
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in sorted_groups(batches, ["key", "p", "q"]):
            out = []
            key = group["key"].iloc[0]
            ids, classes = group["id"].to_numpy(), group["component"].to_numpy()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in group["shingles"]]
            for i, fits, _ in _agreeing(group, similarity):
                if classes[i] != key:
                    out += [
                        (ids[i], ids[j])
                        for j in np.nonzero(fits & (classes == key))[0]
                        if similar(sets[i], sets[j], similarity)
                    ]
            yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    keys = ["key", "p", "q"]
    sent = left.select(*columns).union(right.select(*columns))
    return sent.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(tidy(search), "a long, b long")
