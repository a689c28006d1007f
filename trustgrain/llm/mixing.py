"""Mixing sources to target weights by hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import content_key, fresh, n_words, same

#: Weights of the sources in code point order (null last), repeated; share of all words that the mix has; most times
#: that a source may be repeated.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Buckets of a histogram; the boundary bucket is refined once by as many.
BUCKETS = 4096
_DIGITS = 3  # hexadecimal digits of a bucket number


def _hash(columns: list[str]) -> Column:
    """A number below ``BUCKETS ** 2`` that depends on the row's values alone."""
    digits = F.substring(content_key(*[F.col(c) for c in columns]), 1, 2 * _DIGITS)
    return F.conv(digits, 16, 10).cast("long")


def source_targets(
    sums: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """``(source, source_size, target)`` for each row of ``sums(source, source_size)``, which has one row per source.

    Sources ranked by code point, null last, have the ``weights`` in turn and share ``share`` times all sizes. No
    target is above ``most`` times its source's size; what would be above goes to the other sources by weight, until
    none is above. Sources without words have the target 0.

    The rank needs no single sorted task: sources are dealt out by range, numbered inside each range and shifted by the
    number of sources before it. The resharing is one small sum per round; a round adds at least one source to those
    at their limit, usually many.
    """
    spark = sums.sparkSession
    ranged = written(
        sums.repartitionByRange(spark.sparkContext.defaultParallelism, F.asc_nulls_last("source")).withColumn(
            "part", F.spark_partition_id()
        ),
        "mix-sources",
    )
    before = ranged.groupBy("part").count().withColumn(
        "before", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    )
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source")))
    rank = inside - 1 + F.coalesce("before", F.lit(0))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    ranked = written(
        ranged.join(before, "part").select("source", "source_size", weight.cast("long").alias("weight")), "mix-weights"
    )
    limit = F.col("source_size") * most
    whole = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget = share * (whole["size"] or 0)
    rate = budget / whole["weight"] if whole["weight"] else 0.0
    full = (0, 0)
    while True:
        at_limit = ranked.filter(limit < F.lit(rate) * F.col("weight"))
        got = at_limit.agg(F.sum(limit).alias("size"), F.sum("weight").alias("weight")).first()
        now = (got["size"] or 0, got["weight"] or 0)
        if now == full or now[1] == whole["weight"]:
            break
        full = now
        rate = (budget - full[0]) / (whole["weight"] - full[1])
    target = F.least(limit.cast("double"), F.lit(float(rate)) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, source_size, target, epochs, threshold)``: a document is taken ``epochs`` times, and once more where
    its hash is below ``threshold``.

    ``sizes`` has ``(source, hash, size)``. Words are summed by source and hash bucket; running sums over the at most
    ``BUCKETS`` buckets of a source give the bucket in which the budget ends. Only the rows of that bucket are summed
    again, by finer buckets, and the budget ends at the finer bound nearest to it. Budgets are nested: a smaller target
    of the same source takes a subset of the documents. Nothing is sorted but these bucket sums.
    """
    epochs = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0))
    budgets = targets.withColumn("epochs", epochs.cast("long")).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size")
    )
    bucket, fine = F.floor(F.col("hash") / BUCKETS), F.pmod(F.col("hash"), F.lit(BUCKETS))
    named = budgets.withColumnRenamed("source", "_source")
    on = same(F.col("source"), F.col("_source"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    coarse = (
        sizes.groupBy("source", bucket.alias("bucket"))
        .agg(F.sum("size").alias("size"))
        .withColumn("upto", F.sum("size").over(upto))
        .join(named, on)
        .filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("size") <= F.col("rest")))
        .select("source", "bucket", (F.col("rest") - F.col("upto") + F.col("size")).alias("left"))
    )
    edge = coarse.select(F.col("source").alias("_source"), F.col("bucket").alias("edge"), "left")
    step = Window.partitionBy("source", "edge", "left").orderBy("fine")
    fine_sums = (
        sizes.join(edge, on & (bucket == F.col("edge")))
        .groupBy("source", "edge", "left", fine.alias("fine"))
        .agg(F.sum("size").alias("size"))
        .withColumn("upto", F.sum("size").over(step.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .filter(F.abs(F.col("upto") - F.col("left")) < F.abs(F.col("upto") - F.col("size") - F.col("left")))
        .groupBy("source", "edge")
        .agg(F.max("fine").alias("fine"))
        .select(F.col("source").alias("_fine_source"), (F.col("edge") * BUCKETS + F.col("fine") + 1).alias("fine_end"))
    )
    return (
        budgets.join(edge, on, "left")
        .drop("_source", "left")
        .join(fine_sums, same(F.col("source"), F.col("_fine_source")), "left")
        # Without a boundary bucket every bucket fits; that can only be where nothing or a whole round is left to take.
        .withColumn("threshold", F.coalesce("fine_end", F.col("edge") * BUCKETS, F.lit(0)).cast("long"))
        .select("source", "source_size", "target", "epochs", "threshold")
    )


def mix(
    docs: DataFrame,
    source: str = "source",
    text: str = "text",
    key: tuple[str, ...] = ("doc_id", "text"),
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
) -> DataFrame:
    """``docs`` with ``size`` (words of the text), ``source_size``, ``target`` (of the source), ``copies`` and ``taken``
    (words that the mix takes from this row: ``copies`` times ``size``).

    Every row stays; ``copies`` says how often it is in the mix, at most ``most`` times. Rows with equal values in
    ``key`` are taken alike. A null source is a source of its own, a null or blank text has size 0. Columns of these
    five names that ``docs`` may have are replaced. An empty table gives an empty table.

    The text is read once for the sizes, which are written as three numbers per row; all sums run over those. The
    thresholds, one row per source, are joined with the rows: broadcast by the planner when small, else a join that
    adaptive execution splits for a large source.
    """
    own = ("size", "source_size", "target", "copies", "taken")
    sizes = written(
        docs.select(F.col(source).alias("source"), _hash(list(key)).alias("hash"), n_words(F.col(text)).alias("size")),
        "mix-sizes",
    )
    # With its size, a row's hash is computed again below: a join on the key would shuffle the texts.
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    limits = written(thresholds(sizes, source_targets(sums, weights, share, most)), "mix-thresholds")
    base = docs.select(*[c for c in docs.columns if c not in own])
    names = {c: fresh(base, f"mix_{c}") for c in ("source", "threshold", "epochs", "hash")}
    limits = limits.withColumnsRenamed({c: names[c] for c in ("source", "threshold", "epochs")})
    rows = base.withColumn("size", n_words(F.col(text))).withColumn(names["hash"], _hash(list(key)))
    extra = (F.col(names["hash"]) < F.col(names["threshold"])).cast("long")
    copies = (F.col(names["epochs"]) + F.when(F.col(names["epochs"]) < most, extra).otherwise(0)).cast("long")
    return (
        rows.join(limits, same(F.col(source), F.col(names["source"])))
        .withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*base.columns, *own)
    )
