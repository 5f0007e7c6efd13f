"""Mixing sources to target weights by a time-varying curriculum, with DataFrame functions only.

Each source gets a target share of all words by its weight; no target exceeds ``cap`` times its source's size, and
the excess is shared again by weight (the level of a water filling, raised round by round with sums over the sources).
Within a source, documents lie one behind the other in hash order; the source is passed until its
target is reached, a document being taken whole in each pass that covers its middle. The weight of a source
changes over training time as a piecewise linear schedule; its integral is the cumulative demand, and inverting
that at a document's cumulative words gives its training position.

Running sums are taken within (source, hash bucket) and moved by bucket offsets, so a source with a third of all
rows is spread over all tasks. Null texts have size 0 and are taken 0 times, as are sources without words.
A null source is a source of its own, ordered last. Rows with equal ids and texts are interchangeable. An empty table gives an
empty result. Only doc_id, text and source are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stage, tidy, with_row_id

#: Weights by rank of the source, repeating.
WEIGHTS = (1, 2, 3)
#: Demand at equally spaced times from the start to the end of training, for each of WEIGHTS.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Hex digits of the hash that make a bucket.
DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranked(by_source: DataFrame) -> DataFrame:
    """``by_source`` with ``rank``, its place by code point of the source, null last; counted by range partition, so no task sees all sources."""
    order = [F.col("source").isNull(), F.col("source")]
    placed = by_source.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(placed.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    offsets = sizes.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    return placed.join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + F.col("at")).drop("part", "at", "before")


def source_targets(sized: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """One row per source: key, source_size, class (index of its weight), target.

    The level rises from an equal share until no source that it caps is left open: each round is one sum over the sources.
    """
    by_source = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    ranked = _ranked(by_source).withColumn("class", F.col("rank") % len(weights))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("class") + 1).cast("int")).cast("long")
    filled = stage(ranked.select("key", "source_size", "class", weight.alias("weight"), (cap * F.col("source_size") / weight).alias("reach")), "sources")
    total, level, capped = filled.agg(F.sum("source_size")).first()[0] or 0, -1.0, -1
    while True:
        under = F.col("reach") < level
        n, spent, rest = filled.agg(F.count_if(under), F.sum(F.when(under, cap * F.col("source_size"))), F.sum(F.when(~under, F.col("weight")))).first()
        if n == capped or not rest:
            break
        capped, level = n, (total - (spent or 0)) / rest
    target = F.least(F.col("weight") * F.lit(float(level)), (cap * F.col("source_size")).cast("double"))
    return filled.select("key", "source_size", "class", target.alias("target"))


def invert_demand(share: Column, knots: Sequence[float]) -> Column:
    """The time in [0, 1] at which the integral of the schedule reaches ``share`` of its whole."""
    steps = len(knots) - 1
    areas = [(a + b) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    if min(knots) < 0 or min(areas) <= 0:
        raise ValueError("a schedule must not be negative, nor zero over a whole step")
    whole, before, time = sum(areas), 0.0, None
    for k, area in enumerate(areas):
        rest = F.least(F.greatest(share * whole - before, F.lit(0.0)), F.lit(area))
        slope = knots[k + 1] - knots[k]
        root = F.sqrt(knots[k] * knots[k] + 2 * slope * rest)
        part = (k + F.coalesce(2 * rest / F.nullif(knots[k] + root, F.lit(0.0)), F.lit(0.0))) / steps
        before += area
        time = F.when(share * whole <= before, part) if time is None else time.when(share * whole <= before, part)
    return time.otherwise(F.lit(1.0))


@tidy
def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[float]] = SCHEDULES, cap: int = 3) -> DataFrame:
    """One row per document row: row_id, doc_id, size, source_size, target, copies, taken, positions.

    ``positions`` has the training position of each copy that is taken. Reruns agree.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    # with the text, as null and repeated ids must not fall into one bucket
    hashed = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))
    sized = stage(with_row_id(docs.select("doc_id", "text", "source")).select("row_id", "doc_id", key.alias("key"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), hashed.alias("hash")), "sized")
    sized = sized.withColumn("bucket", F.substring("hash", 1, DIGITS))
    targets = source_targets(sized, weights, cap)
    buckets = sized.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    offsets = buckets.withColumn("offset", F.sum("words").over(W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("words"))
    offsets = offsets.join(targets, "key").drop("words")  # at most 16^DIGITS rows a source
    within = W.partitionBy("key", "bucket").orderBy("hash", "doc_id", "size", "row_id").rowsBetween(W.unboundedPreceding, 0)
    laid = sized.withColumn("before", F.sum("size").over(within) - F.col("size")).join(offsets, ["key", "bucket"])
    middle = (F.col("offset") + F.col("before")) + F.col("size") / F.lit(2.0)
    copies = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.floor((F.col("target") - middle) / F.col("source_size")) + 1).otherwise(0)
    copies = F.least(F.greatest(copies, F.lit(0)), F.lit(cap)).cast("long")
    laid = laid.withColumn("middle", middle).withColumn("copies", copies)

    def position(copy: Column) -> Column:
        share = F.least((copy * F.col("source_size") + F.col("middle")) / F.col("target"), F.lit(1.0))
        by_class = F.when(F.col("class") == 0, invert_demand(share, schedules[0]))
        for c, knots in enumerate(schedules[1:], 1):
            by_class = by_class.when(F.col("class") == c, invert_demand(share, knots))
        return by_class

    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("copies") - 1, F.lit(0).cast("long"))), position)).otherwise(F.array().cast("array<double>"))
    return laid.select("row_id", "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), positions.alias("positions"))


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per taken copy, range-sorted by training position."""
    return mixed.select("row_id", "doc_id", "size", F.explode("positions").alias("position")).orderBy("position", "doc_id", "row_id")


def with_copies(mixed: DataFrame, cap: int = 3) -> DataFrame:
    """``mixed`` with position, position_2 and so on to ``cap`` in place of the array; null for copies that are not taken."""
    names = ["position", *[f"position_{i}" for i in range(2, cap + 1)]]
    return mixed.select("*", *[F.get("positions", F.lit(i)).alias(name) for i, name in enumerate(names)]).drop("positions")
