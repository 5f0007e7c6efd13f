"""Top-k per group, ranking with visible ties, latest versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """At most ``k`` rows per group with ``rank``, the group's full count and whether rows were left out.

    The count comes from a separate aggregate, so that the rank filter can prune inside the window (and map-side before the shuffle).
    """
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    total = df.groupBy(*keys).agg(F.count("*").alias("group_count"))
    return ranked.join(total, list(keys)).withColumn("truncated", F.col("group_count") > k)


def best_or_tie(df: DataFrame, keys: Sequence[str], score: Sequence[str], item: str) -> DataFrame:
    """One row per group: the best item if it is alone at the top, else null with status ``ambiguous``. A null item is one too. One shuffle, by the keys."""
    at_top = df.withColumn("_r", F.rank().over(W.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in score]))).where("_r = 1")
    ties = F.count_distinct(item) + F.max(F.col(item).isNull().cast("int"))
    out = at_top.groupBy(*keys).agg(ties.alias("ties"), F.min(item).alias("_first"))
    return out.select(*keys, "ties", F.when(F.col("ties") == 1, F.col("_first")).alias(item), F.when(F.col("ties") == 1, "matched").otherwise("ambiguous").alias("status"))


def recommend(df: DataFrame, keys: Sequence[str], score: Sequence[str], item: str) -> DataFrame:
    """The one place where ties are broken, by the smallest name, with a status that says so."""
    per_item = df.groupBy(*keys, item).agg(F.max(F.struct(*score)).alias("_best"))
    group = W.partitionBy(*keys)
    ranked = per_item.withColumn("candidates", F.count("*").over(group)).withColumn("_r", F.rank().over(group.orderBy(F.desc("_best"))))
    at_top = ranked.where("_r = 1").groupBy(*keys, "candidates").agg(F.count("*").alias("ties"), F.min(item).alias("recommended"))
    status = F.when(F.col("candidates") == 1, "confirmed_unique").when(F.col("ties") == 1, "probable_ranked").otherwise("probable_tie_break")
    return at_top.select(*keys, "candidates", "recommended", status.alias("status"))


def latest(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Values of the row of the greatest ``order`` per group; one aggregate, no sort."""
    return df.groupBy(*keys).agg(F.max(F.struct(order, *values)).alias("_l")).select(*keys, f"_l.{order}", *[f"_l.{v}" for v in values])
