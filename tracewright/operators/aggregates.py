"""Inventories, histograms, ladders and checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_distinct(column: str | Column, separator: str = ",") -> Column:
    """Distinct values without nulls, sorted, joined to a string."""
    c = F.col(column) if isinstance(column, str) else column
    return F.array_join(F.array_sort(F.collect_set(c)), separator)


def status_histogram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(dimension, status, n) for several status columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("status")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.dimension", "p.status").agg(F.count("*").alias("n"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def conditional_pivot(df: DataFrame, keys: Sequence[str], name: str, values: Mapping[str, str], measure: Column, how=F.max) -> DataFrame:
    """One column per name: the aggregate of ``measure`` over the rows of that name."""
    return df.groupBy(*keys).agg(*[how(F.when(F.col(name) == v, measure)).alias(alias) for v, alias in values.items()])


def coverage(df: DataFrame, keys: Sequence[str], status: str, good: str, open_states: Sequence[str]) -> DataFrame:
    """Counts per status group, their ratio, and a ladder: nothing to cover, complete, partial."""
    n, ok = F.count("*"), F.count_if(F.col(status) == good)
    left = F.count_if(F.col(status).isin(*open_states))
    out = df.groupBy(*keys).agg(n.alias("total"), ok.alias("covered"), left.alias("open"))
    ladder = F.when(F.col("total") == 0, "not_applicable").when((F.col("covered") == F.col("total")) & (F.col("open") == 0), "complete").otherwise("partial")
    return out.withColumn("ratio", F.round(F.col("covered") / F.col("total"), 6)).withColumn("coverage_status", ladder)


def roll_up(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Island coverage from its members: any partial, else any complete, else not applicable."""
    has = lambda s: F.bool_or(F.col("coverage_status") == s)
    return df.groupBy(*keys).agg(F.when(has("partial"), "partial").when(has("complete"), "complete").otherwise("not_applicable").alias("coverage_status"), F.count("*").alias("members"))


def gap_summary(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("gap_kind").agg(F.count("*").alias("n"), F.count_distinct("subject_id").alias("subjects"))


def quality_gate(gold: DataFrame, actual: DataFrame, keys: Sequence[str], group: str) -> DataFrame:
    """Precision, recall and F1 of distinct keys per group, by a full outer join; rounded to 6 digits."""
    sides = gold.select(*keys).distinct().withColumn("_gold", F.lit(1)), actual.select(*keys).distinct().withColumn("_actual", F.lit(1))
    both = sides[0].join(sides[1], list(keys), "full")
    out = both.groupBy(group).agg(
        F.count_if(F.col("_gold").isNotNull() & F.col("_actual").isNotNull()).alias("tp"),
        F.count_if(F.col("_gold").isNull()).alias("fp"),
        F.count_if(F.col("_actual").isNull()).alias("fn"),
    )
    ratio = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))
