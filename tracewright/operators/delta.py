"""Differences between snapshots and what follows from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.ids import fingerprint, stable_id


def keyed_delta(before: DataFrame, after: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """added, removed and changed keys with fingerprints of both sides; one full outer join on the key."""
    a, b = (df.select(key, fingerprint(*[F.col(v) for v in values]).alias(f"{side}_print")) for df, side in ((before, "before"), (after, "after")))
    kind = F.when(F.col("before_print").isNull(), "added").when(F.col("after_print").isNull(), "removed").otherwise("changed")
    both = a.join(b, key, "full").where(~F.col("before_print").eqNullSafe(F.col("after_print")))
    return both.select(stable_id("delta", F.col(key), kind).alias("delta_id"), key, kind.alias("delta_kind"), "before_print", "after_print")


def status_delta(before: DataFrame, after: DataFrame, key: str, status: str) -> DataFrame:
    """Keys whose status differs; what one side lacks counts as ``absent``."""
    a, b = before.select(key, F.col(status).alias("before_status")), after.select(key, F.col(status).alias("after_status"))
    both = a.join(b, key, "full").select(key, F.coalesce("before_status", F.lit("absent")).alias("before_status"), F.coalesce("after_status", F.lit("absent")).alias("after_status"))
    return both.where("before_status <> after_status")


def inherit(base: DataFrame, override: DataFrame, slot: str) -> DataFrame:
    """Products of a base revision with the slots that ``override`` has replaced."""
    return override.withColumn("origin", F.lit("own")).unionByName(base.join(override.select(slot), slot, "left_anti").withColumn("origin", F.lit("inherited")))


def unreachable(blobs: DataFrame, references: DataFrame, digest: str) -> DataFrame:
    """What garbage collection may delete."""
    return blobs.join(references.select(digest).distinct(), digest, "left_anti")
