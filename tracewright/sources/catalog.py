"""Relations of a product by name, and revisions of a system's products."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.ids import stable_id
from tracewright.operators.delta import unreachable


class Catalog:
    """Relations under declared schemas; one that isn't there is empty, not an error."""

    def __init__(self, spark: SparkSession, schemas: Mapping[str, T.StructType | str], relations: Mapping[str, DataFrame]):
        self.spark = spark
        self.schemas = {k: v if isinstance(v, T.StructType) else T.StructType.fromDDL(v) for k, v in schemas.items()}
        self.relations = dict(relations)

    def has(self, name: str) -> bool:
        return name in self.relations

    def capabilities(self) -> dict[str, str]:
        return {name: "available" if self.has(name) else "not_available" for name in sorted(self.schemas)}

    def relation(self, name: str) -> DataFrame:
        """The relation with its declared columns; those that a product lacks are null."""
        schema = self.schemas[name]
        if not self.has(name):
            return self.spark.createDataFrame([], schema)
        df = self.relations[name]
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def union(self, *others: Catalog) -> Catalog:
        """Products of several repositories as one; ids must stay unique, see ``sources.products.check_product``."""
        names = {n for c in (self, *others) for n in c.relations}
        merged = {}
        for n in names:
            parts = [c.relation(n) for c in (self, *others) if c.has(n)]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            merged[n] = out
        return Catalog(self.spark, self.schemas, merged)


REVISION = "system_id string, ordinal long, revision_id string, slot string, digest string, active boolean"


def publish_revision(revisions: DataFrame, system_id: str, products: Mapping[str, str]) -> DataFrame:
    """``revisions`` with one more, active revision of the system; slots that it doesn't replace are inherited from the active one."""
    spark = revisions.sparkSession
    own = spark.createDataFrame(sorted(products.items()), "slot string, digest string")
    base = revisions.where((F.col("system_id") == system_id) & F.col("active")).select("slot", "digest")
    slots = own.unionByName(base.join(own.select("slot"), "slot", "left_anti"))
    last = revisions.where(F.col("system_id") == system_id).agg(F.max("ordinal")).first()[0] or 0
    new = slots.select(F.lit(system_id).alias("system_id"), F.lit(last + 1).cast("long").alias("ordinal"), stable_id("revision", F.lit(system_id), F.lit(last + 1)).alias("revision_id"), "slot", "digest", F.lit(True).alias("active"))
    return activate(revisions, system_id, None).unionByName(new)


def activate(revisions: DataFrame, system_id: str, ordinal: int | None) -> DataFrame:
    """Make one revision of the system the active one; None for no revision."""
    on = F.lit(False) if ordinal is None else F.col("ordinal") == ordinal
    return revisions.withColumn("active", F.when(F.col("system_id") == system_id, on).otherwise(F.col("active")))


def garbage(blobs: DataFrame, revisions: DataFrame) -> DataFrame:
    """Blobs that no revision refers to."""
    return unreachable(blobs, revisions, "digest")


def reuse(wanted: DataFrame, produced: DataFrame) -> DataFrame:
    """wanted (node, input_print) with what was produced from the same inputs: reuse or build."""
    known = produced.groupBy("node", "input_print").agg(F.max("digest").alias("digest"))
    return wanted.join(known, ["node", "input_print"], "left").withColumn("decision", F.when(F.col("digest").isNotNull(), "reuse").otherwise("build"))
