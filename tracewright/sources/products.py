"""Facts as JSON lines and products as Parquet folders that appear whole or not at all."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_facts(spark: SparkSession, path: str, schema: T.StructType | str, declared: int | None = None) -> DataFrame:
    """JSON lines under an explicit schema; a declared count must hold."""
    df = spark.read.schema(schema).json(path)
    if declared is not None and (n := df.count()) != declared:
        raise ValueError(f"{path}: {n} facts, {declared} declared")
    return df


def canonical_lines(df: DataFrame, key: str) -> DataFrame:
    """(key, line): each row as JSON with sorted names, nulls left out."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*sorted(df.columns))).alias("line"))


def content_digest(df: DataFrame, key: str) -> str:
    """SHA-256 of the content whatever its order or partitioning: digests of lines are summed in two 128-bit halves, so no order is needed."""
    line = F.sha2(F.col("line"), 256)
    halves = [F.sum(F.conv(F.substring(line, i, 15), 16, 10).cast("decimal(38,0)")) for i in (1, 16, 31, 46)]
    row = canonical_lines(df, key).agg(F.count("*"), *halves).first()
    import hashlib

    return hashlib.sha256("\x1f".join(str(x) for x in row).encode()).hexdigest()


def write_facts(df: DataFrame, path: str, key: str) -> str:
    """Sorted JSON lines (range-partitioned, so parts follow each other); returns the content digest."""
    canonical_lines(df, key).orderBy("key", "line").select(F.col("line").alias("value")).write.text(path)
    return content_digest(df, key)


def check_product(relations: Mapping[str, DataFrame], ids: Mapping[str, str], references: Sequence[tuple[str, str, str, str]] = (), declared: Mapping[str, int] | None = None) -> list[str]:
    """What is wrong: counts that differ from those declared, ids that repeat, and (child, column, parent, column) references that lead nowhere."""
    wrong = []
    for name, n in (declared or {}).items():
        if (found := relations[name].count()) != n:
            wrong.append(f"{name}: {found} rows, {n} declared")
    for name, key in ids.items():
        if not relations[name].groupBy(key).count().where("count > 1").isEmpty():
            wrong.append(f"{name}.{key}: duplicate ids")
    for child, column, parent, key in references:
        left = relations[child].where(F.col(column).isNotNull()).select(F.col(column).alias("k"))
        if not left.join(relations[parent].select(F.col(key).alias("k")), "k", "left_anti").isEmpty():
            wrong.append(f"{child}.{column}: orphans")
    return wrong


def publish(spark: SparkSession, relations: Mapping[str, DataFrame], path: str, **checks) -> None:
    """Write all relations beside ``path``, check what was written, then rename; a failed check leaves nothing."""
    jvm = spark._jvm
    target, staging = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".staging")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    fs.delete(staging, True)
    try:
        for name, df in relations.items():
            df.write.parquet(f"{path}.staging/{name}")
        written = {name: spark.read.schema(df.schema).parquet(f"{path}.staging/{name}") for name, df in relations.items()}
        if wrong := check_product(written, **checks):
            raise ValueError("; ".join(wrong))
        if not fs.rename(staging, target):
            raise OSError(f"rename to {path} failed")
    finally:
        fs.delete(staging, True)
