"""Shared helpers: staging in the shared folder, bounded Arrow batches, joins that survive hot keys."""

from __future__ import annotations

import contextvars
import functools
import tempfile
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key counts as hot when it holds at least 1/HOT_SHARE of all rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Rows per Arrow batch: long texts must not pile up in a Python worker.
BATCH_ROWS = 256


#: Removes shuffle files when the query that wrote them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_staged: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("staged", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is absent, a local session gets a temporary folder; any other master has to name one.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (conf.get("spark.master") or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="staged-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage, so a lost executor costs a re-read and not a recomputation, and freezes
    values such as generated ids. The shuffle files behind it have no more use and go at once.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # a DataFrame has the setting of its making
    finally:
        spark.conf.set(CLEANUP, before)
    if (own := _staged.get()) is not None:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: Sequence[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unstage(*staged: DataFrame) -> None:
    """Remove staged tables that have no reader left."""
    for df in staged:
        remove(df.sparkSession, sorted({path.rsplit("/", 1)[0] for path in df.inputFiles()}))


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator's result is staged; what else it staged on the way is removed, after errors as well."""

    @functools.wraps(operator)
    def run(df: DataFrame, *args, **options) -> DataFrame:
        outer = _staged.get()
        token = _staged.set(own := [])
        try:
            result = stage(operator(df, *args, **options), operator.__name__.strip("<>"))
            kept = own.pop()
        finally:
            _staged.reset(token)
            remove(df.sparkSession, own)
        if outer is not None:
            outer.append(kept)
        return result

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches short, unless they are shorter already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows; unlike ``doc_id`` the number never repeats.

    It holds only within what is staged from one scan: another scan can split the files in another way.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def text_key(text: str = "text") -> Column:
    """With ``doc_id``, names a row for a second scan."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def kept_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` (doc_id, text_key, kept; one row each) keeps.

    Only the keys of what goes are joined with the texts. Of repeated rows as many stay as are kept, one or all; if they differ in other columns,
    the one whose other columns come first as JSON.
    """
    per_key = decisions.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.count_if("kept").alias("k"))
    less = stage(per_key.where("k < n").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), (F.col("k") > 0).alias("__one")), "less")
    rows = docs.withColumn("__text_key", text_key())
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key"))
    out = rows.join(less, same, "left_anti").select(*docs.columns)
    one = less.where("__one")
    if not one.isEmpty():
        others = F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))
        repeated = rows.join(one, same, "left_semi").groupBy("doc_id", "__text_key").agg(F.min_by(F.struct(*docs.columns), others).alias("__row"))
        out = out.unionByName(repeated.select("__row.*"))
    return out


def bitmap_of(hashes: DataFrame, bits: int) -> bytes:
    """A bitmap of ``bits`` bits with those of column ``hash``; its size bounds what reaches the driver."""
    slot = F.pmod("hash", F.lit(bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 32).cast("int"))
    words = hashes.groupBy((slot / 32).cast("long").alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(bits // 32, dtype=np.uint32)
    out[words["at"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out.tobytes()


def in_bitmap(bitmap: bytes, hashes: np.ndarray) -> np.ndarray:
    marks = np.frombuffer(bitmap, dtype=np.uint32)
    slot = hashes.view(np.int64) % (len(marks) * 32)
    return (marks[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1


_ARROW = {"bigint": pa.int64(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string())}


def arrow_batch(rows: Sequence[Sequence], ddl: str) -> pa.RecordBatch:
    """Rows as an Arrow batch; ``ddl`` is the ``name type, ...`` that mapInArrow gets."""
    fields = [x.split() for x in ddl.split(", ")]
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in fields])
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def hot_from(total: int) -> int:
    """The number of rows from which on a key of ``total`` rows is hot: there are at most HOT_SHARE such keys."""
    return max(total // HOT_SHARE, 1000)


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Join where a key may hold a third of the left rows.

    ``right`` has one row per key and, in ``count``, its number of left rows out of ``total``. Keys with
    at least ``total / HOT_SHARE`` of them number at most HOT_SHARE: those rows are broadcast. All other keys are
    small and meet in a shuffle. Both inputs should be staged, as they are read twice.
    """
    limit = hot_from(total)
    hot = F.broadcast(right.where(F.col(count) >= limit).drop(count).withColumn("_hot", F.lit(True)))
    cold = right.where(F.col(count) < limit).drop(count)
    marked = left.join(hot, keys, "left")
    by_broadcast = marked.where(F.col("_hot")).drop("_hot")
    by_shuffle = marked.where(F.col("_hot").isNull()).select(*left.columns).join(cold, keys, how)
    return by_broadcast.unionByName(by_shuffle)


def salted_join(left: DataFrame, right: DataFrame, key: str, count: str, total: int, spread: Column) -> DataFrame:
    """Left join that scans ``left`` once, for wide left rows.

    The at most HOT_SHARE keys that hold ``total / HOT_SHARE`` left rows or more are cut into parts of about that size by the
    hash of ``spread``; their right rows, one a key, are repeated for each part.
    """
    limit = hot_from(total)
    parts = F.ceil(F.col(count) / limit).cast("int")
    hot = F.broadcast(right.where(F.col(count) >= limit).select(key, parts.alias("_parts")))
    marked = left.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.when(F.col(count) >= limit, parts).otherwise(1) - 1))).drop(count)
    return marked.join(copies, [key, "_part"], "left").drop("_part")


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """Inner join of two staged tables that can both repeat a key.

    The at most HOT_SHARE keys that hold ``hot_from`` left rows or more are cut into parts of about that size by the hash of ``spread``, and
    their right rows are repeated for each part; so no task has a hot key's rows times its partners.
    """
    uses = stage(left.groupBy(*keys).agg(F.count("*").alias("_uses")).join(right.select(*keys).distinct(), keys), "uses")
    limit = hot_from(uses.agg(F.sum("_uses")).first()[0] or 0)
    parts = F.when(F.col("_uses") >= limit, F.ceil(F.col("_uses") / limit)).otherwise(1).cast("int").alias("_parts")
    hot = F.broadcast(uses.where(F.col("_uses") >= limit).select(*keys, parts))
    dealt = left.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = right.join(uses.select(*keys, parts), keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.join(copies, [*keys, "_part"]).drop("_part")


def fold(column: str, parts: int) -> Column:
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % parts


def labelled_sample(labels: DataFrame, label: str, parts: int, left_out: int, rows: int) -> DataFrame:
    """(doc_id, label) of at most ``rows`` labelled rows outside the fold that is left out, by hash of the id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id", parts) != left_out))
    return usable.select("doc_id", F.col(label).cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)
