"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

Every whole text is normalised (each run of ASCII white space becomes one space) and cut at places that its
content defines. A dictionary of the distinct chunks gives each a verified identifier: chunks share one only if
SHA-256, length and a second, independent 64-bit hash agree. A document becomes its recipe, the ordered list
of identifiers, and documents are equal when their recipes are. After the one scan that cuts them, texts move no
more; only digests and identifiers do.

Null texts count as empty; empty texts are equal to each other and have an empty recipe. Of equal texts the
smallest ``doc_id`` stays, null ids last; of repeated rows with one id exactly one stays. Other columns are not
read, so clashing names do no harm. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, kept_rows, stage, text_key, tidy, with_row_id

#: Where a chunk may end: behind a sentence or clause mark, a space and a letter of one class.
BOUNDARY = r"(?<=[.,;:!?] [a-hA-H])"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def chunks_of(text: Column, least: int, most: int) -> Column:
    pattern = rf"(?s).{{{least},{most - 1}}}?{BOUNDARY}|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


@tidy
def exact_groups(docs: DataFrame, least: int = 512, most: int = 8192) -> DataFrame:
    """One row per document row: row_id, doc_id, keep_id, group_size, kept, text_sha256, n_chunks, text_key."""
    text = with_row_id(docs.select("doc_id", "text", text_key().alias("text_key"))).withColumn("text", normalised(F.col("text")))
    cut = text.select(
        "row_id",
        "doc_id",
        "text_key",
        F.sha2("text", 256).alias("text_sha256"),
        F.transform(
            chunks_of(F.col("text"), least, most),
            lambda c: F.struct(F.unhex(F.sha2(c, 256)).alias("digest"), F.length(c).alias("length"), F.xxhash64(c).alias("check")),
        ).alias("chunks"),
    )
    cut = stage(cut, "chunks")
    key = ["digest", "length", "check"]
    used = cut.select("row_id", F.posexplode("chunks").alias("at", "chunk")).select("row_id", "at", "chunk.*")
    # an identifier is fixed when the dictionary is written
    chunks = stage(used.groupBy(*key).agg(F.count("*").alias("uses")).withColumn("chunk_id", F.monotonically_increasing_id()), "dictionary")
    total = chunks.agg(F.sum("uses")).first()[0] or 0
    recipes = (
        hot_join(used, chunks, key, "uses", total)
        .groupBy("row_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "chunk_id"))), lambda c: c["chunk_id"]).alias("recipe"))
    )
    # recipes are compared whole; the row's own digest stands for documents without chunks
    recipes = stage(
        cut.select("row_id", "doc_id", "text_key", "text_sha256", F.size("chunks").alias("n_chunks"))
        .join(recipes, "row_id", "left")
        .withColumn("recipe", F.coalesce("recipe", F.array().cast("array<bigint>"))),
        "recipes",
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("first")
    groups = stage(recipes.groupBy("recipe").agg(F.count("*").alias("group_size"), first).withColumn("size", F.col("group_size")), "groups")
    total = recipes.count()
    placed = hot_join(recipes, groups, ["recipe"], "size", total)
    return placed.select(
        "row_id",
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("first.row_id")).alias("kept"),
        "text_sha256",
        "n_chunks",
        "text_key",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without all but the first of equal texts."""
    return kept_rows(docs, exact_groups(docs))
