"""The corpus pipeline: quality, exact dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and its result is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``documents``; the last returns, for each document that
remains, its size, its source's size and target, the words taken, and the training positions of its copies.

The stages read doc_id, text and, for mixing, source; nulls, empty and very long texts, ties, repeated rows, empty tables and further columns are
treated as their operators say: poor texts go by score, of equal and near-equal texts one row stays, and rows without text are equal to each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from tracewright.llm.common import table, tidy, unstage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_poor(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.with_copies(mixing.mix(docs))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position", "position_2", "position_3").orderBy("position", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_exact_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing to target weights", mix),
]

#: SQL cannot fit the classifier; tests hold run() against brute force of its stages on small tables.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, function in STAGES:
        # the stage's own staged tables, and then the result before it, have no reader left
        docs = tidy(lambda rows, apply=function: apply(spark, rows, sf_dir))(docs)
        if before is not None:
            unstage(before)
        before = docs
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
