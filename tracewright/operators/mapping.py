"""Mappings between logical and physical models, each with its gaps."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.ids import normalize_db_identifier, stable_id
from tracewright.operators.joins import unique_or_ambiguous
from tracewright.operators.rules import join_readiness

NOT_MAPPED = ("mapped_superclass", "embeddable", "transient")


def map_entities(entities: DataFrame, tables: DataFrame) -> DataFrame:
    """entities (entity_id, kind, table_name) to tables (table_id, name). Without an explicit name there is a gap: no default naming."""
    named = entities.withColumn("k", normalize_db_identifier(F.col("table_name")))
    keyed = tables.select("table_id", normalize_db_identifier(F.col("name")).alias("k"))
    found = unique_or_ambiguous(named, keyed, "k", "table_id")
    status = F.when(F.col("kind").isin(*NOT_MAPPED), "not_applicable").otherwise(F.col("status"))
    gap = F.when(status == "ambiguous", "ambiguous_table").when((status == "unresolved") & F.col("table_name").isNull(), "explicit_name_missing").when(status == "unresolved", "table_not_found")
    return found.select("entity_id", "kind", "table_name", "candidate_count", status.alias("status"), F.when(status == "matched", F.col("selected_id")).alias("table_id"), gap.alias("gap_kind"))


def map_fields(fields: DataFrame, mapped: DataFrame, columns: DataFrame) -> DataFrame:
    """fields (field_id, entity_id, column_name) to columns (column_id, table_id, name) of the table of a matched owner."""
    owned = fields.join(mapped.select("entity_id", "table_id", F.col("status").alias("owner_status")), "entity_id", "left").withColumn("k", F.lower("column_name"))
    found = unique_or_ambiguous(owned, columns.select("column_id", "table_id", F.lower("name").alias("k")), ["table_id", "k"], "column_id")
    open_owner = F.coalesce(F.col("owner_status") != "matched", F.lit(True))
    status = F.when(F.col("owner_status") == "not_applicable", "not_applicable").when(open_owner, "unresolved").otherwise(F.col("status"))
    gap = F.when(status == "not_applicable", F.lit(None)).when(open_owner, "owner_not_matched").when(status == "ambiguous", "ambiguous_column").when(status == "unresolved", "column_not_found")
    return found.select("field_id", "entity_id", status.alias("status"), F.when(status == "matched", F.col("selected_id")).alias("column_id"), gap.alias("gap_kind"))


def mapping_gaps(mapped: DataFrame, subject: str) -> DataFrame:
    return mapped.where("gap_kind is not null").select(stable_id("gap", F.col(subject), F.col("gap_kind")).alias("gap_id"), F.col(subject).alias("subject_id"), "gap_kind")


def unmapped(tables: DataFrame, mapped: DataFrame) -> DataFrame:
    """Tables that no matched mapping refers to."""
    used = mapped.where("status = 'matched'").select("table_id").distinct()
    return tables.join(used, "table_id", "left_anti").select(stable_id("unmapped", F.col("table_id")).alias("unmapped_id"), "table_id")


def effective_model(entities: DataFrame, mapped: DataFrame, fields: DataFrame, mapped_fields: DataFrame) -> DataFrame:
    """Logical entities and fields beside what they are stored in; every field once, mapped or not."""
    e = entities.join(mapped.select("entity_id", "table_id", F.col("status").alias("entity_status")), "entity_id", "left")
    f = fields.join(mapped_fields.select("field_id", "column_id", F.col("status").alias("field_status")), "field_id", "left")
    return e.select("entity_id", "table_id", "entity_status").join(f, "entity_id", "left")


def signature(tree: object) -> str:
    """Canonical form of a key expression: fields become numbered holes in order of appearance, operands of commutative operators are sorted."""
    holes: dict[str, int] = {}

    def plain(x):
        if isinstance(x, dict) and "field" in x:
            return {"hole": holes.setdefault(str(x["field"]), len(holes))}
        if isinstance(x, dict):
            body = {k: plain(v) for k, v in x.items() if k != "args"}
            args = [plain(v) for v in x.get("args", ())]
            if x.get("op") in ("+", "*", "and", "or", "="):
                args.sort(key=lambda v: json.dumps(v, sort_keys=True))
            return body | ({"args": args} if "args" in x else {})
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(tree), sort_keys=True, separators=(",", ":"))


def with_signature(expressions: DataFrame, tree: str = "tree") -> DataFrame:
    """``signature`` of a JSON expression tree; null for null and for what isn't JSON."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            try:
                out.append(None if text is None else signature(json.loads(text)))
            except ValueError:
                out.append(None)
        return pa.array(out, pa.string())

    return expressions.withColumn("signature", F.arrow_udf(run, T.StringType())(F.col(tree)))


def storage_joins(references: DataFrame, keys: DataFrame) -> DataFrame:
    """references (reference_id, tree, single) against keys (key_id, tree) by structural signature: status and readiness of each reference."""
    left = with_signature(references)
    right = with_signature(keys).where("signature is not null").groupBy("signature").agg(F.count_distinct("key_id").alias("n_keys"), F.min("key_id").alias("sole"))
    joined = left.join(right, "signature", "left")
    n = F.coalesce("n_keys", F.lit(0).cast("long"))
    r = join_readiness(n, F.lit(0), F.lit(0), F.col("single"), F.lit(0))
    return joined.select("reference_id", n.alias("candidate_count"), r.alias("r"), F.when(n == 1, F.col("sole")).alias("key_id")).select("reference_id", "candidate_count", "r.*", "key_id")
