"""Declared models, what they are stored as, and the products and reports that are made of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewright.functions.ids import cardinality_hint, normalize_db_identifier, stable_id
from tracewright.operators.graph import closure, inherited_members, simple_paths


def element_type(declared_type: Column) -> Column:
    """The type inside a collection or an array; the last argument of a map."""
    inner = F.regexp_replace(F.regexp_extract(declared_type, r"<(?:[^<>]*,\s*)?([\w.]+)\s*>+$", 1), r"\s", "")
    return F.when(inner != "", inner).otherwise(F.regexp_replace(declared_type, r"\[\]$", ""))


def declared_model(types: DataFrame, fields: DataFrame) -> dict[str, DataFrame]:
    """Products of types (type_id, parent_id) and fields (type_id, member, declared_type): effective fields, associations between known types, descendants, and gaps.

    A cycle of parents is a gap and gives no inherited fields beyond itself.
    """
    effective, gaps = inherited_members(types, fields.select("type_id", "member"))
    declared = fields.select(F.col("type_id").alias("declared_in"), "member", "declared_type").groupBy("declared_in", "member").agg(F.min("declared_type").alias("declared_type"))
    effective = effective.join(declared, ["declared_in", "member"])
    known = types.select(F.col("type_id").cast("string").alias("target_type")).distinct()
    associations = effective.withColumn("target_type", element_type(F.col("declared_type"))).join(known, "target_type").withColumn("cardinality", cardinality_hint(F.col("declared_type")))
    up = closure(types.where("parent_id is not null"), "type_id", "parent_id")
    cycles = up.where("start = node").select(F.col("start").alias("type_id"), F.lit(None).cast("string").alias("member"), F.lit("inheritance_cycle").alias("gap_kind"))
    descendants = up.where("start <> node").groupBy(F.col("node").alias("type_id")).agg(F.count("*").alias("n_descendants"), F.max("depth").alias("depth"))
    return {"fields": effective, "associations": associations, "descendants": descendants, "gaps": gaps.select("type_id", "member", "gap_kind").unionByName(cycles)}


def type_paths(associations: DataFrame, start: DataFrame, max_depth: int, max_branching: int | None = None) -> DataFrame:
    """Walks over associations (type_id, target_type) from each start, to all ends, with the reason why they stop."""
    none = start.where(F.lit(False))
    return simple_paths(associations, "type_id", "target_type", start, none, max_depth, max_branching).select("path", "hops", "stop_reason")


def typed_records(records: DataFrame, required: Mapping[str, Sequence[str]]) -> DataFrame:
    """Records (record_id, record_kind, payload) with status: loaded, unknown_kind, or missing_<first key that the payload lacks>."""
    status = F.lit("unknown_kind")
    for kind, keys in required.items():
        missing = F.lit("loaded")
        for key in reversed(keys):
            missing = F.when(F.get_json_object("payload", f"$.{key}").isNull(), f"missing_{key}").otherwise(missing)
        status = F.when(F.col("record_kind") == kind, missing).otherwise(status)
    return records.select("record_id", "record_kind", status.alias("status"))


def correspondences(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """All pairs of left and right objects whose names have one normal form, each with the number of candidates of its left side."""
    a = left.select(F.col(left_name).alias("left_name"), normalize_db_identifier(F.col(left_name)).alias("k")).distinct()
    b = right.select(F.col(right_name).alias("right_name"), normalize_db_identifier(F.col(right_name)).alias("k")).distinct()
    counts = b.groupBy("k").agg(F.count("*").alias("candidate_count"))
    return a.join(counts, "k").join(b, "k").select("left_name", "right_name", "candidate_count", F.when(F.col("candidate_count") == 1, "matched").otherwise("ambiguous").alias("status"))


USEFULNESS = ("confirmed", "strongly_supported", "probable", "ambiguity", "unresolved")


def extension_context(joins: DataFrame, anchor: str) -> DataFrame:
    """Per anchor what its extension joins (method, usefulness) are worth: counts by class, the best class, and the methods in it."""
    rank = F.array_position(F.array(*[F.lit(u) for u in USEFULNESS]), F.col("usefulness"))
    ranked = joins.withColumn("_r", rank)
    best = ranked.groupBy(anchor).agg(F.min("_r").alias("_b"), F.count("*").alias("n_joins"), *[F.count_if(F.col("usefulness") == u).alias(u) for u in USEFULNESS])
    methods = ranked.join(best.select(anchor, "_b"), anchor).where(F.col("_r") == F.col("_b")).groupBy(anchor).agg(F.array_join(F.array_sort(F.collect_set("method")), ",").alias("best_methods"))
    return best.join(methods, anchor).select(anchor, "n_joins", *USEFULNESS, F.element_at(F.array(*[F.lit(u) for u in USEFULNESS]), F.col("_b").cast("int")).alias("best"), "best_methods")


def inventory(files: DataFrame) -> DataFrame:
    """Files (path, suffix, size) by suffix and top folder: numbers and bytes."""
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", r"^([^/]+)/", 1)).otherwise(".")
    return files.groupBy("suffix", folder.alias("folder")).agg(F.count("*").alias("n_files"), F.sum("size").alias("bytes"))


def analysis_coverage(facts: Mapping[str, DataFrame], gaps: DataFrame, limitations: Mapping[str, str]) -> DataFrame:
    """One row per kind of fact (its number) and per kind of gap (its number and the limitation that it stands for)."""
    out = None
    for name, df in facts.items():
        part = df.agg(F.count("*").alias("n")).select(F.lit("fact").alias("entry"), F.lit(name).alias("kind"), "n", F.lit(None).cast("string").alias("limitation"))
        out = part if out is None else out.unionByName(part)
    known = F.create_map(*[F.lit(x) for pair in limitations.items() for x in pair])
    found = gaps.groupBy("gap_kind").agg(F.count("*").alias("n"))
    return out.unionByName(found.select(F.lit("gap").alias("entry"), F.col("gap_kind").alias("kind"), "n", F.coalesce(F.element_at(known, F.col("gap_kind")), F.lit("unclassified")).alias("limitation")))


def unmatched_interactions(calls: DataFrame, matched: DataFrame) -> DataFrame:
    """Calls without a match, by repository, with the share of its calls."""
    done = matched.where("status = 'matched'").select("interface_id").distinct()
    left = calls.join(done, "interface_id", "left_anti").groupBy("repo_id").agg(F.count("*").alias("n_unmatched"))
    return calls.groupBy("repo_id").agg(F.count("*").alias("n_calls")).join(left, "repo_id").withColumn("share", F.round(F.col("n_unmatched") / F.col("n_calls"), 6))


def status_report(rows: DataFrame, section: str, status: str) -> DataFrame:
    """Numbers of each status per section, with the section's whole and an identifier for the line."""
    per = rows.groupBy(section, status).agg(F.count("*").alias("n"))
    return per.withColumn("whole", F.sum("n").over(W.partitionBy(section))).withColumn("line_id", stable_id("line", F.col(section), F.col(status)))


def source_inventory(relations: DataFrame, roles: DataFrame) -> DataFrame:
    """Relations of business interest by role: how many read them, in how many files; what is hidden by default is left out."""
    from tracewright.operators.rules import business_view

    uses = relations.groupBy("relation_name").agg(F.count("*").alias("n_reads"), F.count_distinct("file").alias("n_files"))
    return business_view(roles).join(uses, "relation_name", "left").fillna(0, ["n_reads", "n_files"]).select("relation_name", "role", "confidence", "n_reads", "n_files")


def insertion_context(recursive: DataFrame, joins: DataFrame, statements: DataFrame) -> DataFrame:
    """What a new attribute of a target has to fit: its statements, columns, sources and the joins that its statements make."""
    per_target = recursive.groupBy("target").agg(
        F.count_distinct("statement_id").alias("n_statements"), F.count_distinct("target_column").alias("n_columns"), F.array_join(F.array_sort(F.collect_set("source_relation")), ",").alias("sources")
    )
    of = joins.where("status = 'confirmed'").join(statements.where("target is not null").select("statement_id", "target"), "statement_id")
    pairs = of.groupBy("target").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("=", "left_column", "right_column"))), ",").alias("joins"))
    return per_target.join(pairs, "target", "left").select("target", "n_statements", "n_columns", "sources", F.coalesce("joins", F.lit("")).alias("joins"))
