"""Value-flow graphs: nodes, edges, derivations and attribute paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.ids import stable_id
from tracewright.operators.graph import simple_paths
from tracewright.operators.rules import value_preservation


def transformation(expression: Column) -> Column:
    """What an expression does to its value; the first rule that holds wins."""
    e = F.lower(F.coalesce(expression, F.lit("")))
    return (
        F.when(e.rlike(r"(sha\d*|md5|hash|hmac|encrypt)\w*\s*\("), "hashed")
        .when(e.rlike(r"(trim|lower|upper|strip|normalize)\w*\s*\("), "normalized")
        .when(e.rlike(r"(format|tostring|valueof|cast|parse)\w*\s*\("), "formatted")
        .when(e.rlike(r"(concat\w*|join|plus)\s*\(|\+|\|\|"), "combined")
        .when(e.rlike(r"(substring|split|extract|get)\w*\s*\("), "extracted")
        .when(e.rlike(r"^\s*[\w.$]*\s*$"), "identity")
        .otherwise("derived")
    )


def edges(flows: DataFrame) -> DataFrame:
    """Edges with stable ids, transformation and preservation from flows (source_id, target_id, flow_kind, expression, confidence)."""
    t = flows.withColumn("transformation_kind", transformation(F.col("expression")))
    ident = stable_id("flow", F.col("source_id"), F.col("target_id"), F.col("flow_kind"))
    return t.select(ident.alias("edge_id"), "source_id", "target_id", "flow_kind", "transformation_kind", value_preservation(F.col("transformation_kind")).alias("value_preservation"), "confidence")


def derivations(flow_edges: DataFrame) -> DataFrame:
    """Targets with the sources they derive from: direct for one, combined for more."""
    per = flow_edges.groupBy("target_id").agg(F.count_distinct("source_id").alias("source_count"), F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("sources"))
    return per.select(stable_id("derivation", F.col("target_id"), F.col("sources")).alias("derivation_id"), "target_id", "source_count", F.when(F.col("source_count") == 1, "direct").otherwise("combined").alias("derivation_kind"))


def transport_edges(contracts: DataFrame, source_nodes: DataFrame, target_nodes: DataFrame) -> DataFrame:
    """Edges between repositories: nodes of both ends of a matched field contract (interaction_id, normal_path)."""
    a = source_nodes.select("interaction_id", "normal_path", F.col("node_id").alias("source_id"))
    b = target_nodes.select("interaction_id", "normal_path", F.col("node_id").alias("target_id"))
    matched = contracts.where("status = 'matched'").select("interaction_id", "normal_path")
    both = matched.join(a, ["interaction_id", "normal_path"]).join(b, ["interaction_id", "normal_path"])
    return both.select("source_id", "target_id", F.lit("transport").alias("flow_kind"), F.lit("confirmed").alias("confidence")).distinct()


def resolve_endpoint(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (ref) as node ids: by id, else by a unique display or owner name; several hits are ambiguous."""
    named = nodes.select("node_id", F.explode(F.array_distinct(F.array("node_id", "display_ref", "owner_ref"))).alias("ref"), (F.lit(1)).alias("one"))
    exact = nodes.select(F.col("node_id").alias("ref"), F.col("node_id").alias("exact_id"))
    per = named.where("ref is not null").groupBy("ref").agg(F.count_distinct("node_id").alias("n"), F.min("node_id").alias("sole"))
    joined = wanted.join(exact, "ref", "left").join(per, "ref", "left")
    status = F.when(F.col("exact_id").isNotNull() | (F.col("n") == 1), "matched").when(F.col("n") > 1, "ambiguous").otherwise("not_found")
    return joined.select("ref", status.alias("status"), F.coalesce("exact_id", F.when(F.col("n") == 1, F.col("sole"))).alias("node_id"))


def attribute_paths(flow_edges: DataFrame, start: DataFrame, goals: DataFrame, max_hops: int = 12) -> tuple[DataFrame, DataFrame]:
    """(paths, verdict): one complete path is ``<confidence>_complete``, several are ambiguous, only open ones partial."""
    paths = simple_paths(flow_edges, "source_id", "target_id", start, goals, max_hops)
    n = F.count_if("complete")
    verdict = paths.agg(n.alias("complete_paths"), F.count("*").alias("all_paths"), F.min(F.when(F.col("complete"), F.col("confidence"))).alias("confidence"))
    status = F.when(F.col("complete_paths") > 1, "ambiguous").when(F.col("complete_paths") == 1, F.concat("confidence", F.lit("_complete"))).when(F.col("all_paths") > 0, "partial").otherwise("not_found")
    return paths, verdict.withColumn("status", status)
