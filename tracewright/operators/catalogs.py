"""Evidence commands, navigation and the datasets of reports, all as plain reads of fact tables.

A command keeps what holds a token, cuts the answer to a page that the caller asks for, and says how much there was.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewright.functions.ids import stable_id
from tracewright.operators.joins import block_join


def matching(facts: DataFrame, token: str | None, fact_type: str | None = None, **equal: str | None) -> DataFrame:
    """``facts`` of a type that hold the token anywhere in their JSON; arguments that are empty don't filter."""
    out = facts.where(F.col("fact_type") == fact_type) if fact_type else facts
    for column, value in equal.items():
        out = out.where(F.col(column) == value) if value else out
    return out.where(F.contains(F.lower(F.to_json(F.struct(*facts.columns))), F.lit(token.lower()))) if token else out


def found(matched: DataFrame, order: Sequence[str], limit: int) -> DataFrame:
    """The first ``limit`` rows by ``order``, each with the number of all and whether some are missing."""
    total = matched.agg(F.count("*").alias("n")).scalar()
    page = matched.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(limit)
    return page.withColumn("total_count", total).withColumn("truncated", F.col("total_count") > limit)


def json_members(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """(keys, key, value) of each member of a JSON object column; null and what is no object have none."""
    members = F.map_entries(F.from_json(column, "map<string,string>"))
    return df.select(*keys, F.explode(members).alias("m")).select(*keys, "m.key", "m.value")


def shapes(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Member families of JSON documents: (keys, member, n, n_null, kinds, examples by the smallest and largest value)."""
    rows = json_members(df, column, keys)
    kind = F.when(F.col("value").isNull(), "null").when(F.col("value").rlike(r"^-?\d+$"), "integer").when(F.col("value").rlike(r"^-?\d+\.\d+([eE][+-]?\d+)?$"), "number").when(F.col("value").isin("true", "false"), "boolean").when(F.col("value").rlike(r"^\["), "array").when(F.col("value").rlike(r"^\{"), "object").otherwise("string")
    return rows.withColumn("kind", kind).groupBy(*keys, F.col("key").alias("member")).agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull()).alias("n_null"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"), F.min("value").alias("least"), F.max("value").alias("most"))


def table_catalog(columns: DataFrame, keys: DataFrame, references: DataFrame) -> DataFrame:
    """Per table (table_name) of columns, keys (key_kind) and references (table_name, target_table): counts, primary key flag, tables referred to and referring."""
    counted = lambda df, name: df.groupBy("table_name").agg(F.count("*").alias(name))
    primary = keys.where("key_kind = 'primary'").groupBy("table_name").agg(F.lit(True).alias("has_primary_key"))
    incoming = references.groupBy(F.col("target_table").alias("table_name")).agg(F.count("*").alias("n_incoming"))
    out = counted(columns, "n_columns")
    for other in (counted(keys, "n_keys"), counted(references, "n_outgoing"), incoming, primary):
        out = out.join(other, "table_name", "left")
    return out.fillna(0, ["n_keys", "n_outgoing", "n_incoming"]).withColumn("has_primary_key", F.coalesce("has_primary_key", F.lit(False)))


def er_view(references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of tables: references (table_name, columns, target_table) by pair, with the number and the columns."""
    pairs = references.groupBy("table_name", "target_table").agg(F.count("*").alias("n_references"), F.array_join(F.array_sort(F.collect_set("columns")), ";").alias("columns"))
    edges = pairs.select(stable_id("er", F.col("table_name"), F.col("target_table")).alias("edge_id"), "table_name", "target_table", "n_references", "columns")
    ends = pairs.select(F.explode(F.array("table_name", "target_table")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")), edges


def rename_chains(renames: DataFrame) -> DataFrame:
    """Names at the start of a chain of renames (old_name, new_name) with what they end as and the number of steps; cycles have no end and none is given."""
    from tracewright.operators.graph import closure

    reached = closure(renames, "old_name", "new_name")
    starts = renames.select(F.col("old_name").alias("start")).distinct().join(renames.select(F.col("new_name").alias("start")), "start", "left_anti")
    ends = reached.join(renames.select(F.col("old_name").alias("node")).distinct(), "node", "left_anti")
    return ends.join(starts, "start").select("start", F.col("node").alias("end"), F.col("depth").alias("steps"))


def lineage_breaks(recursive: DataFrame, known: DataFrame) -> DataFrame:
    """Terminals of lineage in relations that nothing known (relation_name) provides."""
    ends = recursive.where("terminal_kind = 'column'").groupBy(F.col("source_relation").alias("relation_name")).agg(F.count_distinct("target", "target_column").alias("n_targets"))
    return ends.join(known.select("relation_name").distinct(), "relation_name", "left_anti")


def change_summary(delta: DataFrame, kind: str, change: str = "change") -> DataFrame:
    """Added, removed and changed facts per kind, with a risk: removals are high, changes medium, additions low."""
    count = lambda c: F.count_if(F.col(change) == c).alias(c)
    per = delta.groupBy(kind).agg(count("added"), count("removed"), count("changed"))
    return per.withColumn("risk", F.when(F.col("removed") > 0, "high").when(F.col("changed") > 0, "medium").when(F.col("added") > 0, "low").otherwise("none"))


def per_key_counts(keys: DataFrame, key: str, metrics: Mapping[str, DataFrame]) -> DataFrame:
    """A column of counts per metric (a table with ``key``), 0 where there is none: one union and one aggregation, however many metrics there are."""
    rows = None
    for name, df in metrics.items():
        part = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).withColumn("metric", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    counted = rows.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("n"))), F.lit(0)).alias(m) for m in metrics])
    return keys.select(key).distinct().join(counted, key, "left").fillna(0, list(metrics))


def directive_matches(rules: DataFrame, types: DataFrame, fields: DataFrame) -> DataFrame:
    """Rules (rule_id, level, name) with what they name: types (type_name) at level type, fields (field_name) at level field; two equi-joins, not an OR."""
    at = lambda level, df, column: rules.where(F.col("level") == level).join(df.select(F.col(column).alias("name")).groupBy("name").agg(F.count("*").alias("n")), "name")
    both = at("type", types, "type_name").unionByName(at("field", fields, "field_name"))
    return both.select("rule_id", "level", "name", "n")


def named_values(values: DataFrame, types: DataFrame) -> DataFrame:
    """Configuration values (value_id, value) that are exactly a type's full name (type_id, full_name): matched or ambiguous, others are left out."""
    per = types.groupBy(F.col("full_name").alias("value")).agg(F.count_distinct("type_id").alias("n_types"), F.min("type_id").alias("sole"))
    return values.join(per, "value").select("value_id", "value", "n_types", F.when(F.col("n_types") == 1, "matched").otherwise("ambiguous").alias("status"), F.when(F.col("n_types") == 1, F.col("sole")).alias("type_id"))


def composed_boundaries(boundaries: DataFrame, identity: Sequence[str], interface: str) -> DataFrame:
    """Boundaries of one identity (any number of columns; nulls are equal) as one, with its interfaces."""
    per = boundaries.groupBy(*identity).agg(F.count("*").alias("n_boundaries"), F.array_join(F.array_sort(F.collect_set(F.col(interface).cast("string"))), ",").alias("interfaces"))
    return per.withColumn("boundary_id", stable_id("boundary", *[F.col(c) for c in identity]))


def interaction_graph(matched: DataFrame, interfaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) between repositories: matched calls (repo_id, target_id) by the repository of the target, the weakest confidence of each edge first."""
    to = interfaces.select(F.col("interface_id").alias("target_id"), F.col("repo_id").alias("target_repo"))
    calls = matched.where("status = 'matched'").join(to, "target_id")
    edges = calls.groupBy(F.col("repo_id").alias("source_repo"), "target_repo").agg(F.count("*").alias("n_calls"), F.min(F.when(F.col("confidence") == "confirmed", 2).otherwise(1)).alias("r"))
    edges = edges.select("source_repo", "target_repo", "n_calls", F.when(F.col("r") == 2, "confirmed").otherwise("probable").alias("confidence"))
    nodes = interfaces.groupBy("repo_id").agg(F.count("*").alias("n_interfaces"))
    return nodes, edges


def occurrence_graph(occurrences: DataFrame) -> DataFrame:
    """Objects (object_id, file, line) with their places, the strongest first: a file and line, a file, or nothing."""
    rank = F.when(F.col("file").isNotNull() & F.col("line").isNotNull(), 2).when(F.col("file").isNotNull(), 1).otherwise(0)
    rows = occurrences.select("object_id", "file", "line", rank.alias("r")).distinct()
    best = rows.groupBy("object_id").agg(F.max("r").alias("r"), F.count("*").alias("n_occurrences"), F.max(F.struct("r", F.col("file"), F.col("line"))).alias("_any"))
    first = rows.join(best.select("object_id", "r"), ["object_id", "r"]).groupBy("object_id").agg(F.min(F.struct("file", "line")).alias("first"))
    level = F.element_at(F.array(*[F.lit(x) for x in ("none", "file", "line")]), F.col("r") + 1)
    return best.join(first, "object_id").select("object_id", level.alias("localization"), "n_occurrences", "first.file", "first.line")


def relationships(fields: DataFrame, types: DataFrame, storage: DataFrame) -> DataFrame:
    """Declared relationships: fields (type_id, field, target_type, cardinality) whose target is a known type, with the diagnosis of their storage evidence.

    ``storage`` has (type_id, field, storage_kind). A relationship is stored, stored in several ways, of an unknown target, or without evidence.
    """
    known = types.select(F.col("type_id").alias("target_type"), F.lit(True).alias("known"))
    kept = storage.groupBy("type_id", "field").agg(F.count_distinct("storage_kind").alias("n_kinds"), F.min("storage_kind").alias("sole"))
    rows = fields.where("target_type is not null").join(known, "target_type", "left").join(kept, ["type_id", "field"], "left")
    diagnosis = F.when(F.col("known").isNull(), "target_type_unknown").when(F.col("n_kinds").isNull(), "storage_evidence_missing").when(F.col("n_kinds") > 1, "several_storage_kinds").otherwise("stored")
    return rows.select(stable_id("relationship", F.col("type_id"), F.col("field"), F.col("target_type")).alias("relationship_id"), "type_id", "field", "target_type", "cardinality", F.when(diagnosis == "stored", F.col("sole")).alias("storage_kind"), diagnosis.alias("diagnosis"))


def storage_usage(declared: DataFrame, used: DataFrame) -> DataFrame:
    """Declared stored objects (object_id) with reads and writes (object_id, access): used, written only, read only or unused; objects that are used but not declared too."""
    per = used.groupBy("object_id").agg(F.count_if(F.col("access") == "read").alias("n_reads"), F.count_if(F.col("access") == "write").alias("n_writes"))
    rows = declared.select("object_id").distinct().withColumn("declared", F.lit(True)).join(per, "object_id", "full").fillna(0, ["n_reads", "n_writes"])
    status = F.when(F.col("declared").isNull(), "undeclared").when((F.col("n_reads") > 0) & (F.col("n_writes") > 0), "used").when(F.col("n_writes") > 0, "written_only").when(F.col("n_reads") > 0, "read_only").otherwise("unused")
    return rows.select("object_id", "n_reads", "n_writes", status.alias("status"))


def persistence_cases(ingress: DataFrame, calls: DataFrame, writes: DataFrame, reads: DataFrame, max_hops: int = 4) -> DataFrame:
    """Foreign data that is kept: per ingress (operation) the stores that its call paths of at most ``max_hops`` write, whether something reads them, and how far the case is proven.

    ``calls`` has (caller, callee), ``writes`` and ``reads`` (operation, store). complete: written and read; written: nothing reads; called: paths but no write; open: no path.
    """
    from tracewright.operators.graph import shortest_paths

    reached = shortest_paths(calls, "caller", "callee", ingress.select("operation"), max_hops).select(F.col("start").alias("ingress"), F.col("node").alias("operation"), "hops")
    written = reached.join(writes.distinct(), "operation").groupBy("ingress", "store").agg(F.min("hops").alias("hops"))
    readers = reads.groupBy("store").agg(F.count_distinct("operation").alias("n_readers"))
    calling = reached.where("hops > 0").select("ingress").distinct().withColumn("calls", F.lit(True))
    rows = ingress.select(F.col("operation").alias("ingress")).distinct().join(written, "ingress", "left").join(readers, "store", "left").join(calling, "ingress", "left")
    maturity = F.when(F.col("store").isNotNull() & (F.col("n_readers") > 0), "complete").when(F.col("store").isNotNull(), "written").when(F.col("calls"), "called").otherwise("open")
    return rows.select("ingress", "store", "hops", F.coalesce("n_readers", F.lit(0).cast("long")).alias("n_readers"), maturity.alias("maturity"))


def navigation(facts: DataFrame, section: str, domain: str, item: str, per_section: int) -> DataFrame:
    """The first ``per_section`` items of each section by name, with the section's size and domains."""
    window = W.partitionBy(section)
    ranked = facts.select(section, domain, item).distinct().withColumn("place", F.row_number().over(window.orderBy(item, domain)))
    sizes = facts.groupBy(section).agg(F.count_distinct(item, domain).alias("n_items"), F.count_distinct(domain).alias("n_domains"))
    return ranked.where(F.col("place") <= per_section).join(sizes, section).select(section, "place", item, domain, "n_items", "n_domains")


def report_sections(facts: DataFrame, section: str, measure: Column, item: str, top: int) -> DataFrame:
    """The dataset of a report: per section its ``top`` items by measure, ties by name, with shares of the section's whole."""
    whole = W.partitionBy(section)
    summed = facts.groupBy(section, item).agg(measure.alias("amount"))
    ranked = summed.withColumn("place", F.row_number().over(whole.orderBy(F.desc("amount"), item))).withColumn("share", F.round(F.col("amount") / F.sum("amount").over(whole), 6))
    return ranked.where(F.col("place") <= top).select(section, "place", item, "amount", "share")


def compare_reports(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of two datasets by key: same, changed, added or removed."""
    body = lambda df, name: df.select(*keys, F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c not in keys))), 256).alias(name))
    both = body(before, "a").join(body(after, "b"), list(keys), "full")
    state = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return both.select(*keys, state.alias("state"))


def topological_order(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """(node, level) of a plan's nodes by needs (node, needed): level by level, what needs nothing first; nodes on or behind a cycle have level null."""
    from tracewright.operators.graph import checkpointed

    waiting = checkpointed(nodes.select("node").distinct())
    open_needs = needs.select("node", "needed").distinct().join(waiting.select(F.col("node").alias("needed")), "needed", "left_semi")
    done, level = None, 0
    while True:
        ready = checkpointed(waiting.join(open_needs.select("node").distinct(), "node", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            rest = waiting.withColumn("level", F.lit(None).cast("int"))
            return rest if done is None else done.unionByName(rest)
        done = ready if done is None else done.unionByName(ready)
        waiting = checkpointed(waiting.join(ready.select("node"), "node", "left_anti"))
        open_needs = checkpointed(open_needs.join(ready.select(F.col("node").alias("needed")), "needed", "left_anti"))
        level += 1


def freshness(published: DataFrame, sources: DataFrame) -> DataFrame:
    """Published products (product_id, source_id, snapshot) against the present snapshots of their sources: up_to_date, update_available or source_unavailable."""
    now = sources.groupBy("source_id").agg(F.max("snapshot").alias("present"))
    status = F.when(F.col("present").isNull(), "source_unavailable").when(F.col("present") == F.col("snapshot"), "up_to_date").otherwise("update_available")
    return published.join(now, "source_id", "left").select("product_id", "source_id", status.alias("freshness_status"))


def latest_definitions(definitions: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last definition by ``order`` and the number of earlier ones that it replaces."""
    values = [c for c in definitions.columns if c not in key]
    per = definitions.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("last"), (F.count("*") - 1).alias("n_replaced"))
    return per.select(*key, "last.*", "n_replaced")


def partition_children(children: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns (table_name, column_name, ...) of partition tables (child, parent), which they have from their parents.

    Few parents can have many children and many columns, which all meet.
    """
    return block_join(children, columns.withColumnRenamed("table_name", "parent"), "parent").withColumnRenamed("child", "table_name")


def resolve_schemas(names: DataFrame, known: DataFrame) -> DataFrame:
    """Names (name) whose schema is a placeholder, with the known name (name) that has the same table, if it is unique."""
    from tracewright.operators.joins import unique_or_ambiguous

    wanted = names.select("name").distinct().where(F.col("name").rlike(r"^(\$\{[^}]*\}|\{\{[^}]*\}\})\.")).withColumn("table", F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)))
    given = known.where(~F.contains("name", F.lit("${"))).select(F.lower(F.regexp_extract("name", r"([^.]+)$", 1)).alias("table"), F.col("name").alias("known_name"))
    return unique_or_ambiguous(wanted, given, "table", "known_name").select("name", "candidate_count", "status", F.col("selected_id").alias("known_name"))


def salience(families: DataFrame, score: Column, frontier: Column) -> DataFrame:
    """``families`` with the kind of discovery: what lies outside the analysed frontier is an unknown primitive, all else none; the score is kept beside."""
    return families.withColumn("discovery_kind", F.when(frontier, "unknown_primitive").otherwise("none")).withColumn("salience_score", score)
