"""Lineage in the context of workflows: which files a workflow reaches, what its variables are, and what its targets rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewright.functions.ids import stable_id
from tracewright.operators.graph import shortest_paths

MAX_HOPS = 12
_PLACEHOLDER = r"\$\{\s*([^}]+?)\s*\}"


def reachable_files(references: DataFrame, workflows: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(workflow, file, hops): files within ``max_hops`` references (source_file, target_file) of each workflow's own file (workflow)."""
    return shortest_paths(references, "source_file", "target_file", workflows.select("workflow"), max_hops).select(F.col("start").alias("workflow"), F.col("node").alias("file"), "hops")


def resolve_placeholders(uses: DataFrame, bindings: DataFrame) -> DataFrame:
    """``uses`` (workflow, context, name) with status and value from ``bindings`` (workflow, context, name, value).

    Bindings of the same context count before those of the rest of the workflow; one distinct value is resolved, several are ambiguous.
    """
    low = lambda c: F.lower(c).alias("name")
    wanted = uses.select("workflow", "context", low("name")).distinct()
    given = bindings.where("value is not null").select("workflow", "context", low("name"), "value").distinct()
    near = given.groupBy("workflow", "context", "name").agg(F.count_distinct("value").alias("n_near"), F.min("value").alias("near"))
    far = given.groupBy("workflow", "name").agg(F.count_distinct("value").alias("n_far"), F.min("value").alias("far"))
    both = wanted.join(near, ["workflow", "context", "name"], "left").join(far, ["workflow", "name"], "left")
    n = F.coalesce("n_near", "n_far", F.lit(0).cast("long"))
    status = F.when(n == 0, "unresolved").when(n == 1, "resolved").otherwise("ambiguous")
    basis = F.when(F.col("n_near").isNotNull(), "same_context").when(F.col("n_far").isNotNull(), "same_workflow")
    return both.select("workflow", "context", "name", n.alias("candidate_count"), status.alias("status"), basis.alias("basis"), F.when(n == 1, F.coalesce("near", "far")).alias("value"))


def fill_templates(rows: DataFrame, resolved: DataFrame, template: str) -> DataFrame:
    """``rows`` (workflow, context, ``template``) with ``filled``: resolved placeholders are replaced, others stay."""
    names = F.array_distinct(F.transform(F.regexp_extract_all(template, F.lit(_PLACEHOLDER), F.lit(1)), F.lower))
    known = resolved.where("status = 'resolved'").select("workflow", "context", "name", "value")
    keyed = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("name", F.explode_outer(names)).join(known, ["workflow", "context", "name"], "left")
    values = F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("name", "value"))))
    grouped = keyed.groupBy("_row", *rows.columns).agg(values.alias("_values"))
    pieces = F.regexp_extract_all(F.col(template), F.lit(r"(?s)" + _PLACEHOLDER.replace("(", "(?:") + r"|.[^$]*"), F.lit(0))
    put = lambda p: F.coalesce(F.element_at("_values", F.lower(F.regexp_extract(p, _PLACEHOLDER, 1))), p)
    return grouped.select(*rows.columns, F.array_join(F.transform(pieces, put), "").alias("filled"))


def producers(statements: DataFrame) -> DataFrame:
    """Which statements (statement_id, operation, target) make each relation: relation_name, n_producers, status, producer of a sole one."""
    made = statements.where(F.col("operation").isin("create", "insert", "merge") & F.col("target").isNotNull())
    per = made.groupBy(F.lower("target").alias("relation_name")).agg(F.count_distinct("statement_id").alias("n_producers"), F.min("statement_id").alias("sole"), F.array_join(F.array_sort(F.collect_set("operation")), ",").alias("operations"))
    return per.select("relation_name", "n_producers", "operations", F.when(F.col("n_producers") == 1, "unique").otherwise("multiple").alias("status"), F.when(F.col("n_producers") == 1, F.col("sole")).alias("statement_id"))


def value_sources(recursive: DataFrame) -> DataFrame:
    """What each target column takes its value from: one row per distinct terminal, its branches, and whether the column has one source."""
    key = ["target", "target_column"]
    ends = recursive.where("target_column is not null").groupBy(*key, "terminal_kind", "source_relation", "source_column").agg(F.count_distinct("statement_id", "branch").alias("n_branches"), F.min("depth").alias("depth"), F.bool_and(F.col("status") != "partial").alias("complete"))
    n = F.count("*").over(W.partitionBy(*key))
    kind = F.when(n == 1, "single_source").otherwise("multiple_sources")
    return ends.withColumn("mapping_kind", kind).withColumn("mapping_id", stable_id("map", *[F.col(c) for c in (*key, "terminal_kind", "source_relation", "source_column")]))


def driver_relations(recursive: DataFrame) -> DataFrame:
    """The relation that feeds most columns of a target: unique, ambiguous on a tie, or none without a column source."""
    fed = recursive.where("terminal_kind = 'column'").groupBy("target", "source_relation").agg(F.count_distinct("target_column").alias("n"))
    best = fed.withColumn("r", F.rank().over(W.partitionBy("target").orderBy(F.desc("n")))).where("r = 1")
    per = best.groupBy("target").agg(F.count("*").alias("k"), F.min("source_relation").alias("first"), F.max("n").alias("n_columns"))
    found = recursive.select("target").distinct().join(per, "target", "left")
    status = F.when(F.col("k") == 1, "unique").when(F.col("k") > 1, "ambiguous").otherwise("none")
    return found.select("target", status.alias("status"), F.when(F.col("k") == 1, F.col("first")).alias("driver_relation"), F.coalesce("n_columns", F.lit(0).cast("long")).alias("n_columns"))


def calculations(direct: DataFrame) -> DataFrame:
    """Roll-up of the direct lineage per target column: statuses, sources and kinds of expressions."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    source = F.concat_ws(".", "source_relation", "source_column")
    return direct.where("target_column is not null").groupBy("target", "target_column").agg(joined(F.col("status")).alias("statuses"), joined(F.when(F.col("source_column").isNotNull(), source)).alias("sources"), joined(F.col("expression_kind")).alias("expression_kinds"), F.count("*").alias("n_edges"))


def target_lineage(recursive: DataFrame, workflow_statements: DataFrame) -> DataFrame:
    """Lineage of workflows (workflow, statement_id): per target column the equal terminals of all branches as one row, with the branches."""
    rows = recursive.join(workflow_statements.select("workflow", "statement_id").distinct(), "statement_id")
    key = ["workflow", "target", "target_column", "terminal_kind", "source_relation", "source_column"]
    out = rows.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(F.col("branch").cast("string"))), ",").alias("branches"), F.count_distinct("statement_id").alias("n_statements"), F.bool_and(F.col("status") != "partial").alias("complete"))
    return out.withColumn("lineage_id", stable_id("workflow_lineage", *[F.col(c) for c in key]))


def storage_to_sql(storage: DataFrame, relations: DataFrame, physical: DataFrame) -> DataFrame:
    """Stored objects (object_id, table_name) beside SQL relations (relation_name) and physical tables (table_id, name), by exact normal name."""
    from tracewright.functions.ids import normalize_db_identifier

    of = lambda c: normalize_db_identifier(F.col(c))
    wanted = storage.withColumn("k", of("table_name"))
    read = relations.groupBy(of("relation_name").alias("k")).agg(F.count("*").alias("n_reads"))
    tables = physical.groupBy(of("name").alias("k")).agg(F.count_distinct("table_id").alias("n_tables"), F.min("table_id").alias("sole"))
    both = wanted.join(read, "k", "left").join(tables, "k", "left")
    n, reads = F.coalesce("n_tables", F.lit(0).cast("long")), F.coalesce("n_reads", F.lit(0).cast("long"))
    status = F.when(n > 1, "ambiguous").when((n == 1) & (reads > 0), "matched").when(n == 1, "stored_not_read").when(reads > 0, "read_not_stored").otherwise("unresolved")
    return both.select("object_id", status.alias("status"), reads.alias("n_reads"), n.alias("n_tables"), F.when(n == 1, F.col("sole")).alias("table_id"))


