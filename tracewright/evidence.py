"""Queries over lineage facts: the engine's own SQL texts are the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright import lineage_rows as rows
from tracewright.operators import models, rules
from tracewright.plans import lineage, workflow
from tracewright.queries import expects, query
from tracewright.streaming import events

#: Scripts in the dialect that is analysed: reports over the tests' tables, what rests on schemas that the scripts themselves declare, and what stays open.
SCRIPTS = {
    "report.sql": """
CREATE TABLE mart.big_orders AS WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice AS price FROM orders WHERE o_totalprice > ${least})
  SELECT o.o_orderkey, c.c_name, upper(c.c_mktsegment) AS segment, o.price FROM o JOIN customer c ON c.c_custkey = o.o_custkey;
CREATE TABLE mart.lines AS SELECT l_orderkey AS orderkey, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem GROUP BY l_orderkey;
INSERT INTO mart.report (segment, name, revenue) SELECT b.segment, b.c_name, l.revenue FROM mart.big_orders b LEFT JOIN mart.lines l ON l.orderkey = b.o_orderkey
  UNION ALL SELECT 'none', s_name, s_acctbal FROM supplier;
INSERT OVERWRITE TABLE ${env}.final SELECT r.*, row_number() OVER (PARTITION BY segment ORDER BY revenue DESC) AS n FROM (SELECT segment, revenue FROM mart.report) r;
""",
    "schema.sql": """
CREATE TABLE stage.a (id int, name string);
CREATE TABLE stage.b LIKE stage.a;
CREATE TABLE mart.x AS SELECT * FROM stage.b;
CREATE VIEW mart.y AS SELECT x.*, cast(upper(trim(name)) AS int) AS up FROM mart.x x;
INSERT INTO mart.k (id, name) VALUES (1, 'one'), (2, 'two');
UPDATE mart.k SET name = 'zero', id = id + 1 WHERE id = 0;
MERGE INTO mart.k t USING stage.a s ON t.id = s.id AND t.name = s.name WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *;
CREATE TABLE mart.c AS SELECT 1 AS a;
CREATE TABLE mart.c AS SELECT 1 AS b;
""",
    "open.sql": """
INSERT INTO mart.z SELECT * FROM raw.unknown;
INSERT INTO mart.u (a) SELECT a FROM mart.c ON CONFLICT (a) DO NOTHING;
INSERT INTO mart.v (a, b) SELECT x FROM raw.p JOIN raw.q ON raw.p.k = raw.q.k;
SELECT t.missing FROM raw.p p, raw.q q;
""",
}

def _facts(spark: SparkSession) -> dict[str, DataFrame]:
    return lineage.analyse(spark, SCRIPTS.items())


def _placed(spark: SparkSession, fact: str, *columns: str) -> DataFrame:
    """A kind of facts with the file and line of their statements in place of identifiers."""
    facts = _facts(spark)
    at = facts["statements"].select("statement_id", "file", "line_start")
    return facts[fact].join(at, "statement_id").select("file", "line_start", *columns)


@expects(*rows.STATEMENTS)
def lineage_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark)["statements"].select("file", "line_start", "operation", "target", "binding_mode", "parse_status", "n_scopes", "lint")


@expects(*rows.SCOPES)
def lineage_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, "scopes", "scope_kind", "outputs", "output_contract")


@expects(*rows.RELATIONS)
def lineage_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, "relations", "relation_kind", "relation_name", "alias")


@expects(*rows.COLUMNS)
def lineage_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, "columns", "column_ref", "role", "relation_name", "column_name", "status", "basis")


@expects(*rows.JOINS)
def lineage_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, "joins", "join_type", "condition_kind", "left_column", "operator", "right_column", "status", "physical_join_confirmed")


@expects(*rows.DIRECT)
def lineage_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, "direct", "branch", "target_column", "expression_kind", "source_relation", "source_column", "status", "origin_status")


@expects(*rows.RECURSIVE)
def lineage_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, "recursive", "branch", "target_column", "terminal_kind", "source_relation", "source_column", "depth", "status")


@expects(*rows.GAPS)
def lineage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, "gaps", "gap_kind").groupBy("file", "line_start", "gap_kind").agg(F.count("*").alias("n"))


@expects(*rows.KEYS)
def lineage_key_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, "keys", "key_kind", "relation_name", "key_columns")


@expects(*rows.LITERALS)
def lineage_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, "literals", "operation", "target", "target_column", "literal")


@expects(*rows.PATHS)
def lineage_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, "paths", "target_column", "column_ref", "operations")


@expects(*rows.CONTRACTS)
def lineage_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark)["contracts"]


@expects(*rows.DEPENDENCIES)
def lineage_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.dependencies(_facts(spark)["recursive"])


@expects(*rows.ACROSS)
def lineage_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.across_statements(_facts(spark)["recursive"])


@expects(*rows.JOIN_KEYS)
def lineage_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.key_observations(_facts(spark)["joins"])


@expects(*rows.PRODUCERS)
def sql_producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.producers(_facts(spark)["statements"]).drop("statement_id")


@expects(*rows.VALUE_SOURCES)
def sql_value_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.value_sources(_facts(spark)["recursive"]).drop("mapping_id")


@expects(*rows.DRIVERS)
def sql_driver_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.driver_relations(_facts(spark)["recursive"])


@expects(*rows.CALCULATIONS)
def sql_calculations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.calculations(_facts(spark)["direct"])


def _relation_uses(facts: dict[str, DataFrame]) -> DataFrame:
    names = facts["relations"].groupBy("relation_name", "relation_kind").agg(F.count("*").alias("reads"))
    writes = facts["statements"].where("target is not null").groupBy(F.col("target").alias("relation_name")).agg(F.count("*").alias("writes"))
    return names.join(writes, "relation_name", "full")


@expects(*rows.ROLES)
def sql_relation_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of the scripts' relations from what writes and reads them."""
    both = _relation_uses(_facts(spark))
    kind = F.coalesce("relation_kind", F.when(F.col("relation_name").contains("${"), "physical_template").otherwise("physical"))
    technical, owned = F.col("relation_name").rlike(r"(?i)(tmp|stg|temp)"), F.col("relation_name").startswith("mart.")
    count = lambda c: F.coalesce(c, F.lit(0))
    role = rules.relation_role(kind, F.col("relation_name").isNotNull(), count(F.col("writes")), count(F.col("reads")), F.lit(0), technical, owned)
    return both.select("relation_name", kind.alias("relation_kind"), role.alias("r")).select("relation_name", "relation_kind", "r.*")


@expects(
    "relation_name role confidence n_reads:BIGINT n_files:BIGINT",
    "('${env}.final', 'output_target', 'confirmed', 0, 0), ('customer', 'external_source', 'confirmed', 1, 1), ('lineitem', 'external_source', 'confirmed', 1, 1), ('mart.u', 'output_target', 'confirmed', 0, 0), ('mart.v', 'output_target', 'confirmed', 0, 0), ('mart.y', 'output_target', 'confirmed', 0, 0), "
    "('mart.z', 'output_target', 'confirmed', 0, 0), ('orders', 'external_source', 'confirmed', 1, 1), ('raw.p', 'external_source', 'confirmed', 2, 1), ('raw.q', 'external_source', 'confirmed', 2, 1), ('raw.unknown', 'external_source', 'confirmed', 1, 1), ('supplier', 'external_source', 'confirmed', 1, 1)",
)
def sql_source_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of business interest, with who reads them."""
    return models.source_inventory(_placed(spark, "relations", "relation_name"), sql_relation_roles(spark, sf_dir))


@expects(
    "target n_statements:BIGINT n_columns:BIGINT sources joins",
    "('${env}.final', 1, 3, 'mart.report', ''), ('mart.big_orders', 1, 4, 'customer,orders', 'customer.c_custkey=o.o_custkey'), ('mart.c', 2, 2, '', ''), ('mart.k', 1, 2, '', ''), ('mart.lines', 1, 2, 'lineitem', ''), ('mart.report', 1, 3, 'mart.big_orders,mart.lines,supplier', 'mart.lines.orderkey=mart.big_orders.o_orderkey'), "
    "('mart.v', 1, 1, '', 'raw.p.k=raw.q.k'), ('mart.x', 1, 2, 'stage.b', ''), ('mart.y', 1, 3, 'mart.x', ''), ('mart.z', 1, 0, '', '')",
)
def sql_insertion_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new attribute of each target has to fit."""
    facts = _facts(spark)
    return models.insertion_context(facts["recursive"], facts["joins"], facts["statements"])


@expects(
    "workflow target target_column terminal_kind source_relation source_column branches n_statements:BIGINT complete:BOOLEAN",
    "('w', 'mart.report', 'name', 'column', 'mart.big_orders', 'c_name', '0', 1, true), ('w', 'mart.report', 'name', 'column', 'supplier', 's_name', '1', 1, true), ('w', 'mart.report', 'revenue', 'column', 'mart.lines', 'revenue', '0', 1, true), "
    "('w', 'mart.report', 'revenue', 'column', 'supplier', 's_acctbal', '1', 1, true), ('w', 'mart.report', 'segment', 'column', 'mart.big_orders', 'segment', '0', 1, true), ('w', 'mart.report', 'segment', 'expression_without_column', NULL, '''none''', '1', 1, true)",
)
def sql_workflow_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineage of a workflow that runs the report alone."""
    facts = _facts(spark)
    runs = facts["statements"].where("target = 'mart.report'").select(F.lit("w").alias("workflow"), "statement_id")
    return workflow.target_lineage(facts["recursive"], runs).drop("lineage_id")


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n_events, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = events.windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return counted.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))
