"""Registered queries of the core operators on the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import ids, search
from tracewright.operators import aggregates, delta, graph, joins, ranking, rules
from tracewright.plans import lineage, paging

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def expects(columns: str, rows: str) -> Callable[[Query], Query]:
    """A query over fixed texts with the rows that it has to give, as VALUES; columns are name or name:type."""
    names = [c.partition(":") for c in columns.split()]
    picked = ", ".join(f"CAST({n} AS {kind or 'VARCHAR'}) AS {n}" for n, _, kind in names)
    return query(f"SELECT {picked} FROM (VALUES {rows}) AS t({', '.join(n for n, _, _ in names)})")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Inventories and aggregates


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n_rows, count(DISTINCT l_partkey) AS n_parts, count(*) FILTER (WHERE l_discount > 0.05) AS n_discounted,
 bool_or(l_tax > 0.07) AS any_high_tax, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, string_agg(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS line_numbers
 FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def inventory_by_group(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("l_partkey").alias("n_parts"),
        F.count_if(F.col("l_discount") > 0.05).alias("n_discounted"),
        F.bool_or(F.col("l_tax") > 0.07).alias("any_high_tax"),
        F.min("l_shipdate").alias("first_ship"),
        F.max("l_shipdate").alias("last_ship"),
        aggregates.sorted_distinct(F.col("l_linenumber").cast("string")).alias("line_numbers"),
    )


@query("""SELECT 'o_orderstatus' AS dimension, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus
 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority""")
def status_histogram(spark, sf_dir):
    return aggregates.status_histogram(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"])


@query("""SELECT user_id, max(CASE WHEN event_type = 'view' THEN value END) AS max_view, max(CASE WHEN event_type = 'signup' THEN value END) AS max_signup,
 max(CASE WHEN event_type = 'purchase' THEN value END) AS max_purchase FROM events GROUP BY user_id""")
def conditional_pivot(spark, sf_dir):
    return aggregates.conditional_pivot(table(spark, sf_dir, "events"), ["user_id"], "event_type", {"view": "max_view", "signup": "max_signup", "purchase": "max_purchase"}, F.col("value"))


@query("""SELECT o_orderpriority, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS covered, count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) AS open,
 round(count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 6) AS ratio,
 CASE WHEN count(*) = 0 THEN 'not_applicable' WHEN count(*) FILTER (WHERE o_orderstatus = 'F') = count(*) AND count(*) FILTER (WHERE o_orderstatus IN ('O', 'P')) = 0 THEN 'complete' ELSE 'partial' END AS coverage_status
 FROM orders GROUP BY o_orderpriority""")
def coverage_ladder(spark, sf_dir):
    return aggregates.coverage(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderstatus", "F", ["O", "P"])


@query("""WITH c AS (SELECT l_suppkey, CASE WHEN bool_and(l_linestatus = 'F') THEN 'complete' ELSE 'partial' END AS s FROM lineitem GROUP BY l_suppkey)
 SELECT s_nationkey, CASE WHEN bool_or(s = 'partial') THEN 'partial' WHEN bool_or(s = 'complete') THEN 'complete' ELSE 'not_applicable' END AS coverage_status, count(*) AS members
 FROM supplier LEFT JOIN c ON s_suppkey = l_suppkey GROUP BY s_nationkey""")
def island_coverage(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.when(F.bool_and(F.col("l_linestatus") == "F"), "complete").otherwise("partial").alias("coverage_status"))
    return aggregates.roll_up(table(spark, sf_dir, "supplier").join(per, "s_suppkey", "left"), ["s_nationkey"])


@query("""SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1""")
def duplicate_keys(spark, sf_dir):
    return aggregates.duplicates(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("""SELECT source, count(DISTINCT lang) AS n_langs, CAST(sum(n_chars) AS BIGINT) AS n_chars, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM documents GROUP BY source""")
def portfolio_facets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count_distinct("lang").alias("n_langs"), F.sum("n_chars").alias("n_chars"), aggregates.sorted_distinct("lang").alias("langs"))


@query("""WITH g AS (SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE quality = 1), a AS (SELECT d.doc_id, source FROM documents d JOIN labels USING (doc_id) WHERE n_chars >= 400),
 b AS (SELECT coalesce(g.source, a.source) AS source, g.doc_id AS gid, a.doc_id AS aid FROM g FULL JOIN a ON g.doc_id = a.doc_id AND g.source = a.source),
 c AS (SELECT source, count(*) FILTER (WHERE gid IS NOT NULL AND aid IS NOT NULL) AS tp, count(*) FILTER (WHERE gid IS NULL) AS fp, count(*) FILTER (WHERE aid IS NULL) AS fn FROM b GROUP BY source)
 SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c""")
def quality_gate(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return aggregates.quality_gate(both.where("quality = 1"), both.where("n_chars >= 400"), ["source", "doc_id"], "source")


# Ranking and paging


@query("""SELECT * FROM (SELECT o_orderpriority, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank,
 count(*) OVER (PARTITION BY o_orderpriority) AS group_count, count(*) OVER (PARTITION BY o_orderpriority) > 3 AS truncated FROM orders) WHERE rank <= 3""")
def evidence_top_k(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return ranking.top_per_group(orders, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by part and supplier. They are dealt by part once, for the counts and for all that is made of a part's suppliers."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    return joins.dealt(lines.where("l_partkey is not null"), lines.count(), "l_partkey").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT l_partkey, max(n) AS best FROM s GROUP BY 1)
 SELECT l_partkey, count(*) AS ties, CASE WHEN count(*) = 1 THEN min(l_suppkey) END AS l_suppkey, CASE WHEN count(*) = 1 THEN 'matched' ELSE 'ambiguous' END AS status
 FROM s JOIN m USING (l_partkey) WHERE n = best GROUP BY l_partkey""")
def candidate_ranking(spark, sf_dir):
    return ranking.best_or_tie(_uses(spark, sf_dir), ["l_partkey"], ["n"], "l_suppkey")


@query("""WITH s AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2), m AS (SELECT l_partkey, max(n) AS best, count(*) AS candidates FROM s GROUP BY 1)
 SELECT l_partkey, candidates, min(l_suppkey) AS recommended, CASE WHEN candidates = 1 THEN 'confirmed_unique' WHEN count(*) = 1 THEN 'probable_ranked' ELSE 'probable_tie_break' END AS status
 FROM s JOIN m USING (l_partkey) WHERE n = best GROUP BY l_partkey, candidates""")
def target_recommendation(spark, sf_dir):
    return ranking.recommend(_uses(spark, sf_dir), ["l_partkey"], ["n"], "l_suppkey")


@query("""SELECT o_custkey, max(o_orderdate) AS o_orderdate, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey""")
def latest_row(spark, sf_dir):
    return ranking.latest(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", ["o_orderkey"])


@query("""WITH p AS (SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_name NULLS LAST, c_custkey LIMIT 20 OFFSET 20)
 SELECT c_custkey, c_name, count(o_orderkey) AS n_orders, round(sum(o_totalprice), 2) AS total FROM p LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""")
def two_phase_page(spark, sf_dir):
    """The page is chosen first; children are read for its 20 rows alone."""
    customers = table(spark, sf_dir, "customer").where(search.equals(c_mktsegment="BUILDING")).select("c_custkey", "c_name")
    page = F.broadcast(paging.page(customers, ["c_name", "c_custkey"], 20, 20))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    children = orders.join(page.select("c_custkey"), "c_custkey", "left_semi").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return page.join(children, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0).cast("long")).alias("n_orders"), "total")


@query("""SELECT kind, id, name FROM (SELECT 0 AS r, 'supplier' AS kind, s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT 1, 'customer', c_custkey, c_name FROM customer)
 ORDER BY r, name NULLS LAST, id LIMIT 50 OFFSET 5""")
def ordered_sources_page(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.lit(0).alias("r"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = table(spark, sf_dir, "customer").select(F.lit(1).alias("r"), F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return paging.page(s.unionByName(c), ["r", "name", "id"], 50, 5).drop("r")


# Predicates


@query("""SELECT c_custkey, c_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer""")
def exists_flag(spark, sf_dir):
    return joins.with_exists(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "has_orders")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def not_exists(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT n_nationkey, n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_customers FROM nation""")
def correlated_count(spark, sf_dir):
    return joins.with_count(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), table(spark, sf_dir, "customer"), "n_nationkey", "c_nationkey", "n_customers")


@query("""SELECT p_partkey, p_name FROM part WHERE lower(coalesce(p_name, '') || ' ' || coalesce(p_brand, '') || ' ' || coalesce(p_type, '')) LIKE '%brand%2%' """)
def token_search(spark, sf_dir):
    return table(spark, sf_dir, "part").where(search.token_search("brand%2", "p_name", "p_brand", "p_type")).select("p_partkey", "p_name")


@query("""SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k10, count(*) AS n FROM events GROUP BY 1, 2""")
def json_path(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("long") % 10
    return table(spark, sf_dir, "events").groupBy("event_type", k.alias("k10")).agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_orderkey = 1)""")
def tuple_in(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    keys = lines.where("l_orderkey = 1").select("l_partkey", "l_suppkey").distinct()
    return lines.join(keys, ["l_partkey", "l_suppkey"], "left_semi")


@query("""SELECT 'strict' AS view, count(*) AS n FROM labels WHERE quality = 1 AND toxic = 0
 UNION ALL SELECT 'working', count(*) FROM labels WHERE quality = 1 UNION ALL SELECT 'exploratory', count(*) FROM labels WHERE quality = 1 OR toxic = 0""")
def confidence_views(spark, sf_dir):
    c = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "CONFIRMED").when(F.col("quality") == 1, "derived").when(F.col("toxic") == 0, "candidate").otherwise("rejected")
    views = rules.confidence_views(table(spark, sf_dir, "labels").withColumn("confidence", c), "confidence")
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("view"), "n") for name, df in views.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Joins


@query("""WITH c AS (SELECT sha256(text) AS k, count(DISTINCT item_id) AS n, min(item_id) AS sole FROM benchmark GROUP BY 1)
 SELECT doc_id, coalesce(n, 0) AS candidate_count, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE WHEN n = 1 THEN sole END AS selected_id
 FROM documents LEFT JOIN c ON sha256(text) = k""")
def unique_or_ambiguous(spark, sf_dir):
    return _document_matches(spark, sf_dir).select("doc_id", "candidate_count", "status", "selected_id")


def _document_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whole texts, by digest
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("k"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.sha2("text", 256).alias("k"))
    return joins.unique_or_ambiguous(docs, items, "k", "item_id")


@query("""WITH c AS (SELECT sha256(text) AS k, count(DISTINCT item_id) AS n FROM benchmark GROUP BY 1),
 g AS (SELECT doc_id, CASE WHEN n > 1 THEN 'ambiguous_item' ELSE 'unresolved_item' END AS gap_kind FROM documents LEFT JOIN c ON sha256(text) = k WHERE coalesce(n, 0) <> 1)
 SELECT gap_kind, count(*) AS n, count(DISTINCT doc_id) AS subjects FROM g GROUP BY gap_kind""")
def gap_summary(spark, sf_dir):
    return aggregates.gap_summary(joins.gaps(_document_matches(spark, sf_dir), "doc_id", "item"))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') o ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL""")
def orphans(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    return joins.orphans(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), parents, "l_orderkey", "o_orderkey")


@query("""SELECT DISTINCT o_orderkey, o_custkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)""")
def either_endpoint(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    n = orders.count() + lines.count()
    ends = joins.dealt(orders, n, "o_orderkey").distinct(), joins.dealt(lines, n, "l_orderkey").distinct()
    edges = ends[0].join(ends[1], F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey")
    return joins.either_endpoint(edges, table(spark, sf_dir, "supplier").where("s_acctbal > 5000"), "o_custkey", "l_suppkey", "s_suppkey")


@query("""WITH l AS (SELECT n_regionkey, unnest(list(n_nationkey)) AS k FROM nation GROUP BY n_regionkey) SELECT c_custkey, n_regionkey FROM customer JOIN l ON c_nationkey = k""")
def list_membership(spark, sf_dir):
    lists = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_nationkey").alias("nations"))
    return joins.list_membership(table(spark, sf_dir, "customer"), lists, "c_nationkey", "nations").select("c_custkey", "n_regionkey")


_TIERS = """WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':(80|443)$', '') AS host,
   regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '') AS path FROM pages),
 t AS (SELECT * FROM p),
 h AS (SELECT p.page_id, t.page_id AS target_id, 1 AS tier FROM p JOIN t ON p.host = t.host AND p.path = t.path WHERE p.page_id <> t.page_id
   UNION SELECT p.page_id, t.page_id, 2 FROM p JOIN t ON p.host = t.host WHERE p.page_id <> t.page_id
   UNION SELECT p.page_id, t.page_id, 3 FROM p JOIN t ON p.path = t.path WHERE p.page_id <> t.page_id),
 b AS (SELECT page_id, min(tier) AS tier FROM h GROUP BY page_id),
 c AS (SELECT page_id, tier, count(*) AS n, min(target_id) AS sole FROM h JOIN b USING (page_id, tier) GROUP BY page_id, tier)
 SELECT page_id, tier, CASE tier WHEN 1 THEN 'host_and_path' WHEN 2 THEN 'host' WHEN 3 THEN 'path' END AS tier_name, coalesce(n, 0) AS candidate_count,
   CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN sole END AS target_id FROM p LEFT JOIN c USING (page_id)"""


@query(_TIERS)
def tiered_lookup(spark, sf_dir):
    raw = F.regexp_replace(F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    facts = table(spark, sf_dir, "pages").select("page_id", ids.url_authority(F.col("url")).alias("host"), raw.alias("path"))
    return joins.first_tier_counts(facts, "page_id", [("host_and_path", ["host", "path"]), ("host", ["host"]), ("path", ["path"])])


#: What is observed for ``declared_key_match``: lines with themselves and with their parts.
_KEY_JOINS = """SELECT p.p_name, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber
 JOIN part p ON p.p_partkey = a.l_partkey;"""


@query("""WITH u AS (SELECT DISTINCT 'lineitem' AS rel, unnest(['l_orderkey', 'l_linenumber', 'l_partkey']) AS c), d AS (SELECT * FROM (VALUES ('lineitem', 'pk'), ('lineitem', 'part'), ('lineitem', 'supp')) v(rel, key_id))
 SELECT rel, key_id FROM d WHERE key_id IN ('pk', 'part')""")
def declared_key_match(spark, sf_dir):
    """The joins of a script are read from its lineage; only columns that the table has count as used."""
    columns = table(spark, sf_dir, "lineitem").columns
    joined = lineage.analyse(spark, [("keys.sql", _KEY_JOINS)])["joins"].where("operator = '='")
    ends = joined.select(F.explode(F.array("left_column", "right_column")).alias("used"))
    pairs = ends.select(F.substring_index("used", ".", 1).alias("rel"), F.substring_index("used", ".", -1).alias("column")).where((F.col("rel") == "lineitem") & F.col("column").isin(columns))
    declared = spark.createDataFrame([("lineitem", "pk", ["l_orderkey", "l_linenumber"]), ("lineitem", "part", ["l_partkey"]), ("lineitem", "supp", ["l_partkey", "l_suppkey"])], "rel string, key_id string, key_columns array<string>")
    return joins.covered_keys(pairs, declared, ["rel"]).select("rel", "key_id")


@query("""SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier""")
def union_typed_nulls(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)


# Identifiers and normal forms


@query("""SELECT n_nationkey, 'nation_' || substr(sha256(coalesce(n_name, '') || chr(31) || coalesce(r_name, '') || chr(31)), 1, 20) AS stable_id FROM nation JOIN region ON r_regionkey = n_regionkey""")
def stable_ids(spark, sf_dir):
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return both.select("n_nationkey", ids.stable_id("nation", F.col("n_name"), F.col("r_name"), None).alias("stable_id"))


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '[?#].*$', '') AS x FROM pages)
 SELECT page_id, lower(CASE WHEN y = '/' THEN y ELSE regexp_replace(y, '/$', '') END) AS path FROM (SELECT page_id, regexp_replace('/' || regexp_replace(regexp_replace(x || '', '/[0-9]+/', '/{}/', 'g'), '/[0-9]+$', '/{}'), '/+', '/', 'g') AS y FROM p)""")
def url_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", ids.url_path(F.col("url")).alias("path"))


# Deltas and publication


@query("""WITH b AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderkey) AS last FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1), a AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderkey) AS last FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1)
 SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' ELSE 'changed' END AS delta_kind,
 'delta_' || substr(sha256(CAST(coalesce(a.k, b.k) AS VARCHAR) || chr(31) || CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' ELSE 'changed' END), 1, 20) AS delta_id,
 sha256('=' || CAST(b.n AS VARCHAR) || chr(31) || '=' || CAST(b.last AS VARCHAR)) AS before_print, sha256('=' || CAST(a.n AS VARCHAR) || chr(31) || '=' || CAST(a.last AS VARCHAR)) AS after_print
 FROM b FULL JOIN a ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR (a.n, a.last) <> (b.n, b.last)""")
def snapshot_delta(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    of = lambda df: df.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"))
    before = of(orders.where(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")))
    after = of(orders.where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")))
    return delta.keyed_delta(before, after, "o_custkey", ["n", "last"])


@query("""WITH b AS (SELECT o_custkey AS k, min(o_orderstatus) AS s FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1), a AS (SELECT o_custkey AS k, min(o_orderstatus) AS s FROM orders GROUP BY 1)
 SELECT coalesce(a.k, b.k) AS o_custkey, coalesce(b.s, 'absent') AS before_status, coalesce(a.s, 'absent') AS after_status FROM b FULL JOIN a ON a.k = b.k WHERE coalesce(b.s, 'absent') <> coalesce(a.s, 'absent')""")
def coverage_delta(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    of = lambda df: df.groupBy("o_custkey").agg(F.min("o_orderstatus").alias("s"))
    return delta.status_delta(of(orders.where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))), of(orders), "o_custkey", "s")


@query("""SELECT s_suppkey AS slot, s_name AS product, 'own' AS origin FROM supplier UNION ALL SELECT c_custkey, c_name, 'inherited' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def publication_inheritance(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("slot"), F.col("s_name").alias("product"))
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("slot"), F.col("c_name").alias("product"))
    return delta.inherit(base, own, "slot")


@query("""SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)""")
def unreachable_blobs(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return delta.unreachable(table(spark, sf_dir, "part").select("p_partkey"), used, "p_partkey")


# Graphs


def _geo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("a"), F.concat(F.lit("n"), "n_nationkey").alias("b"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("a"), F.concat(F.lit("c"), "c_custkey").alias("b"))
    return n.unionByName(c)


_GEO = "e AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"


@query(f"""WITH RECURSIVE {_GEO}, w AS (SELECT a AS start, b AS node, 1 AS depth FROM e UNION SELECT w.start, e.b, depth + 1 FROM w JOIN e ON e.a = w.node) SELECT start, node, min(depth) AS depth FROM w GROUP BY ALL""")
def recursive_closure(spark, sf_dir):
    return graph.closure(_geo_edges(spark, sf_dir), "a", "b")


_TRADE = "t AS (SELECT DISTINCT 'o' || o_custkey AS a, 's' || l_suppkey AS b, CASE WHEN l_quantity > 49 THEN 'confirmed' WHEN l_quantity > 48 THEN 'probable' ELSE 'unknown' END AS confidence FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"


def _trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    q = F.col("l_quantity")
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = both.select(F.concat(F.lit("o"), "o_custkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"), F.when(q > 49, "confirmed").when(q > 48, "probable").otherwise("unknown").alias("confidence")).distinct()
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    return nodes, edges


def _islands_sql(allowed: str) -> str:
    return f"""WITH RECURSIVE {_TRADE}, k AS (SELECT a, b FROM t WHERE confidence IN ({allowed})), u AS (SELECT a, b FROM k UNION SELECT b, a FROM k), n AS (SELECT a AS node FROM t UNION SELECT b FROM t),
 w AS (SELECT node, node AS other FROM n UNION SELECT w.node, u.b FROM w JOIN u ON u.a = w.other), d AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM k UNION ALL SELECT b FROM k) GROUP BY node)
 SELECT node, min(other) AS component, coalesce(any_value(degree), 0) AS degree FROM w LEFT JOIN d USING (node) GROUP BY node"""


@query(_islands_sql("'confirmed'"))
def islands_strict(spark, sf_dir):
    return graph.islands(*_trade(spark, sf_dir), "node", "a", "b", "strict")


@query(_islands_sql("'confirmed', 'probable'"))
def islands_extended(spark, sf_dir):
    return graph.islands(*_trade(spark, sf_dir), "node", "a", "b", "extended")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n.n_nationkey AS a, m.n_nationkey AS b FROM nation n JOIN nation m ON (m.n_nationkey = (n.n_nationkey * 2 + 1) % 25 OR m.n_nationkey = (n.n_nationkey + 3) % 25) AND n.n_nationkey <> m.n_nationkey),
 w AS (SELECT 0 AS start, 0 AS node, 0 AS hops, [0] AS path UNION ALL SELECT start, b, hops + 1, list_append(path, b) FROM w JOIN e ON e.a = w.node WHERE hops < 4 AND NOT list_contains(path, b))
 SELECT start, node, hops, array_to_string(min(path), '>') AS path FROM w WHERE hops = (SELECT min(hops) FROM w v WHERE v.node = w.node) GROUP BY ALL""")
def shortest_paths(spark, sf_dir):
    start = table(spark, sf_dir, "nation").where("n_nationkey = 0").select("n_nationkey")
    return graph.shortest_paths(_ring(spark, sf_dir), "a", "b", start, 4).withColumn("path", graph.path_text())


def _ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"))
    edges = n.select("a", F.explode(F.array((F.col("a") * 2 + 1) % 25, (F.col("a") + 3) % 25)).alias("b"))
    return edges.where("a <> b").distinct()


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n.n_nationkey AS a, m.n_nationkey AS b FROM nation n JOIN nation m ON (m.n_nationkey = (n.n_nationkey * 2 + 1) % 25 OR m.n_nationkey = (n.n_nationkey + 3) % 25) AND n.n_nationkey <> m.n_nationkey),
 w AS (SELECT 0 AS node, 0 AS hops, [0] AS path UNION ALL SELECT b, hops + 1, list_append(path, b) FROM w JOIN e ON e.a = w.node WHERE hops < 5 AND node <> 7 AND NOT list_contains(path, b))
 SELECT array_to_string(path, '>') AS path, hops, 'confirmed' AS confidence FROM w WHERE node = 7""")
def bounded_paths(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    paths = graph.simple_paths(_ring(spark, sf_dir), "a", "b", nations.where("n_nationkey = 0"), nations.where("n_nationkey = 7"), 5)
    return paths.where("complete").select(graph.path_text().alias("path"), "hops", "confidence")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n.n_nationkey AS a, m.n_nationkey AS b FROM nation n JOIN nation m ON (m.n_nationkey = (n.n_nationkey * 2 + 1) % 25 OR m.n_nationkey = (n.n_nationkey + 3) % 25) AND n.n_nationkey <> m.n_nationkey),
 u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT 3 AS start, 3 AS node, 0 AS hops UNION SELECT start, b, hops + 1 FROM w JOIN u ON u.a = w.node WHERE hops < 2) SELECT start, node, min(hops) AS hops FROM w GROUP BY ALL""")
def neighbourhood(spark, sf_dir):
    start = table(spark, sf_dir, "nation").where("n_nationkey = 3").select("n_nationkey")
    return graph.neighbourhood(_ring(spark, sf_dir), "a", "b", start, 2)


@query("""WITH RECURSIVE ty AS (SELECT n_nationkey AS t, CASE WHEN n_nationkey > 0 THEN (n_nationkey - 1) // 2 END AS p FROM nation), m AS (SELECT n_nationkey AS t, 'm' || (n_nationkey % 4) AS member FROM nation),
 up AS (SELECT t, t AS d, 0 AS depth FROM ty UNION ALL SELECT up.t, ty.p, depth + 1 FROM up JOIN ty ON ty.t = up.d WHERE ty.p IS NOT NULL),
 e AS (SELECT up.t AS type_id, member, d AS declared_in, depth, row_number() OVER (PARTITION BY up.t, member ORDER BY depth) AS r FROM up JOIN m ON m.t = up.d)
 SELECT type_id, member, depth, declared_in FROM e WHERE r = 1""")
def inherited_members(spark, sf_dir):
    k = F.col("n_nationkey")
    types = table(spark, sf_dir, "nation").select(k.alias("type_id"), F.when(k > 0, F.floor((k - 1) / 2).cast("int")).alias("parent_id"))
    members = table(spark, sf_dir, "nation").select(k.alias("type_id"), F.concat(F.lit("m"), k % 4).alias("member"))
    return graph.inherited_members(types, members)[0].select("type_id", "member", "depth", "declared_in")


# Decision ladders


@query("""WITH u AS (SELECT p_partkey, count(*) FILTER (WHERE l_returnflag = 'R') AS writes, count(*) FILTER (WHERE l_returnflag = 'A') AS reads, count(*) FILTER (WHERE l_returnflag = 'N' AND l_quantity > 49) AS drops, p_type FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 40 GROUP BY p_partkey, p_type),
 r AS (SELECT p_partkey, CASE WHEN writes > 0 AND (reads > 0 OR drops > 0) THEN 'internal_intermediate/confirmed' WHEN writes > 0 THEN 'output_target/confirmed' WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 AND reads > 0 THEN 'internal_intermediate/probable' WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN 'external_or_shared_intermediate/probable' ELSE 'external_source/confirmed' END AS rc FROM u)
 SELECT p_partkey, split_part(rc, '/', 1) AS role, split_part(rc, '/', 2) AS confidence, split_part(rc, '/', 1) IN ('internal_intermediate', 'external_or_shared_intermediate') AS hidden_by_default FROM r""")
def relation_roles(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 40").groupBy(F.col("l_partkey").alias("p_partkey"))
    use = lines.agg(F.count_if(F.col("l_returnflag") == "R").alias("writes"), F.count_if(F.col("l_returnflag") == "A").alias("reads"), F.count_if((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 49)).alias("drops"))
    parts = table(spark, sf_dir, "part").select("p_partkey").join(use, "p_partkey", "left").fillna(0)
    k = F.col("p_partkey")
    role = rules.relation_role(F.lit("physical"), F.lit(True), F.col("writes"), F.col("reads"), F.col("drops"), k % 3 == 0, k % 2 == 0)
    return parts.select("p_partkey", role.alias("r")).select("p_partkey", "r.role", "r.confidence", F.col("r.role").isin(*rules.HIDDEN).alias("hidden_by_default"))


@query("""WITH s AS (SELECT l_suppkey, count(DISTINCT l_partkey) FILTER (WHERE l_quantity = 50) AS exact, count(DISTINCT l_linenumber) FILTER (WHERE l_quantity > 49) AS targets FROM lineitem GROUP BY l_suppkey)
 SELECT l_suppkey, CASE WHEN exact = 1 THEN 'strongly_supported' WHEN exact > 1 OR targets > 1 THEN 'ambiguous' WHEN targets = 1 THEN 'strongly_supported' ELSE 'unresolved' END AS status,
 CASE WHEN exact = 1 THEN 'executable_storage_join' WHEN exact > 1 OR targets > 1 THEN 'ambiguous' WHEN targets = 1 AND l_suppkey % 2 = 0 THEN 'executable_storage_join' WHEN targets = 1 THEN 'transformation_required' ELSE 'not_ready' END AS readiness FROM s""")
def join_readiness(spark, sf_dir):
    q = F.col("l_quantity")
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_distinct(F.when(q == 50, F.col("l_partkey"))).alias("exact"), F.count_distinct(F.when(q > 49, F.col("l_linenumber"))).alias("targets"))
    r = rules.join_readiness(F.col("exact"), F.col("targets"), F.col("targets"), F.col("l_suppkey") % 2 == 0, F.lit(0))
    return s.select("l_suppkey", r.alias("r")).select("l_suppkey", "r.*")


def queries() -> dict[str, Query]:
    from tracewright import catalog_queries, evidence, sample_queries  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from tracewright import catalog_queries, evidence, sample_queries  # noqa: F401

    return dict(_SQL)
