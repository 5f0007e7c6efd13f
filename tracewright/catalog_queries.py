"""Registered queries of catalogs, reports, rules, scripts and workflows on the test tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import scripts
from tracewright.operators import catalogs, graph, models, rules
from tracewright.plans import workflow
from tracewright.queries import query, table

# Catalogs and commands


@query("""SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers,
 (SELECT count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = n_nationkey) AS orders, (SELECT count(*) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = n_nationkey) AS lines FROM nation""")
def nation_metrics(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    key = lambda df, column: df.select(F.col(column).alias("n_nationkey"))
    customer, supplier = t("customer"), t("supplier")
    orders = t("orders").select(F.col("o_custkey").alias("c_custkey")).join(customer, "c_custkey")
    lines = t("lineitem").select(F.col("l_suppkey").alias("s_suppkey")).join(supplier, "s_suppkey")
    metrics = {"customers": key(customer, "c_nationkey"), "suppliers": key(supplier, "s_nationkey"), "orders": key(orders, "c_nationkey"), "lines": key(lines, "s_nationkey")}
    return catalogs.per_key_counts(t("nation"), "n_nationkey", metrics)


@query("""WITH m AS (SELECT * FROM part WHERE p_type = 'PROMO' AND contains(lower(p_name || ' ' || p_brand), 'bolt'))
 SELECT p_partkey, p_name, (SELECT count(*) FROM m) AS total_count, (SELECT count(*) FROM m) > 20 AS truncated FROM m ORDER BY p_partkey LIMIT 20""")
def facts_by_type(spark, sf_dir):
    facts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", F.col("p_type").alias("fact_type"))
    return catalogs.found(catalogs.matching(facts, "BOLT", "PROMO", p_brand=None), ["p_partkey"], 20).select("p_partkey", "p_name", "total_count", "truncated")


@query("""SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 17""")
def keyed_detail(spark, sf_dir):
    facts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), "p_partkey", "p_name", "p_brand", F.lit("part").alias("fact_type"))
    return catalogs.matching(facts, None, "part", key="17").select("p_partkey", "p_name", "p_brand")


@query("""SELECT event_type, 'k' AS member, count(*) AS n, count(*) FILTER (WHERE json_extract_string(props, '$.k') IS NULL) AS n_null, 'integer' AS kinds, min(json_extract_string(props, '$.k')) AS least, max(json_extract_string(props, '$.k')) AS most
 FROM events WHERE json_exists(props, '$.k') GROUP BY event_type""")
def member_shapes(spark, sf_dir):
    return catalogs.shapes(table(spark, sf_dir, "events"), "props", ["event_type"])


@query("""SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""")
def json_members(spark, sf_dir):
    return catalogs.json_members(table(spark, sf_dir, "events"), "props", ["event_id"])


@query("""SELECT user_id, to_json(list(event_type ORDER BY event_id)) AS event_types, max(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)) AS most, count(TRY_CAST(event_type AS INTEGER)) AS n_numbers FROM events GROUP BY user_id""")
def json_lists(spark, sf_dir):
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"])
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.to_json(ordered).alias("event_types"), F.max(k).alias("most"), F.count(F.col("event_type").try_cast("int")).alias("n_numbers"))


@query("""SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
 UNION ALL SELECT 'except', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)""")
def set_operations(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("op"), "k")
        out = df if out is None else out.unionByName(df)
    return out


@query("""SELECT l_returnflag, count(*) AS n_pairs FROM (SELECT DISTINCT l_returnflag, l_partkey, l_suppkey FROM lineitem) GROUP BY l_returnflag""")
def distinct_sources(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", "l_suppkey").distinct().groupBy("l_returnflag").agg(F.count("*").alias("n_pairs"))


@query("""WITH r AS (SELECT p_brand AS table_name, p_type AS target FROM part), c AS (SELECT p_brand AS table_name, count(*) AS n_columns FROM part GROUP BY 1), k AS (SELECT p_brand AS table_name, count(*) AS n_keys, bool_or(p_size < 5) AS has_primary_key FROM part WHERE p_size < 10 GROUP BY 1),
 o AS (SELECT 'Brand#' || (1 + p_size % 25) AS table_name, count(*) AS n_incoming FROM part WHERE p_size > 25 GROUP BY 1), g AS (SELECT p_brand AS table_name, count(*) AS n_outgoing FROM part WHERE p_size > 25 GROUP BY 1)
 SELECT table_name, n_columns, coalesce(n_keys, 0) AS n_keys, coalesce(n_outgoing, 0) AS n_outgoing, coalesce(n_incoming, 0) AS n_incoming, coalesce(has_primary_key, false) AS has_primary_key FROM c LEFT JOIN k USING (table_name) LEFT JOIN g USING (table_name) LEFT JOIN o USING (table_name)""")
def table_catalog(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("table_name", F.col("p_brand"))
    keys = part.where("p_size < 10").select("table_name", F.when(F.col("p_size") < 5, "primary").otherwise("unique").alias("key_kind"))
    references = part.where("p_size > 25").select("table_name", F.concat(F.lit("Brand#"), 1 + F.col("p_size") % 25).alias("target_table"))
    return catalogs.table_catalog(part, keys, references)


@query("""SELECT c_mktsegment AS table_name, o_orderpriority AS target_table, count(*) AS n_references, string_agg(DISTINCT o_orderstatus, ';' ORDER BY o_orderstatus) AS columns FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def er_edges(spark, sf_dir):
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    references = both.select(F.col("c_mktsegment").alias("table_name"), F.col("o_orderstatus").alias("columns"), F.col("o_orderpriority").alias("target_table"))
    return catalogs.er_view(references)[1].drop("edge_id")


@query("""WITH RECURSIVE r AS (SELECT n_nationkey AS o, n_nationkey + 6 AS n FROM nation), w AS (SELECT o AS start, n AS "end", 1 AS steps FROM r WHERE o NOT IN (SELECT n FROM r) UNION ALL SELECT w.start, r.n, steps + 1 FROM w JOIN r ON r.o = w."end")
 SELECT start, "end", steps FROM w WHERE "end" NOT IN (SELECT o FROM r)""")
def rename_chains(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return catalogs.rename_chains(nation.select(F.col("n_nationkey").alias("old_name"), (F.col("n_nationkey") + 6).alias("new_name")))


@query("""SELECT *, CASE WHEN removed > 0 THEN 'high' WHEN changed > 0 THEN 'medium' WHEN added > 0 THEN 'low' ELSE 'none' END AS risk FROM (SELECT p_brand AS kind, count(*) FILTER (WHERE p_size < 20) AS added, count(*) FILTER (WHERE p_size > 48) AS removed, count(*) FILTER (WHERE p_size BETWEEN 20 AND 24) AS changed FROM part GROUP BY 1)""")
def change_impact(spark, sf_dir):
    size = F.col("p_size")
    change = F.when(size < 20, "added").when(size > 48, "removed").when(size.between(20, 24), "changed").otherwise("same")
    return catalogs.change_summary(table(spark, sf_dir, "part").select(F.col("p_brand").alias("kind"), change.alias("change")), "kind")


@query("""WITH RECURSIVE calls AS (SELECT n_nationkey AS a, (n_nationkey * 2 + 1) % 25 AS b FROM nation), w AS (SELECT n_nationkey AS s, n_nationkey AS cur, 0 AS h FROM nation UNION SELECT s, b, h + 1 FROM w JOIN calls ON a = cur WHERE h < 4),
 wr AS (SELECT s, 's' || s_nationkey AS store, min(h) AS hops FROM w JOIN supplier ON s_nationkey = cur GROUP BY 1, 2), rd AS (SELECT 's' || (c_nationkey * 2) AS store, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY 1)
 SELECT n_nationkey AS ingress, wr.store, wr.hops, coalesce(rd.n, 0) AS n_readers, CASE WHEN wr.store IS NOT NULL AND rd.n > 0 THEN 'complete' WHEN wr.store IS NOT NULL THEN 'written' WHEN n_nationkey IN (SELECT s FROM w WHERE h > 0 AND cur <> s) THEN 'called' ELSE 'open' END AS maturity
 FROM nation LEFT JOIN wr ON s = n_nationkey LEFT JOIN rd USING (store)""")
def persistence_cases(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    calls = n.select(k.alias("caller"), ((k * 2 + 1) % 25).cast("int").alias("callee"))
    writes = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("operation"), F.concat(F.lit("s"), "s_nationkey").alias("store"))
    reads = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("operation"), F.concat(F.lit("s"), F.col("c_nationkey") * 2).alias("store"))
    return catalogs.persistence_cases(n.select(k.alias("operation")), calls, writes, reads)


@query("""SELECT section, place, item, domain, n_items, n_domains FROM (SELECT r_name AS section, row_number() OVER (PARTITION BY r_name ORDER BY n_name, n_nationkey) AS place, n_name AS item, n_nationkey AS domain, count(*) OVER (PARTITION BY r_name) AS n_items, count(*) OVER (PARTITION BY r_name) AS n_domains FROM nation JOIN region ON r_regionkey = n_regionkey) WHERE place <= 3""")
def navigation(spark, sf_dir):
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return catalogs.navigation(both.select(F.col("r_name").alias("section"), F.col("n_name").alias("item"), F.col("n_nationkey").alias("domain")), "section", "domain", "item", 3)


_REPORT = """WITH a AS ({facts}), s AS (SELECT section, item, {measure} AS amount FROM a GROUP BY 1, 2) SELECT section, place, item, amount, share FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY amount DESC, item) AS place, round(CAST(amount AS DOUBLE) / sum(amount) OVER (PARTITION BY section), 6) AS share FROM s) WHERE place <= {top}"""


@query(_REPORT.format(facts="SELECT l_returnflag AS section, p_brand AS item, CAST(l_quantity AS BIGINT) AS q FROM lineitem JOIN part ON p_partkey = l_partkey", measure="CAST(sum(q) AS BIGINT)", top=3))
def report_reference_data(spark, sf_dir):
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return catalogs.report_sections(both.select(F.col("l_returnflag").alias("section"), F.col("p_brand").alias("item"), F.col("l_quantity").cast("long").alias("q")), "section", F.sum("q"), "item", 3)


@query(_REPORT.format(facts="SELECT r_name AS section, c_mktsegment AS item FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey", measure="count(*)", top=4))
def report_system_description(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    both = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return catalogs.report_sections(both.select(F.col("r_name").alias("section"), F.col("c_mktsegment").alias("item")), "section", F.count("*"), "item", 4)


@query("""WITH b AS (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier), a AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer) SELECT coalesce(b.k, a.k) AS k, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS state FROM b FULL JOIN a ON a.k = b.k""")
def compare_reports(spark, sf_dir):
    before = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"))
    after = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    return catalogs.compare_reports(before, after, ["k"])


@query("""SELECT n_nationkey AS node, CASE WHEN n_nationkey < 23 THEN CAST(floor(log2(n_nationkey + 1)) AS INTEGER) END AS level FROM nation""")
def plan_order(spark, sf_dir):
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation")
    needs = n.where(k > 0).select(k.alias("node"), F.floor((k - 1) / 2).cast("int").alias("needed"))
    circle = n.where(k > 22).select(k.alias("node"), (47 - k).alias("needed"))  # 23 and 24 need each other
    return catalogs.topological_order(n.select(k.alias("node")), needs.unionByName(circle))


@query("""SELECT c_custkey AS product_id, c_custkey AS source_id, CASE WHEN s_suppkey IS NULL THEN 'source_unavailable' WHEN c_nationkey = s_nationkey THEN 'up_to_date' ELSE 'update_available' END AS freshness_status FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def freshness(spark, sf_dir):
    published = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("product_id"), F.col("c_custkey").alias("source_id"), F.col("c_nationkey").alias("snapshot"))
    return catalogs.freshness(published, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").alias("snapshot")))


@query("""SELECT user_id, event_type, event_id, n - 1 AS n_replaced FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE r = 1""")
def latest_definitions(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return catalogs.latest_definitions(events, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("""SELECT 'p' || s_suppkey AS table_name, c_custkey AS column_name FROM supplier JOIN customer ON c_nationkey = s_nationkey""")
def partition_columns(spark, sf_dir):
    children = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), "s_suppkey").alias("child"), F.col("s_nationkey").alias("parent"))
    columns = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("table_name"), F.col("c_custkey").alias("column_name"))
    return catalogs.partition_children(children, columns).select("table_name", "column_name")


@query("""WITH w AS (SELECT DISTINCT '${env}.T' || (c_custkey % 40) AS name, 't' || (c_custkey % 40) AS t FROM customer), g AS (SELECT DISTINCT 'mart' || (s_suppkey % 2) || '.t' || (s_suppkey % 30) AS known, 't' || (s_suppkey % 30) AS t FROM supplier)
 SELECT name, count(known) AS candidate_count, CASE count(known) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE count(known) WHEN 1 THEN min(known) END AS known_name FROM w LEFT JOIN g USING (t) GROUP BY name""")
def schema_placeholders(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit("${env}.T"), F.col("c_custkey") % 40).alias("name"))
    s = F.col("s_suppkey")
    return catalogs.resolve_schemas(names, table(spark, sf_dir, "supplier").select(F.concat(F.lit("mart"), s % 2, F.lit(".t"), s % 30).alias("name")))


# Correspondences, rules and graphs


@query("""SELECT n_nationkey AS rule_id, CASE WHEN n_nationkey % 2 = 0 THEN 'type' ELSE 'field' END AS level, 'Brand#' || n_nationkey AS name, count(*) AS n FROM nation JOIN part ON 'Brand#' || n_nationkey = CASE WHEN n_nationkey % 2 = 0 THEN p_brand ELSE 'Brand#' || p_size END GROUP BY ALL""")
def directive_matches(spark, sf_dir):
    k = F.col("n_nationkey")
    wanted = table(spark, sf_dir, "nation").select(k.alias("rule_id"), F.when(k % 2 == 0, "type").otherwise("field").alias("level"), F.concat(F.lit("Brand#"), k).alias("name"))
    part = table(spark, sf_dir, "part")
    return catalogs.directive_matches(wanted, part.select(F.col("p_brand").alias("type_name")), part.select(F.concat(F.lit("Brand#"), "p_size").alias("field_name")))


@query("""WITH t AS (SELECT DISTINCT event_type AS full_name, event_type || (CASE WHEN event_type IN ('view', 'click') THEN user_id % 2 ELSE 0 END) AS type_id FROM events WHERE event_type <> 'error'), p AS (SELECT full_name, count(*) AS n, min(type_id) AS sole FROM t GROUP BY 1)
 SELECT event_id AS value_id, event_type AS value, n AS n_types, CASE WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN sole END AS type_id FROM events JOIN p ON full_name = event_type""")
def named_values(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    half = F.when(F.col("event_type").isin("view", "click"), F.col("user_id") % 2).otherwise(0)
    types = events.where("event_type <> 'error'").select(F.col("event_type").alias("full_name"), F.concat("event_type", half).alias("type_id")).distinct()
    return catalogs.named_values(events.select(F.col("event_id").alias("value_id"), F.col("event_type").alias("value")), types)


@query("""SELECT c_nationkey, c_mktsegment, count(*) AS n_boundaries, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY CAST(c_custkey AS VARCHAR)) AS interfaces, 'boundary_' || substr(sha256(coalesce(CAST(c_nationkey AS VARCHAR), '') || chr(31) || c_mktsegment), 1, 20) AS boundary_id FROM customer GROUP BY 1, 2""")
def composed_boundaries(spark, sf_dir):
    return catalogs.composed_boundaries(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey")


@query("""SELECT c_nationkey AS source_repo, s_nationkey AS target_repo, count(*) AS n_calls, CASE WHEN bool_and(l_quantity > 10) THEN 'confirmed' ELSE 'probable' END AS confidence FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R' GROUP BY 1, 2""")
def interaction_edges(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_nationkey")
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    calls = lines.select(F.col("c_nationkey").alias("repo_id"), F.col("l_suppkey").alias("target_id"), F.when(F.col("l_returnflag") == "R", "matched").otherwise("unresolved").alias("status"), F.when(F.col("l_quantity") > 10, "confirmed").otherwise("probable").alias("confidence"))
    interfaces = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("interface_id"), F.col("s_nationkey").alias("repo_id"))
    return catalogs.interaction_graph(calls, interfaces)[1]


@query("""WITH o AS (SELECT DISTINCT user_id AS object_id, nullif(event_type, 'view') AS file, CASE WHEN event_id % 4 = 1 AND event_type <> 'view' THEN event_id END AS line FROM events), r AS (SELECT *, CASE WHEN line IS NOT NULL THEN 2 WHEN file IS NOT NULL THEN 1 ELSE 0 END AS r FROM o),
 b AS (SELECT *, max(r) OVER (PARTITION BY object_id) AS m, count(*) OVER (PARTITION BY object_id) AS n FROM r), f AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY file, line) AS k FROM b WHERE r = m)
 SELECT object_id, CASE m WHEN 2 THEN 'line' WHEN 1 THEN 'file' ELSE 'none' END AS localization, n AS n_occurrences, file, line FROM f WHERE k = 1""")
def occurrence_graph(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    named = F.col("event_type") != "view"
    return catalogs.occurrence_graph(e.select(F.col("user_id").alias("object_id"), F.when(named, F.col("event_type")).alias("file"), F.when(named & (F.col("event_id") % 4 == 1), F.col("event_id")).alias("line")))


@query("""WITH f AS (SELECT p_partkey AS type_id, p_name AS field, (p_partkey * 3) % 300 AS target_type, p_type AS cardinality FROM part), s AS (SELECT c_custkey % 700 AS type_id, count(DISTINCT c_mktsegment) AS n, min(c_mktsegment) AS sole FROM customer GROUP BY 1), d AS (
 SELECT f.*, n, sole, CASE WHEN t.p_partkey IS NULL THEN 'target_type_unknown' WHEN n IS NULL THEN 'storage_evidence_missing' WHEN n > 1 THEN 'several_storage_kinds' ELSE 'stored' END AS diagnosis FROM f LEFT JOIN part t ON t.p_partkey = target_type LEFT JOIN s ON s.type_id = f.type_id)
 SELECT type_id, field, target_type, cardinality, CASE WHEN diagnosis = 'stored' THEN sole END AS storage_kind, diagnosis FROM d""")
def relationship_diagnosis(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    fields = part.select(F.col("p_partkey").alias("type_id"), F.col("p_name").alias("field"), ((F.col("p_partkey") * 3) % 300).alias("target_type"), F.col("p_type").alias("cardinality"))
    kept = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 700).alias("type_id"), F.col("c_mktsegment").alias("storage_kind"))
    kept = kept.join(fields.select("type_id", "field"), "type_id")
    return catalogs.relationships(fields, part.select(F.col("p_partkey").alias("type_id")), kept).drop("relationship_id")


@query("""WITH u AS (SELECT o_custkey + 5 AS object_id, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_reads, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_writes FROM orders GROUP BY 1)
 SELECT coalesce(c_custkey, object_id) AS object_id, coalesce(n_reads, 0) AS n_reads, coalesce(n_writes, 0) AS n_writes, CASE WHEN c_custkey IS NULL THEN 'undeclared' WHEN n_reads > 0 AND n_writes > 0 THEN 'used' WHEN n_writes > 0 THEN 'written_only' WHEN n_reads > 0 THEN 'read_only' ELSE 'unused' END AS status FROM customer FULL JOIN u ON object_id = c_custkey""")
def storage_usage(spark, sf_dir):
    access = F.when(F.col("o_orderstatus") == "F", "read").when(F.col("o_orderstatus") == "P", "write").otherwise("none")
    used = table(spark, sf_dir, "orders").select((F.col("o_custkey") + 5).alias("object_id"), access.alias("access"))
    return catalogs.storage_usage(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("object_id")), used)


@query("""WITH s AS (SELECT l_suppkey, count(*) FILTER (WHERE l_quantity = 50) AS c, count(*) FILTER (WHERE l_quantity = 49) AS d, count(*) FILTER (WHERE l_quantity = 48) AS t FROM lineitem GROUP BY 1), m AS (SELECT *, CASE WHEN l_suppkey % 11 = 0 THEN 'resolve_reference_collection' WHEN l_suppkey % 7 = 0 THEN 'derive_source_identity_from_target_key'
 WHEN c > 8 THEN 'resolve_reference_value_to_target_key' WHEN l_suppkey % 5 = 0 THEN 'equals' WHEN d > 0 AND t > 0 THEN 'resolve_reference_value_to_target_key' ELSE 'not_established' END AS method,
 CASE WHEN l_suppkey % 11 = 0 OR l_suppkey % 7 = 0 OR c > 8 OR l_suppkey % 5 = 0 THEN 'confirmed' WHEN d > 0 AND t > 0 THEN 'strongly_supported' ELSE 'unresolved' END AS confidence FROM s)
 SELECT l_suppkey, method, confidence, CASE WHEN method = 'resolve_reference_collection' THEN 'unresolved_requires_subtype_or_representation' WHEN method = 'equals' THEN 'direct_candidate_requires_physical_representation_check' WHEN method = 'not_established' THEN 'unresolved' ELSE 'transformation_required' END AS readiness,
 CASE WHEN method = 'not_established' THEN 'unresolved' WHEN method = 'resolve_reference_collection' THEN 'ambiguity' WHEN l_suppkey % 13 = 0 THEN 'confirmed' WHEN method = 'derive_source_identity_from_target_key' AND l_suppkey % 2 = 0 THEN 'strongly_supported'
 WHEN method = 'resolve_reference_value_to_target_key' AND confidence = 'confirmed' AND t > 0 THEN 'strongly_supported' ELSE 'probable' END AS usefulness FROM m""")
def extension_joins(spark, sf_dir):
    q, k = F.col("l_quantity"), F.col("l_suppkey")
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(q == 50).alias("c"), F.count_if(q == 49).alias("d"), F.count_if(q == 48).alias("t"))
    joined = s.withColumn("j", rules.extension_join(k % 11 == 0, k % 7 == 0, F.when(F.col("c") > 8, F.col("c")).otherwise(0), k % 5 == 0, F.col("d"), F.col("t")))
    use = rules.usefulness(F.col("j.method"), F.col("j.confidence"), k % 11 == 0, k % 13 == 0, k % 2 == 0, F.col("t"))
    return joined.select("l_suppkey", "j.*", use.alias("usefulness"))


@query("""SELECT p_brand, count(*) AS n, CASE WHEN bool_or(p_size > 49) THEN 'unknown_primitive' ELSE 'none' END AS discovery_kind, round(avg(p_size) / 50.0, 6) AS salience_score FROM part GROUP BY p_brand""")
def discovery(spark, sf_dir):
    families = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.bool_or(F.col("p_size") > 49).alias("outside"), F.avg("p_size").alias("size"))
    return catalogs.salience(families, F.round(F.col("size") / 50.0, 6), F.col("outside")).drop("outside", "size")


# Scripts and workflows


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'a: {{ x }}' WHEN 'click' THEN '- {{y}} # note' ELSE 'b: "{{z}}"' END AS text, CASE event_type WHEN 'view' THEN 'a: "{{ x }}"' WHEN 'click' THEN '- "{{y}}" # note' ELSE 'b: "{{z}}"' END AS quoted FROM events""")
def quoted_templates(spark, sf_dir):
    text = F.when(F.col("event_type") == "view", "a: {{ x }}").when(F.col("event_type") == "click", "- {{y}} # note").otherwise('b: "{{z}}"')
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"), scripts.quote_bare_templates(text).alias("quoted"))


@query("""WITH n AS (SELECT event_id, event_type || (['_id', '_status', '_created', '_hash', '_dt'])[1 + user_id % 5] AS name FROM events),
 c AS (SELECT event_id, name, [CASE WHEN regexp_matches(name, 'id|key|ucp|object|entity|client|profile|account|card|phone|agreement|correlation|event') THEN 'identifier_or_key_candidate' END, CASE WHEN regexp_matches(name, 'status|state|result|error|reason|code|success|fail|reject') THEN 'status_result_or_error_candidate' END,
 CASE WHEN regexp_matches(name, 'dt|date|time|valid|effective|load|created|updated|business') THEN 'date_time_or_temporal_candidate' END, CASE WHEN regexp_matches(name, 'created_by|updated_by|deleted|actual|version|hash|source') THEN 'audit_version_or_lifecycle_candidate' END, CASE WHEN contains(name, 'partition') THEN 'partition_or_slice_candidate' END] AS l FROM n)
 SELECT event_id, name, array_to_string(list_filter(l, lambda x: x IS NOT NULL), ',') AS classes FROM c""")
def field_classes(spark, sf_dir):
    end = F.element_at(F.array(*[F.lit(x) for x in ("_id", "_status", "_created", "_hash", "_dt")]), (1 + F.col("user_id") % 5).cast("int"))
    named = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", end).alias("name"))
    return named.select("event_id", "name", F.array_join(scripts.field_classes(F.col("name")), ",").alias("classes"))


@query("""SELECT n_nationkey, n_name || ',' || 'it''s' AS literals FROM nation""")
def check_literals(spark, sf_dir):
    condition = F.concat(F.lit("(name IN ('"), "n_name", F.lit("', 'it''s'))"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(scripts.check_values(condition), ",").alias("literals"))


@query("""WITH f AS (SELECT 'sql/' || (page_id % 9) || '/load_' || (page_id % 21) || '.sql' AS file FROM pages GROUP BY 1), t AS (SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN '${env}/load_' ELSE 'sql/3/load_' END || n_nationkey || '.sql' AS template, n_nationkey % 2 = 0 AS dynamic, n_nationkey AS k FROM nation),
 m AS (SELECT template, dynamic, file FROM t LEFT JOIN f ON CASE WHEN dynamic THEN ends_with(file, 'load_' || k || '.sql') ELSE file = template OR ends_with(file, template) END)
 SELECT template, count(file) AS candidate_count, CASE count(file) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE count(file) WHEN 1 THEN min(file) END AS file, CASE WHEN count(file) = 0 THEN NULL WHEN dynamic THEN 'fixed_end' ELSE 'exact_path' END AS basis FROM m GROUP BY template, dynamic""")
def template_files(spark, sf_dir):
    page, k = F.col("page_id"), F.col("n_nationkey")
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("sql/"), page % 9, F.lit("/load_"), page % 21, F.lit(".sql")).alias("file"))
    templates = table(spark, sf_dir, "nation").select(F.concat(F.when(k % 2 == 0, "${env}/load_").otherwise("sql/3/load_"), k, F.lit(".sql")).alias("template"))
    return scripts.match_files(templates, files)


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey + 3) % 25 AS b FROM nation), w AS (SELECT n_nationkey AS workflow, n_nationkey AS file, 0 AS hops FROM nation UNION SELECT workflow, b, hops + 1 FROM w JOIN e ON a = file WHERE hops < 12)
 SELECT workflow, file, min(hops) AS hops FROM w GROUP BY 1, 2""")
def workflow_files(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    return workflow.reachable_files(n.select(k.alias("source_file"), ((k + 3) % 25).cast("int").alias("target_file")), n.select(k.alias("workflow")))


@query("""WITH u AS (SELECT DISTINCT c_nationkey AS workflow, c_mktsegment AS context, 'p' || (c_custkey % 4) AS name FROM customer), b AS (SELECT DISTINCT s_nationkey AS workflow, CASE WHEN s_suppkey % 3 = 0 THEN 'BUILDING' ELSE 'x' END AS context, 'p' || (s_suppkey % 4) AS name, 'v' || (s_suppkey % 2) AS value FROM supplier),
 n AS (SELECT workflow, context, name, count(*) AS n, min(value) AS v FROM b GROUP BY ALL), f AS (SELECT workflow, name, count(DISTINCT value) AS n, min(value) AS v FROM b GROUP BY ALL)
 SELECT u.workflow, u.context, u.name, coalesce(n.n, f.n, 0) AS candidate_count, CASE coalesce(n.n, f.n, 0) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n.n IS NOT NULL THEN 'same_context' WHEN f.n IS NOT NULL THEN 'same_workflow' END AS basis,
 CASE WHEN coalesce(n.n, f.n) = 1 THEN coalesce(n.v, f.v) END AS value FROM u LEFT JOIN n USING (workflow, context, name) LEFT JOIN f USING (workflow, name)""")
def placeholder_values(spark, sf_dir):
    s = F.col("s_suppkey")
    uses = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("workflow"), F.col("c_mktsegment").alias("context"), F.concat(F.lit("P"), F.col("c_custkey") % 4).alias("name"))
    bindings = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("workflow"), F.when(s % 3 == 0, "BUILDING").otherwise("x").alias("context"), F.concat(F.lit("p"), s % 4).alias("name"), F.concat(F.lit("v"), s % 2).alias("value"))
    return workflow.resolve_placeholders(uses, bindings)


@query("""SELECT n_nationkey AS workflow, 'c' AS context, 'select ${a} from ${B}.t where ${c}' AS template, 'select ' || CASE WHEN n_regionkey < 3 THEN n_name ELSE '${a}' END || ' from mart.t where ${c}' AS filled FROM nation""")
def filled_templates(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "workflow")
    rows = n.select("workflow", F.lit("c").alias("context"), F.lit("select ${a} from ${B}.t where ${c}").alias("template"))
    named = n.select("workflow", F.lit("c").alias("context"), F.lit("a").alias("name"), F.when(F.col("n_regionkey") < 3, F.col("n_name")).alias("value"))
    given = named.unionByName(n.select("workflow", F.lit("c").alias("context"), F.lit("b").alias("name"), F.lit("mart").alias("value")))
    return workflow.fill_templates(rows, given.withColumn("status", F.when(F.col("value").isNull(), "unresolved").otherwise("resolved")), "template")


@query("""WITH p AS (SELECT p_partkey AS object_id, lower(p_brand) AS k FROM part), r AS (SELECT 'brand#' || (n_nationkey * 2) AS k, count(*) AS n FROM nation GROUP BY 1), t AS (SELECT 'brand#' || (c_custkey * 3 // 2) AS k, count(*) AS n, min(c_custkey) AS sole FROM customer GROUP BY 1)
 SELECT object_id, CASE WHEN t.n > 1 THEN 'ambiguous' WHEN t.n = 1 AND r.n > 0 THEN 'matched' WHEN t.n = 1 THEN 'stored_not_read' WHEN r.n > 0 THEN 'read_not_stored' ELSE 'unresolved' END AS status, coalesce(r.n, 0) AS n_reads, coalesce(t.n, 0) AS n_tables, CASE WHEN t.n = 1 THEN sole END AS table_id FROM p LEFT JOIN r USING (k) LEFT JOIN t USING (k)""")
def cross_artifact_mapping(spark, sf_dir):
    storage = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("object_id"), F.col("p_brand").alias("table_name"))
    relations = table(spark, sf_dir, "nation").select(F.concat(F.lit("BRAND#"), F.col("n_nationkey") * 2).alias("relation_name"))
    physical = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("table_id"), F.concat(F.lit('"Brand#'), F.floor(F.col("c_custkey") * 3 / 2), F.lit('"')).alias("name"))
    return workflow.storage_to_sql(storage, relations, physical)


# Models and reports


_TREE = "ty AS (SELECT n_nationkey AS t, CASE WHEN n_nationkey = 23 THEN 24 WHEN n_nationkey = 24 THEN 23 WHEN n_nationkey > 0 THEN (n_nationkey - 1) // 2 END AS p FROM nation)"


def _types(spark, sf_dir):
    """A heap of types in which 23 and 24 are each other's parents."""
    k = F.col("n_nationkey")
    parent = F.when(k == 23, 24).when(k == 24, 23).when(k > 0, F.floor((k - 1) / 2).cast("int"))
    return table(spark, sf_dir, "nation").select(k.alias("type_id"), parent.alias("parent_id"))


def _model(spark, sf_dir):
    k = F.col("n_nationkey")
    kind = F.when(k % 3 == 0, F.concat(F.lit("List<"), (k + 1) % 30, F.lit(">"))).otherwise(((k + 2) % 30).cast("string"))
    fields = table(spark, sf_dir, "nation").select(k.alias("type_id"), F.concat(F.lit("m"), k % 4).alias("member"), kind.alias("declared_type"))
    return models.declared_model(_types(spark, sf_dir), fields)


_EFFECTIVE = f"""WITH RECURSIVE {_TREE}, up AS (SELECT t, t AS d, 0 AS depth FROM ty UNION ALL SELECT up.t, ty.p, depth + 1 FROM up JOIN ty ON ty.t = up.d WHERE ty.p IS NOT NULL AND ty.p <> up.t AND depth < 9),
 e AS (SELECT up.t, 'm' || (d % 4) AS member, d, depth, row_number() OVER (PARTITION BY up.t, 'm' || (d % 4) ORDER BY depth) AS r FROM up),
 f AS (SELECT t AS type_id, member, d AS declared_in, depth, CASE WHEN d % 3 = 0 THEN 'List<' || ((d + 1) % 30) || '>' ELSE CAST((d + 2) % 30 AS VARCHAR) END AS declared_type FROM e WHERE r = 1)"""


@query(_EFFECTIVE + " SELECT type_id, member, declared_in, declared_type FROM f")
def declared_fields(spark, sf_dir):
    return _model(spark, sf_dir)["fields"].select("type_id", "member", "declared_in", "declared_type")


@query(_EFFECTIVE + """ SELECT type_id, member, regexp_extract(declared_type, '([0-9]+)', 1) AS target_type, CASE WHEN declared_type LIKE 'List%' THEN 'many' ELSE 'one' END AS cardinality FROM f WHERE CAST(regexp_extract(declared_type, '([0-9]+)', 1) AS INTEGER) < 25""")
def declared_associations(spark, sf_dir):
    return _model(spark, sf_dir)["associations"].select("type_id", "member", "target_type", "cardinality")


@query("SELECT n_nationkey AS type_id, NULL::VARCHAR AS member, 'inheritance_cycle' AS gap_kind FROM nation WHERE n_nationkey > 22")
def declared_gaps(spark, sf_dir):
    return _model(spark, sf_dir)["gaps"]


@query(f"""WITH RECURSIVE {_TREE}, up AS (SELECT t, p AS a, 1 AS depth FROM ty WHERE p IS NOT NULL UNION SELECT up.t, ty.p, depth + 1 FROM up JOIN ty ON ty.t = up.a WHERE ty.p IS NOT NULL AND depth < 9), m AS (SELECT t, a, min(depth) AS depth FROM up WHERE t <> a GROUP BY 1, 2)
 SELECT a AS type_id, count(*) AS n_descendants, max(depth) AS depth FROM m GROUP BY a""")
def type_descendants(spark, sf_dir):
    return _model(spark, sf_dir)["descendants"]


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation UNION SELECT n_nationkey, (n_nationkey + 5) % 25 FROM nation), w AS (SELECT [n_nationkey] AS p, n_nationkey AS cur FROM nation UNION ALL SELECT list_append(p, b), b FROM w JOIN e ON a = cur WHERE len(p) < 5 AND NOT list_contains(p, b))
 SELECT array_to_string(p, '>') AS path, len(p) - 1 AS hops, CASE WHEN len(p) = 5 THEN 'max_hops_reached' ELSE 'cycle_prevented' END AS stop_reason FROM w WHERE len(p) = 5 OR NOT EXISTS (SELECT 1 FROM e WHERE a = cur AND NOT list_contains(p, b))""")
def type_paths(spark, sf_dir):
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    edges = n.select(k.alias("type_id"), ((k * 3 + 1) % 25).cast("int").alias("target_type")).unionByName(n.select(k.alias("type_id"), ((k + 5) % 25).cast("int").alias("target_type")))
    return models.type_paths(edges, n.select(k.alias("type_id")), 4).select(graph.path_text().alias("path"), "hops", "stop_reason")


@query("""SELECT record_kind, status, count(*) AS n FROM (SELECT event_type AS record_kind, CASE WHEN event_type = 'view' THEN CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'missing_k' ELSE 'loaded' END WHEN event_type = 'click' THEN 'missing_absent' ELSE 'unknown_kind' END AS status FROM events) GROUP BY ALL""")
def storage_semantics(spark, sf_dir):
    records = table(spark, sf_dir, "events").select(F.col("event_id").alias("record_id"), F.col("event_type").alias("record_kind"), F.col("props").alias("payload"))
    return models.typed_records(records, {"view": ["k"], "click": ["k", "absent"]}).groupBy("record_kind", "status").agg(F.count("*").alias("n"))


@query("""SELECT event_id, event_type FROM events WHERE contains(lower(event_type || ' ' || props), '"k": 42}') ORDER BY event_id LIMIT 25""")
def subject_records(spark, sf_dir):
    records = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    text = F.lower(F.concat_ws(" ", "event_type", "props"))
    return records.where(F.contains(text, F.lit('"k": 42}'))).orderBy("event_id").limit(25).select("event_id", "event_type")


@query("""WITH a AS (SELECT DISTINCT p_brand AS l, lower(p_brand) AS k FROM part), b AS (SELECT DISTINCT '"BRAND#' || (s_suppkey % 30) || CASE WHEN s_suppkey % 2 = 0 THEN '"' ELSE '" t' END AS r, 'brand#' || (s_suppkey % 30) AS k FROM supplier), n AS (SELECT k, count(*) AS n FROM b GROUP BY k)
 SELECT l AS left_name, r AS right_name, n AS candidate_count, CASE WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status FROM a JOIN n USING (k) JOIN b USING (k)""")
def name_correspondences(spark, sf_dir):
    s = F.col("s_suppkey")
    right = table(spark, sf_dir, "supplier").select(F.concat(F.lit('"BRAND#'), s % 30, F.when(s % 2 == 0, '"').otherwise('" t')).alias("name"))
    return models.correspondences(table(spark, sf_dir, "part"), right, "p_brand", "name")


@query("""WITH s AS (SELECT s_nationkey, CASE s_suppkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'probable' WHEN 2 THEN 'ambiguity' ELSE 'unresolved' END AS usefulness, 'm' || (s_suppkey % 3) AS method, CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 5 END AS r FROM supplier), b AS (SELECT *, min(r) OVER (PARTITION BY s_nationkey) AS b FROM s)
 SELECT s_nationkey, count(*) AS n_joins, count(*) FILTER (WHERE usefulness = 'confirmed') AS confirmed, CAST(0 AS BIGINT) AS strongly_supported, count(*) FILTER (WHERE usefulness = 'probable') AS probable, count(*) FILTER (WHERE usefulness = 'ambiguity') AS ambiguity, count(*) FILTER (WHERE usefulness = 'unresolved') AS unresolved,
 min(usefulness) FILTER (WHERE r = b) AS best, string_agg(DISTINCT method, ',' ORDER BY method) FILTER (WHERE r = b) AS best_methods FROM b GROUP BY s_nationkey""")
def extension_context(spark, sf_dir):
    k = F.col("s_suppkey")
    use = F.element_at(F.array(*[F.lit(u) for u in ("confirmed", "probable", "ambiguity", "unresolved")]), (k % 4 + 1).cast("int"))
    joined = table(spark, sf_dir, "supplier").select("s_nationkey", use.alias("usefulness"), F.concat(F.lit("m"), k % 3).alias("method"))
    return models.extension_context(joined, "s_nationkey")


@query("""WITH c AS (SELECT c_nationkey AS repo_id, count(*) AS n_calls, count(*) FILTER (WHERE o_orderstatus <> 'F') AS n_unmatched FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) SELECT repo_id, n_calls, n_unmatched, round(n_unmatched / n_calls, 6) AS share FROM c WHERE n_unmatched > 0""")
def report_interactions(spark, sf_dir):
    calls = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("interface_id"), F.col("c_nationkey").alias("repo_id"), F.when(F.col("o_orderstatus") == "F", "matched").otherwise("unresolved").alias("status"))
    return models.unmatched_interactions(calls.drop("status"), calls)


@query("""SELECT *, CAST(sum(n) OVER (PARTITION BY section) AS BIGINT) AS whole, 'line_' || substr(sha256(section || chr(31) || status), 1, 20) AS line_id FROM (SELECT c_mktsegment AS section, o_orderstatus AS status, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)""")
def report_statuses(spark, sf_dir):
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return models.status_report(both.select(F.col("c_mktsegment").alias("section"), F.col("o_orderstatus").alias("status")), "section", "status")


@query("""SELECT 'fact' AS entry, 'parts' AS kind, count(*) AS n, NULL AS limitation FROM part UNION ALL SELECT 'fact', 'suppliers', count(*), NULL FROM supplier UNION ALL SELECT 'gap', event_type, count(*), CASE event_type WHEN 'error' THEN 'source_failed' ELSE 'unclassified' END FROM events WHERE event_type IN ('error', 'click') GROUP BY event_type""")
def analysis_coverage(spark, sf_dir):
    gaps = table(spark, sf_dir, "events").where("event_type in ('error', 'click')").select(F.col("event_type").alias("gap_kind"))
    return models.analysis_coverage({"parts": table(spark, sf_dir, "part"), "suppliers": table(spark, sf_dir, "supplier")}, gaps, {"error": "source_failed"})
