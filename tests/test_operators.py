import pytest
from pyspark.sql import functions as F

from tracewright.functions import ids, search
from tracewright.operators import aggregates, delta, graph, joins, ranking, rules
from tracewright.plans import paging


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_unique_or_ambiguous_keeps_every_fact_once(spark):
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "f int, k string")
    candidates = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), (None, "z")], "k string, id string")
    found = joins.unique_or_ambiguous(facts, candidates, "k", "id").select("f", "candidate_count", "status", "selected_id")
    assert rows(found, "f") == [(1, 1, "matched", "x"), (2, 2, "ambiguous", None), (3, 0, "unresolved", None), (4, 0, "unresolved", None)]
    gaps = joins.gaps(joins.unique_or_ambiguous(facts, candidates, "k", "id"), "f", "table")
    assert gaps.count() == 3 and gaps.select("gap_id").distinct().count() == 3


def test_first_tier_excludes_before_it_chooses(spark):
    facts = spark.createDataFrame([(1, "h", "/p"), (2, "h", "/q")], "id int, host string, path string")
    targets = spark.createDataFrame([(1, "h", "/p"), (9, "z", "/q")], "target int, host string, path string")
    tiers = [("host", targets.drop("path"), ["host"]), ("path", targets.drop("host"), ["path"])]
    found = joins.verdict(joins.first_tier(facts, "id", tiers, "target", F.col("id") == F.col("target")), facts, "id")
    assert rows(found.select("id", "tier", "status", "target_id"), "id") == [(1, None, "unresolved", None), (2, 1, "matched", 1)]


def test_either_endpoint_gives_each_edge_once(spark):
    edges = spark.createDataFrame([(1, 1, 2), (2, 3, 1), (3, 1, 1), (4, 5, 6)], "e int, a int, b int")
    found = joins.either_endpoint(edges, spark.createDataFrame([(1,)], "k int"), "a", "b", "k")
    assert sorted(r.e for r in found.collect()) == [1, 2, 3]


def test_best_or_tie_and_recommendation(spark):
    df = spark.createDataFrame([("g", 2, "x"), ("g", 2, "y"), ("h", 3, "z"), ("h", 1, "w"), ("i", 1, "q")], "k string, s int, t string")
    assert rows(ranking.best_or_tie(df, ["k"], ["s"], "t"), "k") == [("g", 2, None, "ambiguous"), ("h", 1, "z", "matched"), ("i", 1, "q", "matched")]
    assert rows(ranking.recommend(df, ["k"], ["s"], "t").select("k", "recommended", "status"), "k") == [("g", "x", "probable_tie_break"), ("h", "z", "probable_ranked"), ("i", "q", "confirmed_unique")]


def test_delta_sees_null_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, ""), (4, "n")], "k int, v string")
    assert rows(delta.keyed_delta(a, b, "k", ["v"]).select("k", "delta_kind"), "k") == [(2, "changed"), (3, "removed"), (4, "added")]


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", None)], "s string, t string")
    found = {(r.start, r.node): r.depth for r in graph.closure(edges, "s", "t").collect()}
    assert found[("a", "c")] == 2 and found[("a", "a")] == 3 and len(found) == 9


def test_components_keep_singletons_and_long_chains(spark):
    nodes = spark.createDataFrame([(i,) for i in range(42)], "n int")
    edges = spark.createDataFrame([(i, i + 1, "confirmed") for i in range(39)] + [(40, 40, "confirmed")], "a int, b int, confidence string")
    found = {r.node: r.component for r in graph.components(nodes, edges, "n", "a", "b").collect()}
    assert set(found[i] for i in range(40)) == {0} and found[40] == 40 and found[41] == 41


def test_paths_report_why_they_stop(spark):
    edges = spark.createDataFrame([("a", "b", "confirmed"), ("b", "c", "probable"), ("b", "a", "confirmed"), ("a", "d", "confirmed"), ("d", "a", "confirmed")], "s string, t string, confidence string")
    one = lambda x: spark.createDataFrame([(x,)], "n string")
    found = {tuple(r.path): (r.complete, r.stop_reason, r.confidence) for r in graph.simple_paths(edges, "s", "t", one("a"), one("c"), 5).collect()}
    assert found[("a", "b", "c")] == (True, None, "probable")
    assert found[("a", "d")] == (False, "cycle_prevented", "confirmed")
    short = graph.simple_paths(edges, "s", "t", one("a"), one("c"), 1).collect()
    assert {r.stop_reason for r in short} == {"max_hops_reached"}


def test_inherited_members_nearest_wins_and_conflicts_are_gaps(spark):
    types = spark.createDataFrame([("c", "a"), ("c", "b"), ("d", "c")], "type_id string, parent_id string")
    members = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y"), ("d", "y")], "type_id string, member string")
    effective, gaps = graph.inherited_members(types, members)
    assert ("c", "y", 1, "a") in rows(effective, "type_id", "member") and ("d", "y", 0, "d") in rows(effective, "type_id", "member")
    assert {(r.type_id, r.member) for r in gaps.collect()} == {("c", "x"), ("d", "x")}


def test_ladders(spark):
    role = rules.relation_role(F.col("k"), F.lit(True), F.col("w"), F.col("r"), F.lit(0), F.col("t"), F.lit(True))
    df = spark.createDataFrame([("cte", 0, 0, False), ("physical", 1, 1, False), ("physical", 1, 0, False), ("physical", 0, 2, True), ("physical", 0, 0, True), ("physical", 0, 5, False), ("odd", 0, 0, False)], "k string, w int, r int, t boolean")
    assert [tuple(r.x) for r in df.select(role.alias("x")).collect()] == [
        ("internal_intermediate", "confirmed"), ("internal_intermediate", "confirmed"), ("output_target", "confirmed"), ("internal_intermediate", "probable"),
        ("external_or_shared_intermediate", "probable"), ("external_source", "confirmed"), ("unknown", "unresolved"),
    ]


def test_identifiers(spark):
    df = spark.createDataFrame([("http://H.x:80/A/12/b?q#f", "  A  b ", '"S"."T" t')], "u string, t string, d string")
    got = df.select(ids.url_path(F.col("u")), ids.url_authority(F.col("u")), ids.normalize_text(F.col("t")), ids.normalize_db_identifier(F.col("d")), ids.path_suffixes(F.lit("/a/b"))).first()
    assert tuple(got) == ("/a/{}/b", "h.x", "a b", "s.t", ["/a/b", "/b"])
    a, b = spark.range(1).select(ids.stable_id("p", None, "x"), ids.stable_id("p", "", "x")).first()
    assert a == b and len(a) == 22


def test_pages_and_tokens(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "n%d" % (i % 2)) for i in range(6)], "id int, name string")
    first = paging.page_result(df, ["name", "id"], "q", {"a": 1}, 4)
    assert [x["id"] for x in first["items"]] == [0, 2, 4, 1] and first["total_count"] == 6
    second = paging.page_result(df, ["name", "id"], "q", {"a": 1}, 4, first["next_token"])
    assert [x["id"] for x in second["items"]] == [5, 3] and second["next_token"] is None
    with pytest.raises(ValueError):
        paging.page_result(df, ["name", "id"], "q", {"a": 2}, 4, first["next_token"])


def test_search_and_quality(spark):
    df = spark.createDataFrame([("Ab", None), ("x", "yab")], "a string, b string")
    assert df.where(search.token_search("AB", "a", "b")).count() == 2 and df.where(search.token_search("b_y", "a", "b")).count() == 0
    gold = spark.createDataFrame([("g", 1), ("g", 2)], "g string, k int")
    actual = spark.createDataFrame([("g", 2), ("g", 3), ("h", 9)], "g string, k int")
    assert rows(aggregates.quality_gate(gold, actual, ["g", "k"], "g").select("g", "tp", "fp", "fn", "recall"), "g") == [("g", 1, 1, 1, 0.5), ("h", 0, 1, 0, None)]
