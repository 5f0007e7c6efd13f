from tracewright.operators import graph
from tracewright.plans import lineage


def test_closure_has_no_last_depth(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(102)], "a string, b string").coalesce(1)
    got = graph.closure(edges, "a", "b")
    assert got.count() == 102 * 103 // 2 and [tuple(r) for r in got.where("depth = 102").collect()] == [("n0", "n102", 102)]


def test_sources_behind_many_statements(spark):
    rows = [("column", f"t{i}", "c", f"t{i + 1}", "c") for i in range(40)]
    found = lineage.across_statements(spark.createDataFrame(rows, "terminal_kind string, target string, target_column string, source_relation string, source_column string").coalesce(1))
    assert sorted((r.target_ref, r.source_ref, r.depth) for r in found.collect()) == sorted((f"t{i}.c", "t40.c", 40 - i) for i in range(40))
