"""Registered queries over whole tables, against brute force."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewright import queries
from tracewright.operators import catalogs, joins


@pytest.fixture
def saved(spark, tmp_path):
    def save(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return save


def _islands(orders, lines, least):
    customer = dict(orders)
    edges = {(f"o{customer[o]}", f"s{s}", min(max(q - 47, 1), 3)) for o, s, q in lines if o in customer}
    group = {x: x for a, b, _ in edges for x in (a, b)}
    degree = dict.fromkeys(group, 0)
    for a, b, _ in (kept := [e for e in edges if e[2] >= least]):
        degree[a], degree[b] = degree[a] + 1, degree[b] + 1
        old, new = group[a], group[b]
        group = {x: new if g == old else g for x, g in group.items()}
    assert kept
    return sorted((x, min(y for y in group if group[y] == g), degree[x]) for x, g in group.items())


@pytest.mark.parametrize("name, least", [("islands_strict", 3), ("islands_extended", 2)])
def test_islands_over_all_orders(spark, saved, name, least):
    orders = [(o, o * 7 % 23) for o in range(1, 60)]
    lines = [(o, (o * 11 + k * 5) % 17, 46 + (o * 3 + k) % 5) for o in range(1, 62) for k in range(3)]
    at = saved(orders=(orders, "o_orderkey long, o_custkey long"), lineitem=(lines, "l_orderkey long, l_suppkey long, l_quantity long"))
    got = queries.queries()[name](spark, at)
    assert sorted(tuple(r) for r in got.select("node", "component", "degree").collect()) == _islands(orders, lines, least)


def test_documents_match_items_by_whole_texts(spark, saved):
    items = [(1, "the same beginning, one"), (2, "the same beginning, two"), (3, "twice there"), (4, "twice there"), (5, None), (6, "")]
    docs = [(1, "the same beginning, one"), (2, "the same beginning, other"), (3, "twice there"), (4, None), (5, "the same"), (6, "the same beginning, two"), (7, ""), (8, "")]
    at = saved(documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
    want = []
    for doc, text in docs:
        found = sorted({i for i, t in items if t is not None and t == text})
        status = "matched" if len(found) == 1 else "ambiguous" if found else "unresolved"
        want.append((doc, len(found), status, found[0] if len(found) == 1 else None))
    got = queries.queries()["unique_or_ambiguous"](spark, at)
    assert sorted(tuple(r) for r in got.collect()) == want
    gaps = queries.queries()["gap_summary"](spark, at).select("gap_kind", "n", "subjects").collect()
    assert sorted(tuple(r) for r in gaps) == [("ambiguous_item", 1, 1), ("unresolved_item", 3, 3)]


def test_tiers_offer_all_pages(spark, saved):
    split = lambda url: (None, None) if url is None else (url[8:].partition("/")[0], "/" + url[8:].partition("/")[2])
    pages = [(1, "https://a/x"), (2, "https://a/y"), (3, "https://b/x"), (4, "https://c/z"), (5, "https://a/x"), (6, None), (7, "https://d/w"), (8, "https://d/v")]
    pages += [(9, "https://e/x"), (9, "https://f/u"), (9, "https://d/w"), (4, "https://c/z"), (None, "https://a/x"), (10, "https://f/q"), (11, "https://g/r"), (11, "https://h/s"), (12, "https://h/s")]
    at = saved(pages=(pages, "page_id long, url string"))
    want = []
    for page, _ in pages:
        own = [split(u) for p, u in pages if p == page and page is not None]
        tiers = []
        for take in (lambda x: x, lambda x: x[0], lambda x: x[1]):
            tiers.append(sorted({p for p, u in pages if p not in (None, page) and u is not None and take(split(u)) in map(take, own)}))
        tier = next((k for k, x in enumerate(tiers, 1) if x), None)
        found = tiers[tier - 1] if tier else []
        want.append((page, tier, len(found), ("unresolved", "matched", "ambiguous")[min(len(found), 2)], found[0] if len(found) == 1 else None))
    got = queries.queries()["tiered_lookup"](spark, at).select("page_id", "tier", "candidate_count", "status", "target_id")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr) and {w[3] for w in want} == {"unresolved", "matched", "ambiguous"}


def test_all_suppliers_override(spark, saved):
    at = saved(supplier=([(i, f"s{i}") for i in range(1, 5)], "s_suppkey long, s_name string"), customer=([(i, f"c{i}") for i in range(3, 8)], "c_custkey long, c_name string"))
    got = queries.queries()["publication_inheritance"](spark, at)
    assert sorted(tuple(r) for r in got.collect()) == [(i, f"s{i}", "own") for i in range(1, 5)] + [(i, f"c{i}", "inherited") for i in range(5, 8)]


def test_declared_keys_need_columns_not_rows(spark, tmp_path):
    for name, schema, want in (("all", "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long", ["part", "pk"]), ("less", "l_orderkey long, l_partkey long", ["part"])):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}/lineitem.parquet")
        assert sorted(r.key_id for r in queries.queries()["declared_key_match"](spark, f"{tmp_path}/{name}").collect()) == want


def test_partitions_of_one_parent_meet_in_several_tasks(spark, monkeypatch):
    for name, n in (("BLOCK_ROWS", 100), ("TASK_PAIRS", 20_000)):
        monkeypatch.setattr(joins, name, n, raising=False)
    children = spark.range(600).select(F.concat(F.lit("p"), "id").alias("child"), F.floor(F.col("id") / 1000).alias("parent")).coalesce(1)
    columns = spark.range(900).select(F.floor(F.col("id") / 1000).alias("table_name"), F.col("id").alias("column_name")).coalesce(1)
    per_task = [r.n for r in catalogs.partition_children(children, columns).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(per_task) == 540_000 and max(per_task) < 200_000, per_task


def test_blocks_of_rows_meet_once(spark, saved, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK_ROWS", 2)
    monkeypatch.setattr(joins, "TASK_PAIRS", 5)
    monkeypatch.setattr(joins, "TASK_ROWS", 7)
    suppliers = [(i, i % 3) for i in range(11)] + [(3, 0), (3, 0), (None, 1), (50, None), (51, 8), (52, 9)]
    customers = [(i, i % 4) for i in range(17)] + [(4, 0), (None, 2), (60, None), (61, 9), (61, 9)]
    at = saved(supplier=(suppliers, "s_suppkey long, s_nationkey int"), customer=(customers, "c_custkey long, c_nationkey int"))
    got = queries.queries()["partition_columns"](spark, at)
    want = [(None if s is None else f"p{s}", c) for s, n in suppliers for c, m in customers if n is not None and n == m]
    assert got.columns == ["table_name", "column_name"] and sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def _per_task(df):
    return [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]


def test_edges_are_dealt_by_their_number(spark, saved, monkeypatch):
    monkeypatch.setattr(joins, "TASK_ROWS", 100, raising=False)
    orders = [(o, o % 40) for o in range(400)] + [(7, 7), (7, 9), (8, None), (None, 1), (500, 2)]
    lines = [(k % 400, k * 7 % 30) for k in range(1500)] + [(8, None), (None, 3), (501, 3)]
    suppliers = [(s, 9000.0 if s % 3 == 0 else 100.0) for s in range(30)] + [(3, 8000.0), (None, 9000.0)]
    at = saved(orders=(orders, "o_orderkey long, o_custkey long"), lineitem=(lines, "l_orderkey long, l_suppkey long"), supplier=(suppliers, "s_suppkey long, s_acctbal double"))
    got = queries.queries()["either_endpoint"](spark, at)
    good = {s for s, balance in suppliers if balance > 5000 and s is not None}
    want = {(o, c, s) for o, c in orders for k, s in lines if o is not None and o == k and (c in good or s in good)}
    assert got.columns == ["o_orderkey", "o_custkey", "l_suppkey"] and sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert max(_per_task(got)) < len(want) / 3


@pytest.mark.parametrize("name", ["candidate_ranking", "target_recommendation"])
def test_parts_are_dealt_by_the_number_of_lines(spark, saved, monkeypatch, name):
    monkeypatch.setattr(joins, "TASK_ROWS", 100, raising=False)
    lines = [(k % 90, k * k % 7) for k in range(1200)] + [(91, None), (92, None), (92, 5), (93, None), (93, None), (93, 4), (None, 3), (None, None)]
    at = saved(lineitem=(lines, "l_partkey long, l_suppkey long"))
    got = queries.queries()[name](spark, at)
    want = []
    for part in {p for p, _ in lines if p is not None}:
        uses = Counter(s for p, s in lines if p == part)
        top = [s for s, n in uses.items() if n == max(uses.values())]
        first = min((s for s in top if s is not None), default=None)
        if name == "candidate_ranking":
            want.append((part, len(top), first if len(top) == 1 else None, "matched" if len(top) == 1 else "ambiguous"))
        else:
            want.append((part, len(uses), first, "confirmed_unique" if len(uses) == 1 else "probable_ranked" if len(top) == 1 else "probable_tie_break"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert max(_per_task(got)) < len(want) / 3
