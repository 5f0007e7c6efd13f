from tracewright.operators import interactions, mapping, valueflow
from tracewright.sources import catalog


def test_interaction_tiers(spark):
    call = "interface_id string, repo_id string, method string, path string, authority string, service string, base_property string"
    route = "interface_id string, repo_id string, method string, path string, authority string, service string"
    calls = spark.createDataFrame(
        [
            ("c1", "a", "GET", "/api/x/1", "svc.b", None, None),  # authority, exact
            ("c2", "a", "GET", "/x/{id}", None, "b", None),  # service, suffix
            ("c3", "a", "POST", "/x/1", "localhost", None, None),  # an environment binds nothing; method differs
            ("c4", "a", "GET", "/y", None, None, None),  # two repositories offer it
            ("c5", "b", "GET", "/api/x/1", "svc.b", None, None),  # only its own repository
            ("c6", "a", "GET", "/api/x/2", None, None, "b"),  # by base-URL property
        ],
        call,
    )
    routes = spark.createDataFrame([("r1", "b", "GET", "/api/x/{id}", "svc.b", "b"), ("r2", "c", "GET", "/y", None, "c"), ("r3", "d", "", "/y", None, "d")], route)
    got = {r.interface_id: (r.status, r.target_id, r.confidence) for r in interactions.match(calls, routes).collect()}
    assert got == {
        "c1": ("matched", "r1", "confirmed"), "c2": ("matched", "r1", "probable"), "c3": ("unresolved", None, "unknown"),
        "c4": ("ambiguous", None, "unknown"), "c5": ("unresolved", None, "unknown"), "c6": ("matched", "r1", "probable"),
    }
    repos = spark.createDataFrame([("a",), ("b",), ("z",)], "repo_id string")
    cover = {r.repo_id: r.coverage_status for r in interactions.repository_coverage(repos, interactions.match(calls, routes)).collect()}
    assert cover == {"a": "partial", "b": "partial", "z": "not_applicable"}


def test_mapping_statuses_and_gaps(spark):
    entities = spark.createDataFrame([("e1", "entity", '"S".T'), ("e2", "entity", None), ("e3", "embeddable", None), ("e4", "entity", "s.u")], "entity_id string, kind string, table_name string")
    tables = spark.createDataFrame([("t1", "s.t"), ("t2", "s.u"), ("t3", "S.U"), ("t4", "s.v")], "table_id string, name string")
    mapped = mapping.map_entities(entities, tables)
    assert {r.entity_id: (r.status, r.gap_kind) for r in mapped.collect()} == {"e1": ("matched", None), "e2": ("unresolved", "explicit_name_missing"), "e3": ("not_applicable", None), "e4": ("ambiguous", "ambiguous_table")}
    fields = spark.createDataFrame([("f1", "e1", "A"), ("f2", "e1", "zz"), ("f3", "e4", "a"), ("f4", "e3", "a")], "field_id string, entity_id string, column_name string")
    columns = spark.createDataFrame([("c1", "t1", "a"), ("c2", "t2", "a")], "column_id string, table_id string, name string")
    got = {r.field_id: (r.status, r.column_id, r.gap_kind) for r in mapping.map_fields(fields, mapped, columns).collect()}
    assert got == {"f1": ("matched", "c1", None), "f2": ("unresolved", None, "column_not_found"), "f3": ("unresolved", None, "owner_not_matched"), "f4": ("not_applicable", None, None)}
    assert sorted(r.table_id for r in mapping.unmapped(tables, mapped).collect()) == ["t2", "t3", "t4"]


def test_signatures_join_by_structure(spark):
    refs = spark.createDataFrame([("r1", '{"op":"concat","args":[{"field":"x"},":",{"field":"y"}]}', True), ("r2", '{"field":"q"}', True), ("r3", "{", False)], "reference_id string, tree string, single boolean")
    keys = spark.createDataFrame([("k1", '{"op":"concat","args":[{"field":"a"},":",{"field":"b"}]}'), ("k2", '{"field":"m"}'), ("k3", '{"field":"n"}')], "key_id string, tree string")
    got = {r.reference_id: (r.status, r.readiness, r.key_id) for r in mapping.storage_joins(refs, keys).collect()}
    assert got == {"r1": ("strongly_supported", "executable_storage_join", "k1"), "r2": ("ambiguous", "ambiguous", None), "r3": ("unresolved", "not_ready", None)}
    assert mapping.signature({"op": "+", "args": [1, {"field": "a"}]}) == mapping.signature({"op": "+", "args": [{"field": "b"}, 1]})


def test_value_flow(spark):
    flows = spark.createDataFrame([("a", "b", "assignment", "x", "confirmed"), ("b", "c", "return_flow", "sha256(x)", "probable"), ("a", "c", "assignment", "x + y", "confirmed")], "source_id string, target_id string, flow_kind string, expression string, confidence string")
    edges = valueflow.edges(flows)
    assert {(r.source_id, r.target_id): (r.transformation_kind, r.value_preservation) for r in edges.collect()} == {("a", "b"): ("identity", "preserved"), ("b", "c"): ("hashed", "transformed"), ("a", "c"): ("combined", "partially_preserved")}
    assert {r.target_id: (r.source_count, r.derivation_kind) for r in valueflow.derivations(edges).collect()} == {"b": (1, "direct"), "c": (2, "combined")}
    one = lambda x: spark.createDataFrame([(x,)], "n string")
    assert valueflow.attribute_paths(edges, one("a"), one("c"))[1].first().status == "ambiguous"
    assert valueflow.attribute_paths(edges, one("b"), one("c"))[1].first().status == "probable_complete"
    nodes = spark.createDataFrame([("n1", "x", "o"), ("n2", "y", "o")], "node_id string, display_ref string, owner_ref string")
    wanted = spark.createDataFrame([("n1",), ("y",), ("o",), ("?",)], "ref string")
    assert {r.ref: (r.status, r.node_id) for r in valueflow.resolve_endpoint(nodes, wanted).collect()} == {"n1": ("matched", "n1"), "y": ("matched", "n2"), "o": ("ambiguous", None), "?": ("not_found", None)}


def test_catalog_and_revisions(spark):
    c = catalog.Catalog(spark, {"t": "id string, n long", "u": "id string"}, {"t": spark.createDataFrame([("a", 1)], "id string, n int")})
    assert c.capabilities() == {"t": "available", "u": "not_available"} and c.relation("u").count() == 0 and c.union(c).relation("t").count() == 2
    revisions = spark.createDataFrame([], catalog.REVISION)
    revisions = catalog.publish_revision(revisions, "s", {"a": "d1", "b": "d2"})
    revisions = catalog.publish_revision(revisions, "s", {"b": "d3"})
    active = {r.slot: (r.digest, r.ordinal) for r in revisions.where("active").collect()}
    assert active == {"a": ("d1", 2), "b": ("d3", 2)}
    blobs = spark.createDataFrame([("d1",), ("d2",), ("d9",)], "digest string")
    assert [r.digest for r in catalog.garbage(blobs, revisions).collect()] == ["d9"]
    assert {r.slot for r in catalog.activate(revisions, "s", 1).where("active").collect()} == {"a", "b"}
    wanted = spark.createDataFrame([("n", "p"), ("n", "q")], "node string, input_print string")
    produced = spark.createDataFrame([("n", "p", "d1")], "node string, input_print string, digest string")
    assert {r.input_print: r.decision for r in catalog.reuse(wanted, produced).collect()} == {"p": "reuse", "q": "build"}
