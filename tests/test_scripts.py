"""Scripts, their variables and calls, schemas that scripts declare, and interactions with the machine itself."""

from pyspark.sql import functions as F

from tracewright.functions import scripts, sqltext
from tracewright.operators import catalogs, interactions
from tracewright.plans import lineage

TEXT = """-- a script; with a ';' in quotes
let env = 'prod';
let base = "/sql/" + $env;
let open = "${unknown}/x" + '.sql';
let n = 5;
let late = later + 1;
run_sql($base + "/load.sql", mode = 'full', mode = 'twice', f(1, [2, 3]));
print('call(not)', $n);
insert into ${env}.t select '${n};' from ${db}.s; -- done
let env = "test";
create table ${env}.u as select 1 as a
"""


def test_statements_with_the_variables_of_their_line(spark):
    files = spark.createDataFrame([("a.sql", TEXT), ("b.sql", "select ${env} from t"), ("c.sql", None)], "file string, text string")
    got = {(r.file, r.line): r for r in scripts.script_facts(files, "statements").collect()}
    assert got["a.sql", 9].resolved == "insert into prod.t select '5;' from ${db}.s" and got["a.sql", 9].kind == "sql"
    assert got["a.sql", 11].resolved == "create table test.u as select 1 as a" and got["b.sql", 1].resolved == "select ${env} from t"
    variables = {(r.line, r.name): (r.kind, r.value) for r in scripts.script_facts(files, "variables").collect()}
    assert variables == {(2, "env"): ("literal", "prod"), (3, "base"): ("literal", "/sql/prod"), (4, "open"): ("template", "${unknown}/x.sql"), (5, "n"): ("literal", "5"), (6, "late"): ("expression", None), (10, "env"): ("literal", "test")}


def test_calls(spark):
    files = spark.createDataFrame([("a.sql", TEXT)], "file string, text string")
    got = sorted((r.line, r.offset, r.symbol, r.positional, r.named) for r in scripts.script_facts(files, "calls").collect())
    assert got == [
        (7, 0, "run_sql", ['$base + "/load.sql"', "mode = 'twice'", "f(1, [2, 3])"], {"mode": "'full'"}),
        (7, TEXT.splitlines()[6].index("f(1"), "f", ["1", "[2, 3]"], {}),
        (8, 0, "print", ["'call(not)'", "$n"], {}),
    ]
    assert scripts.calls("f(a") == [] and scripts.calls("x.y( )") == [(0, "x.y", [], {})] and scripts.calls("") == []


def test_paths_meet_files(spark):
    files = spark.createDataFrame([("jobs/load.sql",), ("other/load.sql",), ("jobs/prod_end.sql",), ("Exact.SQL",)], "file string")
    wanted = spark.createDataFrame([("${root}/load.sql",), ("${root}/jobs/load.sql",), ("./exact.sql",), ("${env}_end.sql",), ("none.sql",), ("${all}",)], "template string")
    got = {r.template: (r.status, r.file, r.basis) for r in scripts.match_files(wanted, files).collect()}
    assert got == {
        "${root}/load.sql": ("ambiguous", None, "fixed_end"),
        "${root}/jobs/load.sql": ("matched", "jobs/load.sql", "fixed_end"),
        "./exact.sql": ("matched", "Exact.SQL", "exact_path"),
        "${env}_end.sql": ("matched", "jobs/prod_end.sql", "fixed_end"),
        "none.sql": ("unresolved", None, None),
        "${all}": ("unresolved", None, None),
    }


def test_masks_keep_offsets():
    text = "a 'x;\n''y' -- b\n/* c\nd */ `e` \"f\" g"
    masked = sqltext.masked(text)
    assert len(masked) == len(text) and masked.split() == ["a", "g"] and [i for i, c in enumerate(masked) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]
    assert sqltext.placeholders("a ${b} {{c}} %(d)s $e") == [(2, "${b}"), (7, "{{c}}"), (13, "%(d)s"), (19, "$e")]
    assert sqltext.conflict_keys("insert into t values (1) on conflict (a, `b`) do nothing") == ["a,b"]


def test_schemas_of_own_tables(spark):
    wide = ", ".join(f"c{i}" for i in range(40))
    text = f"create table a.t as select {wide} from raw.s; create view a.v as select * from a.t; insert into a.w select v.* from a.v v; insert into a.x select * from a.w"
    facts = lineage.analyse(spark, [("f.sql", text)])
    assert {(r.relation_name, r.status, len(r.columns.split(","))) for r in facts["contracts"].collect()} == {("a.t", "confirmed", 40), ("a.v", "confirmed", 40)}
    assert facts["recursive"].where("target = 'a.w' and source_relation = 'a.v' and status = 'inferred_target'").count() == 40
    assert [r.gap_kind for r in facts["gaps"].collect()] == ["wildcard_projection_unexpanded"]  # an insert is no schema


def test_loopback_binds_nothing(spark):
    rows = [("localhost:8080", False), ("api.localhost", False), ("[::1]:80", False), ("0.0.0.0", False), ("${host}", False), ("", False), (None, False), ("dev.shop.example", True), ("prod", True)]
    df = spark.createDataFrame(rows, "authority string, binds boolean")
    assert df.where(interactions.binding_authority(F.col("authority")).isNotNull() != F.col("binds")).collect() == []


def test_plan_with_cycles_and_unknown_needs(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("d", "e"), ("e", "d"), ("f", "e"), ("a", "outside")], "node string, needed string")
    assert {r.node: r.level for r in catalogs.topological_order(nodes, needs).collect()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "f": None}
