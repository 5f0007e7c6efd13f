import pytest

from tracewright.sources import bundles, values

LOG = """databaseChangeLog:
  - changeSet:
      id: 1
      changes:
        - createTable:
            schemaName: s
            tableName: t
            columns:
              - column:
                  name: id
                  type: int
                  constraints:
                    primaryKey: true
              - column:
                  name: n
                  type: varchar(10)
        - addForeignKeyConstraint:
            baseTableName: t
            baseColumnNames: n
            constraintName: f
            referencedTableName: u
            referencedColumnNames: k
  - changeSet:
      id: 2
      changes:
        - renameTable:
            oldTableName: t
            newTableName: t2
"""


def test_values_of_all_kinds(spark):
    files = spark.createDataFrame(
        [
            ("a.py", "py", "class C(Enum):\n  A = 1\n  B = 'x'\nM = {'no': 1}\nKEYS = {'k': 'v', 'n': [1]}\nL = f()\nNAMES = ('b', 'a')"),
            ("b.java", "java", 'enum E { ONE("x, y", 1), TWO, /* NO, */ THREE; int z; }'),
            ("c.csv", "csv", 'h,"i"\n1,"a,b"\n2,\n'), ("d.tsv", "tsv", "h\ti\n1\t2\n"), ("e.toml", "toml", "[p.q]\nr = 5\n"), ("f.xml", "xml", '<a><b id="1"><c>x</c></b></a>'),
            ("g.sql", "sql", "insert into t (a, b) values (1, 'it''s'), (2, ''); select 1"), ("bad.py", "py", "def"), ("h.txt", "txt", "x"),
        ],
        "path string, suffix string, text string",
    )
    got = sorted(((r.path, r.kind, r.set_name, r.key, r.value) for r in values.declared_values(files).collect()), key=repr)
    assert got == sorted([
        ("a.py", "enum", "C", "A", "1"), ("a.py", "enum", "C", "B", "x"), ("a.py", "map", "M", "no", "1"), ("a.py", "map", "KEYS", "k", "v"), ("a.py", "list", "NAMES", None, "a"), ("a.py", "list", "NAMES", None, "b"),
        ("b.java", "enum", "E", "ONE", '"x, y", 1'), ("b.java", "enum", "E", "TWO", None), ("b.java", "enum", "E", "THREE", None),
        ("c.csv", "column", "h", "1", "1"), ("c.csv", "column", "i", "1", "a,b"), ("c.csv", "column", "h", "2", "2"), ("c.csv", "column", "i", "2", ""), ("d.tsv", "column", "h", "1", "1"), ("d.tsv", "column", "i", "1", "2"),
        ("e.toml", "setting", "$.p.q", "r", "5"), ("f.xml", "attribute", "b", "id", "1"), ("f.xml", "element", "b", "c", "x"),
        ("g.sql", "row", "t", "a", "1"), ("g.sql", "row", "t", "b", "it's"), ("g.sql", "row", "t", "a", "2"), ("g.sql", "row", "t", "b", ""), ("bad.py", "unreadable", None, None, None),
    ], key=repr)


def test_change_logs_beside_other_schemas(spark):
    jooq = 'super(DSL.name("T"), null); f = createField(DSL.name("A"), SQLDataType.INTEGER.nullable(false), this, "");'
    files = spark.createDataFrame([("l.yaml", "yaml", LOG), ("d.sql", "sql", "create table d (x int)"), ("x/jooq/T.java", "java", jooq), ("o.yaml", "yaml", "a: 1")], "path string, suffix string, text string")
    got = {(r.source, r.kind, r.table_name, r.name, r.detail, r.reference) for r in values.database_schema(files).collect()}
    assert got == {
        ("changelog", "table", "s.t", "s.t", None, None), ("changelog", "column", "s.t", "id", "int", None), ("changelog", "primary_key", "s.t", None, "id", None), ("changelog", "column", "s.t", "n", "varchar(10)", None),
        ("changelog", "foreign_key", "t", "f", "n", "u(k)"), ("changelog", "rename", "t", "t2", None, None), ("ddl", "table", "d", "d", None, None), ("ddl", "column", "d", "x", "int", None),
        ("generated", "table", "T", "T", None, None), ("generated", "column", "T", "A", "INTEGER not null", None),
    }


def test_bundles():
    files = {"a.json": b"{}", "d/b.txt": b"x" * 1000}
    bundle = bundles.pack(files)
    assert bundles.unpack(bundle) == files and bundles.pack(dict(reversed(files.items()))) == bundle
    with pytest.raises(ValueError):
        bundles.unpack(bundles.pack({"../x": b""}))
    with pytest.raises(ValueError):
        bundles.unpack(bundle.replace(b"d/b.txt", b"d/c.txt"))


def test_mapping_as_csv(spark, tmp_path):
    rows = spark.createDataFrame([("t", "b", "column", "s", "x", 1, True, "single_source"), ("t", "a", "unresolved", None, "y", 2, False, "single_source")], "target string, target_column string, terminal_kind string, source_relation string, source_column string, n_branches int, complete boolean, mapping_kind string")
    bundles.export_mapping(rows, str(tmp_path / "m"))
    back = spark.read.option("header", True).csv(str(tmp_path / "m"))
    assert sorted((r.target_column, r.source_relation, r.n_branches) for r in back.collect()) == [("a", None, "2"), ("b", "s", "1")]


def test_repositories_by_pages(spark):
    pages = [[("r1", "p", "u1"), ("r2", "p", "u2")], [("r2", "p", "u2"), ("r3", "q", "u3")]]
    got = bundles.repositories(spark, lambda page: (pages[page], page == 1))
    assert sorted(r.repo_id for r in got.collect()) == ["r1", "r2", "r3"]
    with pytest.raises(Exception, match="more than 1 pages"):
        bundles.repositories(spark, lambda page: (pages[page], page == 1), 1).collect()
