import pytest
from pyspark.sql import functions as F

from tracewright.sources import files, products
from tracewright.streaming import events


@pytest.fixture
def repo(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/x.sql").write_text("select 1")
    (tmp_path / "a.sql").write_text("CREATE TABLE s.t (id int primary key, n varchar(10), CONSTRAINT f FOREIGN KEY (n) REFERENCES u (k));\nALTER TABLE s.t RENAME TO s.t2;\nCREATE UNIQUE INDEX i ON s.t2 (n);")
    (tmp_path / "b.sql").write_text("DROP TABLE s.t2; CREATE TABLE s.t (id int);")
    (tmp_path / "sub/c.yaml").write_text("a:\n  b: 1 # c\n  l:\n    - x\n    - k: v\nr: ${p.q}\n")
    (tmp_path / "sub/p.properties").write_text("p.q = 7\n# no = 1\n")
    (tmp_path / "sub/bad.json").write_text("{")
    (tmp_path / "sub/j.json").write_text('{"a": [1, {"b": null}]}')
    (tmp_path / "m.py").write_text('q = """SELECT x FROM t"""')
    (tmp_path / "n.bin").write_bytes(b"\xff")
    return str(tmp_path)


def test_files_and_units(spark, repo):
    found = files.scan_files(spark, repo, with_text=True)
    assert sorted(r.path for r in found.collect()) == ["a.sql", "b.sql", "m.py", "sub/bad.json", "sub/c.yaml", "sub/j.json", "sub/p.properties"]
    assert files.detect_stack(found).first().asDict()["sql"]
    assert ("m.py", "SELECT x FROM t") in {(r.path, r.sql) for r in files.sql_units(found).collect()}


def test_config_scalars(spark, repo):
    scalars = files.config_scalars(files.scan_files(spark, repo, with_text=True))
    got = {(r.path, r.config_path): r.value for r in scalars.collect()}
    assert got[("sub/c.yaml", "a.b")] == "1" and got[("sub/c.yaml", "a.l[0]")] == "x" and got[("sub/c.yaml", "a.l[1].k")] == "v"
    assert got[("sub/j.json", "$.a[1].b")] is None and ("sub/bad.json", None) in got
    (used,) = files.resolve_references(scalars).collect()
    assert (used.status, used.selected_id) == ("matched", "7")


def test_ddl_and_migrations(spark, repo):
    facts = files.schema_facts(files.scan_files(spark, repo, with_text=True))
    kinds = {(r.kind, r.name, r.detail, r.reference) for r in facts.collect()}
    assert ("foreign_key", "f", "n", "u(k)") in kinds and ("primary_key", None, "id", None) in kinds and ("unique_index", "i", "n", None) in kinds
    assert {(r.table_name, r.active) for r in files.fold_migrations(facts).collect()} == {("s.t", True), ("s.t2", False)}


def test_publication_is_whole_or_absent(spark, tmp_path):
    good = spark.createDataFrame([(1, None), (2, 1)], "id int, parent int")
    products.publish(spark, {"r": good}, str(tmp_path / "p"), ids={"r": "id"}, references=[("r", "parent", "r", "id")], declared={"r": 2})
    assert spark.read.parquet(str(tmp_path / "p/r")).count() == 2
    with pytest.raises(ValueError, match="duplicate"):
        products.publish(spark, {"r": good.union(good)}, str(tmp_path / "q"), ids={"r": "id"})
    assert not (tmp_path / "q").exists() and not (tmp_path / "q.staging").exists()


def test_fact_lines(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], "id string, n int")
    one = products.write_facts(df, str(tmp_path / "f"), "id")
    assert one == products.content_digest(df.repartition(3).orderBy(F.desc("id")), "id")
    assert products.read_facts(spark, str(tmp_path / "f"), df.schema, 2).count() == 2
    with pytest.raises(ValueError):
        products.read_facts(spark, str(tmp_path / "f"), df.schema, 3)


def test_stream_equals_batch(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    table = spark.read.parquet(source)
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    events.append_new(stream, str(tmp_path / "out"), str(tmp_path / "ck"), "event_id").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == table.count()
    assert events.windowed_counts(spark.read.parquet(str(tmp_path / "out"))).agg(F.sum("n_events")).first()[0] == table.count()
