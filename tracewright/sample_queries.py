"""Registered queries over small fixed inputs: files of a repository, models, interactions and texts, each with the rows that it has to give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import ids, scripts, search, sqltext
from tracewright.operators import graph, interactions, mapping, models, valueflow
from tracewright.plans import paging
from tracewright.queries import expects, query, table
from tracewright.sources import catalog, code, files, products, values

_LOG = """databaseChangeLog:
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
"""
FILES = {
    "sql/01.sql": "CREATE TABLE s.t (id int primary key, n varchar(10), CONSTRAINT f FOREIGN KEY (n) REFERENCES u (k), CHECK (n IN ('a', 'b')));\nALTER TABLE s.t RENAME TO s.t2;\nCREATE UNIQUE INDEX i ON s.t2 (n);",
    "sql/02.sql": "DROP TABLE s.t2; CREATE TABLE s.t (id int); COMMENT ON TABLE s.t IS 'it''s';",
    "conf/app.yaml": "a:\n  b: 1 # c\n  l:\n    - x\n    - k: v\nr: ${p.q}\nz: ${none}\n",
    "conf/app.properties": "p.q = 7\n# no = 1\n",
    "conf/bad.json": "{",
    "conf/ok.json": '{"a": [1, {"b": null}]}',
    "db/log.yaml": _LOG,
    "src/a.py": "import os as o\nclass C(D):\n  def f(self, x):\n    return 'SELECT 1 FROM t'\nM = {'k': 'v'}\n",
    "src/C.java": 'package a.b;\n@Entity @Table(name = "t")\npublic class C extends D<X> implements E {\n  @Column(name = "n")\n  private String name;\n}\n@RequestMapping("/api")\nclass R { @GetMapping("/x/{id}") String x() { return ""; } }\n',
    "src/jooq/T.java": 'super(DSL.name("T"), null); f = createField(DSL.name("A"), SQLDataType.INTEGER.nullable(false), this, "");',
    "src/E.java": 'enum E { ONE("x"), TWO; }',
    "api/openapi.json": '{"paths": {"/x": {"get": {"operationId": "o"}}}, "components": {"schemas": {"S": {"type": "object", "properties": {"a": {"type": "string"}, "r": {"$ref": "#/components/schemas/Q"}}}, "Q": {"properties": {"z": {"type": "integer"}}}}}}',
    "build.gradle": "plugins { id 'java' version '1' }\ninclude 'a', ':b'\ndependencies { implementation 'g:n:1.0'\n api(project(':b')) }",
    "model/m.pdm": '<M xmlns:o="o" xmlns:c="c" xmlns:a="a"><o:Table Id="t1"><a:Code>T</a:Code><c:Columns><o:Column Id="c1"><a:Code>A</a:Code><a:DataType>int</a:DataType></o:Column></c:Columns></o:Table></M>',
    "Dockerfile": "FROM x",
    "notes.md": "a\nb token\nc",
    "data.csv": "h,i\n1,2\n",
}


def _files(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(list(FILES.items()), "path string, text string")
    return rows.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))


# Files


@expects("path", "('sql/01.sql'), ('sql/02.sql'), ('conf/app.yaml'), ('conf/app.properties'), ('conf/bad.json'), ('conf/ok.json'), ('db/log.yaml'), ('src/a.py'), ('src/C.java'), ('src/jooq/T.java'), ('src/E.java'), ('api/openapi.json'), ('build.gradle'), ('Dockerfile'), ('data.csv')")
def eligible_files(spark, sf_dir):
    return files.eligible(_files(spark)).select("path")


@expects("suffix folder n_files:BIGINT", "('sql', 'sql', 2), ('yaml', 'conf', 1), ('properties', 'conf', 1), ('json', 'conf', 2), ('yaml', 'db', 1), ('py', 'src', 1), ('java', 'src', 3), ('json', 'api', 1), ('gradle', '.', 1), ('pdm', 'model', 1), ('', '.', 1), ('md', '.', 1), ('csv', '.', 1)")
def repository_inventory(spark, sf_dir):
    return models.inventory(_files(spark).withColumn("size", F.length("text"))).drop("bytes")


@expects("maven:BOOLEAN gradle:BOOLEAN java:BOOLEAN python:BOOLEAN sql:BOOLEAN migrations:BOOLEAN openapi:BOOLEAN", "(false, true, true, true, true, false, true)")
def stack_detection(spark, sf_dir):
    return files.detect_stack(_files(spark))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{p}', 0, '{FILES[p].replace(chr(39), chr(39) * 2)}')" for p in ("sql/01.sql", "sql/02.sql")) + ", ('src/a.py', 0, 'SELECT 1 FROM t')) t(path, ordinal, sql)")
def sql_units(spark, sf_dir):
    return files.sql_units(_files(spark))


@expects(
    "path config_path value",
    "('conf/app.yaml', 'a.b', '1'), ('conf/app.yaml', 'a.l[0]', 'x'), ('conf/app.yaml', 'a.l[1].k', 'v'), ('conf/app.yaml', 'r', '${p.q}'), ('conf/app.yaml', 'z', '${none}'), ('conf/app.properties', 'p.q', '7'), ('conf/bad.json', NULL, NULL), ('conf/ok.json', '$.a[0]', '1'), ('conf/ok.json', '$.a[1].b', NULL)",
)
def config_scalars(spark, sf_dir):
    return files.config_scalars(_files(spark).where("path like 'conf/%'")).select("path", "config_path", "value")


@expects("path config_path reference status selected_id", "('conf/app.yaml', 'r', 'p.q', 'matched', '7'), ('conf/app.yaml', 'z', 'none', 'unresolved', NULL)")
def config_references(spark, sf_dir):
    return files.resolve_references(files.config_scalars(_files(spark))).select("path", "config_path", "reference", "status", "selected_id")


@expects(
    "source path kind table_name name detail reference",
    """('ddl', 'sql/01.sql', 'table', 's.t', 's.t', NULL, NULL), ('ddl', 'sql/01.sql', 'column', 's.t', 'id', 'int', NULL), ('ddl', 'sql/01.sql', 'primary_key', 's.t', NULL, 'id', NULL), ('ddl', 'sql/01.sql', 'column', 's.t', 'n', 'varchar(10)', NULL),
    ('ddl', 'sql/01.sql', 'foreign_key', 's.t', 'f', 'n', 'u(k)'), ('ddl', 'sql/01.sql', 'check', 's.t', NULL, 'n IN (''a'', ''b'')', NULL), ('ddl', 'sql/01.sql', 'rename', 's.t', 's.t2', NULL, NULL), ('ddl', 'sql/01.sql', 'unique_index', 's.t2', 'i', 'n', NULL),
    ('ddl', 'sql/02.sql', 'drop', 's.t2', NULL, NULL, NULL), ('ddl', 'sql/02.sql', 'table', 's.t', 's.t', NULL, NULL), ('ddl', 'sql/02.sql', 'column', 's.t', 'id', 'int', NULL), ('ddl', 'sql/02.sql', 'comment', 's.t', 's.t', 'it''s', NULL),
    ('changelog', 'db/log.yaml', 'table', 's.t', 's.t', NULL, NULL), ('changelog', 'db/log.yaml', 'column', 's.t', 'id', 'int', NULL), ('changelog', 'db/log.yaml', 'primary_key', 's.t', NULL, 'id', NULL),
    ('generated', 'src/jooq/T.java', 'table', 'T', 'T', NULL, NULL), ('generated', 'src/jooq/T.java', 'column', 'T', 'A', 'INTEGER not null', NULL)""",
)
def database_schema(spark, sf_dir):
    return values.database_schema(_files(spark)).drop("line")


@expects("table_name generation:BIGINT active:BOOLEAN", "('s.t', 2, true), ('s.t2', 1, false)")
def folded_migrations(spark, sf_dir):
    return files.fold_migrations(files.schema_facts(_files(spark)))


@expects("table_name literals", "('s.t', 'a,b')")
def declared_checks(spark, sf_dir):
    checks = files.schema_facts(_files(spark)).where("kind = 'check'")
    return checks.select("table_name", F.array_join(scripts.check_values(F.col("detail")), ",").alias("literals"))


@expects(
    "reader kind owner name detail",
    """('python', 'import', NULL, 'os', 'o'), ('python', 'class', NULL, 'C', 'D'), ('python', 'function', 'C', 'f', 'self,x'), ('python', 'sql', 'C.f', NULL, 'SELECT 1 FROM t'),
    ('java', 'class', 'a.b', 'a.b.C', NULL), ('java', 'inherits', 'a.b.C', 'D', NULL), ('java', 'inherits', 'a.b.C', 'E', NULL), ('java', 'annotation', 'a.b.C', 'Entity', NULL), ('java', 'annotation', 'a.b.C', 'Table', 'name = "t"'), ('java', 'field', 'a.b.C', 'name', 'String'), ('java', 'field_annotation', 'a.b.C.name', 'Column', 'name = "n"'),
    ('java', 'class', 'a.b', 'a.b.R', NULL), ('java', 'annotation', 'a.b.R', 'RequestMapping', '"/api"'), ('java', 'endpoint', 'a.b.R', '/api/x/{id}', 'GET'), ('java', 'enum', NULL, 'E', NULL),
    ('openapi', 'schema', NULL, 'S', 'object'), ('openapi', 'schema_field', 'S', 'a', 'string'), ('openapi', 'schema_field', 'S', 'r', 'Q'), ('openapi', 'schema_field', 'S', 'r.z', 'integer'), ('openapi', 'schema', NULL, 'Q', NULL), ('openapi', 'schema_field', 'Q', 'z', 'integer'), ('openapi', 'endpoint', 'o', '/x', 'GET'),
    ('gradle', 'plugin', NULL, 'java', '1'), ('gradle', 'module', NULL, 'a', NULL), ('gradle', 'module', NULL, ':b', NULL), ('gradle', 'dependency', 'implementation', 'g:n', '1.0'), ('gradle', 'dependency', 'api', ':b', NULL),
    ('model', 'table', NULL, 'T', 't1'), ('model', 'column', 't1', 'A', 'int'), ('jooq', 'table', NULL, 'T', NULL), ('jooq', 'column', 'T', 'A', 'INTEGER not null')""",
)
def code_facts(spark, sf_dir):
    return code.code_facts(_files(spark)).select("reader", "kind", "owner", "name", "detail")


@expects("path kind set_name key value", "('src/a.py', 'map', 'M', 'k', 'v'), ('src/E.java', 'enum', 'E', 'ONE', '\"x\"'), ('src/E.java', 'enum', 'E', 'TWO', NULL), ('data.csv', 'column', 'h', '1', '1'), ('data.csv', 'column', 'i', '1', '2')")
def declared_values(spark, sf_dir):
    return values.declared_values(_files(spark))


@expects("path score:INTEGER class", "('sql/01.sql', 7, 'strong'), ('sql/02.sql', 5, 'possible'), ('src/C.java', 5, 'possible')")
def model_candidates(spark, sf_dir):
    return files.candidate_score(_files(spark)).where("score >= 3").select("path", "score", "class")


@expects("path line_number:INTEGER line context", "('notes.md', 2, 'b token', 'a' || chr(10) || 'b token' || chr(10) || 'c')")
def source_search(spark, sf_dir):
    return files.search_lines(_files(spark), "TOKEN", 1)


_GIT = "\x1eh1\x1fAnn\x1fA@x\x1f2024-01-01\x1fone\n\n3\t1\ta.py\n-\t-\tb.png\n\x1eh2\x1fAnna\x1fa@x\x1f2024-01-02\x1ftwo\n\n2\t0\tc.py\n\x1eh3\x1fBob\x1fb@x\x1f2024-01-03\x1fthree\n"


@expects("mail n_commits:BIGINT names first_date last_date", "('a@x', 2, 'Ann,Anna', '2024-01-01', '2024-01-02'), ('b@x', 1, 'Bob', '2024-01-03', '2024-01-03')")
def people(spark, sf_dir):
    return code.people(spark.createDataFrame(code.git_log(_GIT)[0], "digest string, author string, mail string, date string, subject string"))


@expects("suffix n_files:BIGINT added:BIGINT deleted:BIGINT", "('py', 2, 5, 1), ('png', 1, NULL, NULL)")
def git_changes(spark, sf_dir):
    return code.change_summary(spark.createDataFrame(code.git_log(_GIT)[1], "digest string, path string, added int, deleted int"))


# Normal forms and SQL as text


@expects(
    "raw text identifier correspondence namespace authority cardinality",
    """('  A  b ', 'a b', 'a', 'ab', '', '', 'one'), ('"S".T t', '"s".t t', 's.t', 's.tt', '"S"', '', 'one'), ('List<X.y_z>', 'list<x.y_z>', 'list<x.y_z>', 'listx.yz', 'List<X', '', 'many'), ('http://H:80/a', 'http://h:80/a', 'http://h:80/a', 'httph80a', '', 'h', 'one'), (NULL, NULL, NULL, NULL, '', NULL, NULL)""",
)
def normal_forms(spark, sf_dir):
    raw = F.col("raw")
    rows = spark.createDataFrame([("  A  b ",), ('"S".T t',), ("List<X.y_z>",), ("http://H:80/a",), (None,)], "raw string")
    return rows.select("raw", ids.normalize_text(raw).alias("text"), ids.normalize_db_identifier(raw).alias("identifier"), ids.correspondence_path(raw).alias("correspondence"), ids.relation_namespace(raw).alias("namespace"), ids.url_authority(raw).alias("authority"), ids.cardinality_hint(raw).alias("cardinality"))


@expects("name hint strength:INTEGER", "('order_id', 'ORDER_ID', 3), ('order_id', 'id', 2), ('id_of_order', 'of', 1), ('order', 'x', 0)")
def hint_strength(spark, sf_dir):
    rows = spark.createDataFrame([("order_id", "ORDER_ID"), ("order_id", "id"), ("id_of_order", "of"), ("order", "x")], "name string, hint string")
    return rows.withColumn("strength", ids.match_strength(F.col("name"), F.col("hint")))


@expects(
    "expression transformation value_kind preservation",
    "('sha256(x)', 'expression', 'hashed', 'transformed'), ('trim(x)', 'normalization_or_cast', 'normalized', 'partially_preserved'), ('a + b', 'expression', 'combined', 'partially_preserved'), ('a.b', 'direct_column', 'identity', 'preserved'), ('sum(x)', 'aggregation', 'derived', 'transformed'), ('coalesce(a, b)', 'null_defaulting', 'derived', 'transformed'), ('1', 'literal_or_constant', 'identity', 'preserved')",
)
def transformations(spark, sf_dir):
    from tracewright.operators.rules import value_preservation

    rows = spark.createDataFrame([("sha256(x)",), ("trim(x)",), ("a + b",), ("a.b",), ("sum(x)",), ("coalesce(a, b)",), ("1",)], "expression string")
    return rows.withColumn("transformation", ids.transformation_kind(F.col("expression"))).withColumn("value_kind", valueflow.transformation(F.col("expression"))).withColumn("preservation", value_preservation(F.col("value_kind")))


_SCRIPT = "-- one;\nlet t = 'x';\nselect * from ${t}; -- two\nprint('a;b');\nif x then;\nraise y;\ninsert into m.n select a from p cross join q where b = '--;' order by a"


@expects(
    "line:INTEGER kind resolved lint",
    """(2, 'assignment', 'let t = ''x''', ''), (3, 'sql', 'select * from x', 'select_star'), (4, 'logging', 'print(''a;b'')', ''), (5, 'control', 'if x then', ''), (6, 'error', 'raise y', ''), (7, 'sql', 'insert into m.n select a from p cross join q where b = ''--;'' order by a', 'cross_join,insert_without_columns,order_without_limit')""",
)
def script_fragments(spark, sf_dir):
    rows = [(line, kind, resolved, ",".join(sqltext.lint(statement))) for line, kind, statement, resolved in scripts.statements(_SCRIPT)]
    return spark.createDataFrame(rows, "line int, kind string, resolved string, lint string")


@expects("line:INTEGER symbol arguments named", "(4, 'print', '''a;b''', ''), (1, 'run', 'f(1, 2)|$x', 'mode=full'), (1, 'f', '1|2', '')")
def script_calls(spark, sf_dir):
    rows = spark.createDataFrame([("a", _SCRIPT), ("b", "run(f(1, 2), mode=full, $x)")], "file string, text string")
    named = F.array_join(F.transform(F.map_entries("named"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return scripts.script_facts(rows, "calls").select("line", "symbol", F.array_join("positional", "|").alias("arguments"), named.alias("named"))


@expects("name kind value", "('a', 'literal', 'x'), ('b', 'literal', 'xy'), ('c', 'template', '${z}/x'), ('d', 'expression', NULL), ('e', 'reference', '$a')")
def script_variables(spark, sf_dir):
    rows = spark.createDataFrame([("a", "let a = 'x'; let b = $a + 'y'; let c = '${z}/' + $a; let d = f($a); let e = $a")], "file string, text string")
    return scripts.script_facts(rows, "variables").select("name", "kind", "value")


@expects("sql read_names written_names", "('insert into a.b select 1 from c.d join e on (x y', 'c.d,e', 'a.b'), ('create view v as select', '', 'v')")
def regex_fallback(spark, sf_dir):
    texts = ["insert into a.b select 1 from c.d join e on (x y", "create view v as select"]
    return spark.createDataFrame([(t, *(",".join(x) for x in sqltext.regex_relations(t))) for t in texts], "sql string, read_names string, written_names string")


@query("""SELECT p_partkey, p_type FROM part WHERE p_type = 'PROMO' AND json_contains(CAST(to_json([p_brand, p_name]) AS JSON), '"Brand#7"')""")
def json_membership(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("names", F.to_json(F.array("p_brand", "p_name")))
    return part.where(search.equals(p_type="PROMO", p_brand=None) & search.json_member("names", "Brand#7")).select("p_partkey", "p_type")


@query("""SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 'primary' ELSE 'other' END AS key_kind FROM part ORDER BY CASE WHEN p_type = 'PROMO' THEN 0 ELSE 1 END, p_partkey LIMIT 50""")
def ordered_by_kind(spark, sf_dir):
    kind = F.when(F.col("p_type") == "PROMO", "primary").otherwise("other")
    part = table(spark, sf_dir, "part").select("p_partkey", kind.alias("key_kind"))
    return paging.page(part, [F.when(F.col("key_kind") == "primary", 0).otherwise(1), "p_partkey"], 50)


@query("""WITH f AS (SELECT substr(sha256('{"p_type":"PROMO"}'), 1, 24) AS f) SELECT o AS "offset", replace(replace(to_base64(encode('{"v":1,"q":"parts","f":"' || f || '","o":' || o || '}')), '+', '-'), '/', '_') AS token FROM f, (VALUES (0), (100), (12345)) v(o)""")
def page_tokens(spark, sf_dir):
    tokens = [(o, paging.encode_token("parts", {"p_type": "PROMO"}, o)) for o in (0, 100, 12345)]
    assert [paging.decode_token(t, "parts", {"p_type": "PROMO"}) for _, t in tokens] == [o for o, _ in tokens]
    return spark.createDataFrame(tokens, "offset int, token string")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS key, CAST(json_object('n_name', n_name, 'n_nationkey', n_nationkey, 'n_regionkey', n_regionkey) AS VARCHAR) AS line FROM nation""")
def canonical_lines(spark, sf_dir):
    return products.canonical_lines(table(spark, sf_dir, "nation"), "n_nationkey")


# Interactions, models and flows


def _interactions(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    call = "interface_id string, repo_id string, method string, path string, authority string, service string, base_property string"
    calls = [("c1", "a", "GET", "/api/x/1", "svc.b", None, None), ("c2", "a", "GET", "/x/{id}", None, "b", None), ("c3", "a", "POST", "/x/1", "localhost", None, None), ("c4", "a", "GET", "/y", None, None, None), ("c5", "b", "GET", "/api/x/1", "svc.b", None, None), ("c6", "a", "GET", "/api/x/2", None, None, "b")]
    routes = [("r1", "b", "GET", "/api/x/{id}", "svc.b", "b"), ("r2", "c", "GET", "/y", None, "c"), ("r3", "d", "", "/y", None, "d")]
    return spark.createDataFrame(calls, call), spark.createDataFrame(routes, "interface_id string, repo_id string, method string, path string, authority string, service string")


@expects(
    "interface_id candidate_count:BIGINT status target_id confidence",
    "('c1', 1, 'matched', 'r1', 'confirmed'), ('c2', 1, 'matched', 'r1', 'probable'), ('c3', 0, 'unresolved', NULL, 'unknown'), ('c4', 2, 'ambiguous', NULL, 'unknown'), ('c5', 0, 'unresolved', NULL, 'unknown'), ('c6', 1, 'matched', 'r1', 'probable')",
)
def interaction_matches(spark, sf_dir):
    return interactions.match(*_interactions(spark)).select("interface_id", "candidate_count", "status", "target_id", "confidence")


@expects("repo_id outbound:BIGINT matched:BIGINT ambiguous:BIGINT unresolved:BIGINT coverage_status", "('a', 5, 3, 1, 1, 'partial'), ('b', 1, 0, 0, 1, 'partial'), ('z', 0, 0, 0, 0, 'not_applicable')")
def interaction_coverage(spark, sf_dir):
    repositories = spark.createDataFrame([("a",), ("b",), ("z",)], "repo_id string")
    return interactions.repository_coverage(repositories, interactions.match(*_interactions(spark)))


@expects("interface_id normal_path source_path target_path status", "('c1', 'user.id', 'user.ID', 'User.id', 'matched'), ('c1', 'extra', 'extra', NULL, 'missing_in_target'), ('c1', 'name', NULL, 'name', 'missing_in_source')")
def field_contracts(spark, sf_dir):
    matched = interactions.match(*_interactions(spark)).where("interface_id = 'c1'")
    requests = spark.createDataFrame([("c1", "user.ID"), ("c1", "extra"), ("c2", "x")], "interface_id string, wire_path string")
    members = spark.createDataFrame([("r1", "User.id"), ("r1", "name"), ("r2", "y")], "interface_id string, wire_path string")
    found = interactions.field_contracts(requests, members, matched)
    return found.join(matched.select("interaction_id", "interface_id"), "interaction_id").drop("interaction_id")


def _model(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    entities = spark.createDataFrame([("e1", "entity", '"S".T'), ("e2", "entity", None), ("e3", "embeddable", None), ("e4", "entity", "s.u")], "entity_id string, kind string, table_name string")
    tables = spark.createDataFrame([("t1", "s.t"), ("t2", "s.u"), ("t3", "S.U"), ("t4", "s.v")], "table_id string, name string")
    fields = spark.createDataFrame([("f1", "e1", "A"), ("f2", "e1", "zz"), ("f3", "e4", "a"), ("f4", "e3", "a")], "field_id string, entity_id string, column_name string")
    columns = spark.createDataFrame([("c1", "t1", "a"), ("c2", "t2", "a")], "column_id string, table_id string, name string")
    return entities, tables, fields, columns


@expects("entity_id candidate_count:BIGINT status table_id gap_kind", "('e1', 1, 'matched', 't1', NULL), ('e2', 0, 'unresolved', NULL, 'explicit_name_missing'), ('e3', 0, 'not_applicable', NULL, NULL), ('e4', 2, 'ambiguous', NULL, 'ambiguous_table')")
def entity_mapping(spark, sf_dir):
    entities, tables, _, _ = _model(spark)
    return mapping.map_entities(entities, tables).select("entity_id", "candidate_count", "status", "table_id", "gap_kind")


@expects("entity_id field_id table_id entity_status column_id field_status", "('e1', 'f1', 't1', 'matched', 'c1', 'matched'), ('e1', 'f2', 't1', 'matched', NULL, 'unresolved'), ('e2', NULL, NULL, 'unresolved', NULL, NULL), ('e3', 'f4', NULL, 'not_applicable', NULL, 'not_applicable'), ('e4', 'f3', NULL, 'ambiguous', NULL, 'unresolved')")
def effective_model(spark, sf_dir):
    entities, tables, fields, columns = _model(spark)
    mapped = mapping.map_entities(entities, tables)
    return mapping.effective_model(entities, mapped, fields, mapping.map_fields(fields, mapped, columns)).select("entity_id", "field_id", "table_id", "entity_status", "column_id", "field_status")


@expects("table_id", "('t2'), ('t3'), ('t4')")
def unmapped_tables(spark, sf_dir):
    entities, tables, _, _ = _model(spark)
    return mapping.unmapped(tables, mapping.map_entities(entities, tables)).select("table_id")


@expects("reference_id candidate_count:BIGINT status readiness key_id", "('r1', 1, 'strongly_supported', 'executable_storage_join', 'k1'), ('r2', 2, 'ambiguous', 'ambiguous', NULL), ('r3', 0, 'unresolved', 'not_ready', NULL)")
def signature_joins(spark, sf_dir):
    references = spark.createDataFrame([("r1", '{"op":"concat","args":[{"field":"x"},":",{"field":"y"}]}', True), ("r2", '{"field":"q"}', True), ("r3", "{", False)], "reference_id string, tree string, single boolean")
    keys = spark.createDataFrame([("k1", '{"op":"concat","args":[{"field":"a"},":",{"field":"b"}]}'), ("k2", '{"field":"m"}'), ("k3", '{"field":"n"}')], "key_id string, tree string")
    return mapping.storage_joins(references, keys)


def _flows(spark: SparkSession) -> DataFrame:
    rows = [("a", "b", "assignment", "x", "confirmed"), ("b", "c", "return_flow", "sha256(x)", "probable"), ("a", "c", "assignment", "x + y", "confirmed"), ("c", "d", "assignment", "x", "confirmed")]
    return valueflow.edges(spark.createDataFrame(rows, "source_id string, target_id string, flow_kind string, expression string, confidence string"))


@expects("source_id target_id transformation_kind value_preservation confidence", "('a', 'b', 'identity', 'preserved', 'confirmed'), ('b', 'c', 'hashed', 'transformed', 'probable'), ('a', 'c', 'combined', 'partially_preserved', 'confirmed'), ('c', 'd', 'identity', 'preserved', 'confirmed')")
def flow_edges(spark, sf_dir):
    return _flows(spark).select("source_id", "target_id", "transformation_kind", "value_preservation", "confidence")


@expects("target_id source_count:BIGINT derivation_kind", "('b', 1, 'direct'), ('c', 2, 'combined'), ('d', 1, 'direct')")
def derivations(spark, sf_dir):
    return valueflow.derivations(_flows(spark)).select("target_id", "source_count", "derivation_kind")


@expects("path hops:INTEGER confidence complete:BOOLEAN stop_reason", "('a>c>d', 2, 'confirmed', true, NULL), ('a>b>c>d', 3, 'probable', true, NULL)")
def attribute_paths(spark, sf_dir):
    one = lambda x: spark.createDataFrame([(x,)], "n string")
    paths = valueflow.attribute_paths(_flows(spark), one("a"), one("d"))[0]
    return paths.select(graph.path_text().alias("path"), "hops", "confidence", "complete", "stop_reason")


@expects("source_id target_id flow_kind confidence", "('s1', 't1', 'transport', 'confirmed')")
def transport_edges(spark, sf_dir):
    contracts = spark.createDataFrame([("i", "user.id", "matched"), ("i", "x", "missing_in_target")], "interaction_id string, normal_path string, status string")
    node = "interaction_id string, normal_path string, node_id string"
    return valueflow.transport_edges(contracts, spark.createDataFrame([("i", "user.id", "s1"), ("i", "x", "s2")], node), spark.createDataFrame([("i", "user.id", "t1"), ("j", "user.id", "t2")], node))


@expects("ref status node_id", "('n1', 'matched', 'n1'), ('y', 'matched', 'n2'), ('o', 'ambiguous', NULL), ('?', 'not_found', NULL)")
def flow_endpoints(spark, sf_dir):
    nodes = spark.createDataFrame([("n1", "x", "o"), ("n2", "y", "o")], "node_id string, display_ref string, owner_ref string")
    return valueflow.resolve_endpoint(nodes, spark.createDataFrame([("n1",), ("y",), ("o",), ("?",)], "ref string"))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, n_nationkey - 5 AS b FROM nation WHERE n_nationkey >= 5), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT n_nationkey AS node, n_nationkey AS other FROM nation UNION SELECT node, b FROM w JOIN u ON a = other) SELECT node, min(other) AS component FROM w GROUP BY node""")
def entity_clusters(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))
    edges = n.where("node >= 5").select(F.col("node").alias("a"), (F.col("node") - 5).alias("b"))
    return graph.components(n, edges, "node", "a", "b")


# Products


@expects("slot digest ordinal:BIGINT active:BOOLEAN", "('a', 'd1', 1, false), ('b', 'd2', 1, false), ('a', 'd1', 2, true), ('b', 'd3', 2, true)")
def revisions(spark, sf_dir):
    first = catalog.publish_revision(spark.createDataFrame([], catalog.REVISION), "s", {"a": "d1", "b": "d2"})
    return catalog.publish_revision(first, "s", {"b": "d3"}).select("slot", "digest", "ordinal", "active")


@expects("node input_print digest decision", "('n', 'p', 'd1', 'reuse'), ('n', 'q', NULL, 'build')")
def reuse_decisions(spark, sf_dir):
    wanted = spark.createDataFrame([("n", "p"), ("n", "q")], "node string, input_print string")
    return catalog.reuse(wanted, spark.createDataFrame([("n", "p", "d1")], "node string, input_print string, digest string"))


@query("""SELECT 'nation' AS relation, count(*) AS n FROM nation UNION ALL SELECT 'absent', 0""")
def catalog_union(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    half = lambda r: catalog.Catalog(spark, {"nation": nation.schema, "absent": "x string"}, {"nation": nation.where(F.col("n_nationkey") % 2 == r)})
    both = half(0).union(half(1))
    parts = [both.relation(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n") for name in ("nation", "absent")]
    return parts[0].unionByName(parts[1])
