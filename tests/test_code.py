from tracewright.sources import code


def test_python():
    got = set(code.python_facts("import os as o\nfrom .a import b\nclass C(D):\n  def f(self, x):\n    return 'SELECT 1 FROM t'\n"))
    assert got == {("import", None, "os", "o", 1), ("import", None, ".a.b", None, 2), ("class", None, "C", "D", 3), ("function", "C", "f", "self,x", 4), ("sql", "C.f", None, "SELECT 1 FROM t", 5)}


def test_java():
    text = '''package a.b;
/* class No {} */
@Entity @Table(name = "t")
public class C extends D<X> implements E, F {
  @Column(name = "n")
  private String name;
}
@RequestMapping("/api")
class R { @GetMapping("/x/{id}") String x() { return ""; } @PostMapping String y() { return ""; } }
'''
    got = list(code.java_facts(text))
    assert ("class", "a.b", "a.b.C", None, 4) in got and {f[2] for f in got if f[0] == "inherits"} == {"D", "E", "F"}
    assert ("field", "a.b.C", "name", "String", 6) in got and ("field_annotation", "a.b.C.name", "Column", 'name = "n"', 6) in got
    assert {(f[2], f[3]) for f in got if f[0] == "endpoint"} == {("/api/x/{id}", "GET"), ("/api", "POST")}


def test_generated_and_described():
    jooq = 'super(DSL.name("T"), null); f = createField(DSL.name("A"), SQLDataType.INTEGER.nullable(false), this, ""); k = Internal.createUniqueKey(T.T, DSL.name("PK"), new F[] { T.T.A }, true);'
    assert [f[:4] for f in code.jooq_facts(jooq)] == [("table", None, "T", None), ("column", "T", "A", "INTEGER not null"), ("unique_key", "T", "PK", "a")]
    api = '{"paths": {"/x": {"get": {"operationId": "o"}}}, "components": {"schemas": {"S": {"type": "object", "properties": {"a": {"type": "string"}, "r": {"$ref": "#/components/schemas/Q"}}}, "Q": {"properties": {"z": {"type": "integer"}}}}}}'
    got = {f[:4] for f in code.openapi_facts(api)}
    assert {("endpoint", "o", "/x", "GET"), ("schema_field", "S", "a", "string"), ("schema_field", "S", "r.z", "integer")} <= got


def test_gradle_and_model():
    got = {f[:4] for f in code.gradle_facts("plugins { id 'java' version '1' }\ninclude 'a', ':b'\ndependencies { implementation 'g:n:1.0'\n api(project(':b')) }")}
    assert got == {("plugin", None, "java", "1"), ("module", None, "a", None), ("module", None, ":b", None), ("dependency", "implementation", "g:n", "1.0"), ("dependency", "api", ":b", None)}
    xml = '<M xmlns:o="o" xmlns:c="c" xmlns:a="a"><o:Table Id="t1"><a:Code>T</a:Code><c:Columns><o:Column Id="c1"><a:Code>A</a:Code><a:DataType>int</a:DataType></o:Column></c:Columns><c:Keys><o:Key Id="k"><a:Code>PK</a:Code><c:Key.Columns><o:Column Ref="c1"/></c:Key.Columns></o:Key></c:Keys></o:Table><o:Reference Id="r"><a:Code>R</a:Code><c:ParentTable><o:Table Ref="t1"/></c:ParentTable><c:ChildTable><o:Table Ref="t2"/></c:ChildTable></o:Reference></M>'
    assert [f[:4] for f in code.model_facts(xml)] == [("table", None, "T", "t1"), ("column", "t1", "A", "int"), ("key", "t1", "PK", "c1"), ("reference", "t1", "R", "t2")]


def test_git_log():
    log = "\x1eh1\x1fAnn\x1fA@x\x1f2024-01-01\x1fone\n\n3\t1\ta.py\n-\t-\tb.png\n\x1eh2\x1fBob\x1fb@x\x1f2024-01-02\x1ftwo\n"
    commits, changes = code.git_log(log)
    assert [c[0] for c in commits] == ["h1", "h2"] and changes == [("h1", "a.py", 3, 1), ("h1", "b.png", None, None)]


def test_over_files(spark):
    files = spark.createDataFrame([("a.py", "def f(): pass"), ("b.py", "def"), ("x/openapi.json", "{"), ("c.txt", "")], "path string, text string")
    got = {(r.path, r.reader, r.kind) for r in code.code_facts(files).collect()}
    assert got == {("a.py", "python", "function"), ("b.py", "python", "unreadable"), ("x/openapi.json", "openapi", "unreadable")}
    people = code.people(spark.createDataFrame(code.git_log("\x1eh\x1fA\x1fm\x1fd\x1fs\n")[0], "digest string, author string, mail string, date string, subject string")).collect()
    assert people[0].n_commits == 1
