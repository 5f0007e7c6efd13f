"""Facts in source code and interface descriptions.

Each reader takes one file's text and yields (kind, owner, name, detail, line); ``code_facts`` runs them over files in Arrow batches. Readers of
languages without a parser here work on declarations alone and say nothing of what they don't understand.
"""

from __future__ import annotations

import ast
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Fact = tuple[str, str | None, str | None, str | None, int]


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def python_facts(text: str) -> Iterator[Fact]:
    """Imports, classes with bases, functions, and strings that hold SQL."""
    todo: list[tuple[ast.AST, str | None]] = [(ast.parse(text), None)]
    while todo:
        node, owner = todo.pop()
        inner = owner
        if isinstance(node, ast.ClassDef):
            inner = f"{owner}.{node.name}" if owner else node.name
            yield "class", owner, node.name, ",".join(ast.unparse(b) for b in node.bases), node.lineno
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            inner = f"{owner}.{node.name}" if owner else node.name
            yield "function", owner, node.name, ",".join(a.arg for a in node.args.args), node.lineno
        elif isinstance(node, ast.Import):
            for a in node.names:
                yield "import", owner, a.name, a.asname, node.lineno
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                yield "import", owner, f"{'.' * node.level}{node.module or ''}.{a.name}", a.asname, node.lineno
        elif isinstance(node, ast.Constant) and isinstance(node.value, str) and re.match(r"(?is)\s*(select|insert|create|merge|update|delete|with)\s.+\b(from|into|table|view|set)\b", node.value):
            yield "sql", owner, None, node.value.strip(), node.lineno
        todo += [(child, inner) for child in ast.iter_child_nodes(node)]


_MAPPINGS = {"Get": "GET", "Post": "POST", "Put": "PUT", "Delete": "DELETE", "Patch": "PATCH"}


def java_facts(text: str) -> Iterator[Fact]:
    """Package, types with parents and annotations, fields with annotations, and mapped HTTP endpoints."""
    bare = re.sub(r"/\*.*?\*/|//[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    package = m[1] if (m := re.search(r"\bpackage\s+([\w.]+)\s*;", bare)) else ""
    types = list(re.finditer(r"((?:@\w+(?:\([^)]*\))?\s*)*)(?:(?:public|protected|private|abstract|final|static|sealed)\s+)*(class|interface|enum|record)\s+(\w+)(?:<[^{>]*>)?(?:\s*\([^)]*\))?(?:\s+extends\s+([\w.<>, ]+?))?(?:\s+implements\s+([\w.<>, ]+?))?\s*\{", bare))
    for i, t in enumerate(types):
        name, line = f"{package}.{t[3]}" if package else t[3], _line(bare, t.start(2))
        yield t[2], package or None, name, None, line
        for parent in re.split(r"\s*,\s*", ", ".join(x for x in (t[4], t[5]) if x)):
            if parent:
                yield "inherits", name, re.sub(r"<.*", "", parent), None, line
        base = ""
        for a in re.finditer(r"@(\w+)(?:\(([^)]*)\))?", t[1]):
            yield "annotation", name, a[1], a[2], line
            if a[1] == "RequestMapping" and (p := re.search(r"\"([^\"]*)\"", a[2] or "")):
                base = p[1]
        body = bare[t.end() : types[i + 1].start() if i + 1 < len(types) else len(bare)]
        offset = t.end()
        for f in re.finditer(r"((?:@\w+(?:\([^)]*\))?\s*)*)(?:private|protected|public)\s+(?:final\s+|static\s+)*([\w.<>\[\], ]+?)\s+(\w+)\s*(?:=[^;]*)?;", body):
            at = _line(bare, offset + f.start(3))
            yield "field", name, f[3], f[2], at
            for a in re.finditer(r"@(\w+)(?:\(([^)]*)\))?", f[1]):
                yield "field_annotation", f"{name}.{f[3]}", a[1], a[2], at
        for e in re.finditer(r"@(Get|Post|Put|Delete|Patch)Mapping(?:\(\s*(?:(?:value|path)\s*=\s*)?(?:\"([^\"]*)\")?[^)]*\))?", body):
            yield "endpoint", name, f"{base}/{(e[2] or '').lstrip('/')}".rstrip("/") or "/", _MAPPINGS[e[1]], _line(bare, offset + e.start())


def jooq_facts(text: str) -> Iterator[Fact]:
    """Tables, columns, keys and indexes of generated table classes."""
    table = m[1] if (m := re.search(r"super\(\s*DSL\.name\(\"([^\"]+)\"\)", text)) or (m := re.search(r"this\(\s*DSL\.name\(\"([^\"]+)\"\)", text)) else None
    if table:
        yield "table", None, table, None, 1
    for c in re.finditer(r"createField\(\s*DSL\.name\(\"([^\"]+)\"\)\s*,\s*(?:[\w.]*\.)?([A-Z_0-9]+(?:\([^)]*\))?)([^;]*);", text):
        yield "column", table, c[1], f"{c[2]}{' not null' if 'nullable(false)' in c[3] else ''}", _line(text, c.start())
    for k in re.finditer(r"Internal\.create(UniqueKey|ForeignKey|Index)\(([^;]*)\);", text):
        names = re.findall(r"DSL\.name\(\"([^\"]+)\"\)", k[2])
        columns = re.findall(r"\b[A-Z]\w*\.[A-Z_0-9]+\.([A-Z_0-9]+)", k[2])
        yield {"UniqueKey": "unique_key", "ForeignKey": "foreign_key", "Index": "index"}[k[1]], table, names[0] if names else None, ",".join(columns).lower(), _line(text, k.start())
    for s in re.finditer(r"Internal\.createSequence\(\"([^\"]+)\"", text):
        yield "sequence", None, s[1], None, _line(text, s.start())


def _flat(schema: object, known: dict, prefix: str = "", depth: int = 0) -> Iterator[tuple[str, str]]:
    """Dotted paths and types of a nested schema, three levels deep."""
    if not isinstance(schema, dict) or depth > 3:
        return
    if "$ref" in schema:
        schema = known.get(str(schema["$ref"]).rpartition("/")[2], {})
    if schema.get("type") == "array":
        yield from _flat(schema.get("items"), known, f"{prefix}[]", depth)
        return
    for name, inner in (schema.get("properties") or {}).items():
        path = f"{prefix}.{name}".lstrip(".")
        yield path, str(inner.get("type") or str(inner.get("$ref", "")).rpartition("/")[2])
        yield from _flat(inner, known, path, depth + 1)


def openapi_facts(text: str) -> Iterator[Fact]:
    """Schemas with their fields, and operations, of an OpenAPI document in JSON."""
    doc = json.loads(text)
    schemas = (doc.get("components") or {}).get("schemas") or doc.get("definitions") or {}
    for name, schema in schemas.items():
        yield "schema", None, name, schema.get("type"), 1
        for path, kind in _flat(schema, schemas):
            yield "schema_field", name, path, kind, 1
    for path, item in (doc.get("paths") or {}).items():
        for method, operation in item.items():
            if method.lower() in ("get", "post", "put", "delete", "patch", "head", "options"):
                yield "endpoint", operation.get("operationId"), path, method.upper(), 1


def gradle_facts(text: str) -> Iterator[Fact]:
    """Modules, plugins and dependencies of a build script."""
    for m in re.finditer(r"\binclude\s*\(?\s*((?:[\"'][^\"']+[\"']\s*,?\s*)+)", text):
        for name in re.findall(r"[\"']([^\"']+)[\"']", m[1]):
            yield "module", None, name, None, _line(text, m.start())
    for m in re.finditer(r"\bid\s*\(?\s*[\"']([^\"']+)[\"']\)?(?:\s+version\s+[\"']([^\"']+)[\"'])?", text):
        yield "plugin", None, m[1], m[2], _line(text, m.start())
    for m in re.finditer(r"\b(implementation|api|compileOnly|runtimeOnly|testImplementation|annotationProcessor|compile)\s*\(?\s*(?:project\(\s*[\"']([^\"']+)[\"']\s*\)|[\"']([^\"':]+):([^\"':]+)(?::([^\"']+))?[\"'])", text):
        yield "dependency", m[1], m[2] or f"{m[3]}:{m[4]}", m[5], _line(text, m.start())


def model_facts(text: str) -> Iterator[Fact]:
    """Tables, columns, keys and references of a physical model in XML, whatever its namespaces; ids link them."""
    local = lambda e: e.tag.rpartition("}")[2]

    def own(e: ET.Element, name: str) -> str | None:
        return next((x.text for x in e if local(x) == name and x.text), None)

    def refs(e: ET.Element, group: str) -> list[str]:
        return [x.get("Ref") or "" for g in e if local(g) == group for x in g if x.get("Ref")]

    for e in ET.fromstring(text).iter():
        if e.get("Id") is None:
            continue
        if local(e) == "Table":
            yield "table", None, own(e, "Code"), e.get("Id"), 1
            for group in e:
                for x in group:
                    if local(group) == "Columns" and x.get("Id"):
                        yield "column", e.get("Id"), own(x, "Code"), own(x, "DataType"), 1
                    elif local(group) == "Keys" and x.get("Id"):
                        yield "key", e.get("Id"), own(x, "Code"), ",".join(refs(x, "Key.Columns")), 1
        elif local(e) == "Reference":
            yield "reference", (refs(e, "ParentTable") or [None])[0], own(e, "Code"), (refs(e, "ChildTable") or [None])[0], 1


READERS: dict[str, tuple[str, Callable[[str], Iterator[Fact]]]] = {
    "python": (r"\.py$", python_facts),
    "jooq": (r"(?i)/(jooq|generated)/.*\.java$", jooq_facts),
    "java": (r"\.java$", java_facts),
    "openapi": (r"(?i)(openapi|swagger)[^/]*\.json$", openapi_facts),
    "gradle": (r"\.gradle(\.kts)?$", gradle_facts),
    "model": (r"(?i)\.(pdm|xml)$", model_facts),
}
_DDL = "path string, reader string, kind string, owner string, name string, detail string, line int"


def code_facts(files: DataFrame) -> DataFrame:
    """Facts of files (path, text) by the readers whose pattern fits; what a reader can't take gives one ``unreadable`` row."""
    names = [x.split()[0] for x in _DDL.split(", ")]
    schema = pa.schema([(n, pa.int32() if n == "line" else pa.string()) for n in names])

    def run(batches):
        for batch in batches:
            out = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for reader, (pattern, read) in READERS.items():
                    if re.search(pattern, path):
                        try:
                            out += [(path, reader, *fact) for fact in read(text or "")]
                        except (SyntaxError, ValueError, AttributeError, ET.ParseError) as e:
                            out.append((path, reader, "unreadable", None, None, type(e).__name__, 1))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return files.select("path", F.col("text")).mapInArrow(run, _DDL)


_COMMIT = "\x1e"
#: The format whose output ``git_log`` reads: git log --numstat --format=GIT_FORMAT
GIT_FORMAT = "%x1e%H%x1f%an%x1f%ae%x1f%aI%x1f%s"


def git_log(text: str) -> tuple[list[tuple[str, str, str, str, str]], list[tuple[str, str, int | None, int | None]]]:
    """(commits, changed files) of a log; binary files have null counts."""
    commits, changes = [], []
    for part in text.split(_COMMIT)[1:]:
        head, _, rest = part.partition("\n")
        digest, author, mail, date, subject = head.split("\x1f", 4)
        commits.append((digest, author, mail.lower(), date, subject))
        for line in rest.splitlines():
            if m := re.match(r"(\d+|-)\t(\d+|-)\t(.+)$", line):
                changes.append((digest, m[3], None if m[1] == "-" else int(m[1]), None if m[2] == "-" else int(m[2])))
    return commits, changes


def people(commits: DataFrame) -> DataFrame:
    """Commits per person (by mail), with the names and the time span they were seen in."""
    return commits.groupBy("mail").agg(F.count("*").alias("n_commits"), F.array_join(F.array_sort(F.collect_set("author")), ",").alias("names"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def change_summary(changes: DataFrame) -> DataFrame:
    """Files and lines changed per suffix."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return changes.groupBy(suffix.alias("suffix")).agg(F.count_distinct("path").alias("n_files"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))
