"""Declared values: enumerations, maps and literal tables in code and data files; and change logs in YAML as schema facts."""

from __future__ import annotations

import ast
import csv
import io
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.sqltext import split_statements
from tracewright.sources.files import json_scalars, schema_facts, yaml_scalars

Value = tuple[str, str, str | None, str | None]  # kind, name of the set, key, value


def python_values(text: str) -> Iterator[Value]:
    """Members of enumerations, and constants that are collections of literals."""
    for node in ast.walk(ast.parse(text)):
        if isinstance(node, ast.ClassDef) and any(ast.unparse(b).rpartition(".")[2] in ("Enum", "StrEnum", "IntEnum") for b in node.bases):
            for x in node.body:
                if isinstance(x, ast.Assign) and isinstance(x.targets[0], ast.Name) and isinstance(x.value, ast.Constant):
                    yield "enum", node.name, x.targets[0].id, str(x.value.value)
        elif isinstance(node, ast.Assign) and isinstance(node.targets[0], ast.Name) and node.targets[0].id.isupper():
            try:
                value = ast.literal_eval(node.value)
            except ValueError:
                continue
            if isinstance(value, dict):
                yield from (("map", node.targets[0].id, str(k), str(v)) for k, v in value.items() if not isinstance(v, dict | list | set | tuple))
            elif isinstance(value, list | tuple | set):
                yield from (("list", node.targets[0].id, None, str(v)) for v in sorted(value, key=str) if not isinstance(v, dict | list | set | tuple))


def java_values(text: str) -> Iterator[Value]:
    """Constants of enumerations, with their arguments as written."""
    bare = re.sub(r"/\*.*?\*/|//[^\n]*", " ", text, flags=re.S)
    for m in re.finditer(r"\benum\s+(\w+)[^{]*\{([^;}]*)", bare):
        for c in re.finditer(r"\b([A-Z]\w*)\s*(?:\(((?:[^()\"]|\"[^\"]*\")*)\))?\s*(?:,|$)", m[2].strip()):
            yield "enum", m[1], c[1], c[2].strip() if c[2] else None


def delimited_values(text: str, delimiter: str) -> Iterator[Value]:
    """Cells of a table with a head, by column."""
    rows = list(csv.reader(io.StringIO(text), delimiter=delimiter))
    for number, row in enumerate(rows[1:], 1):
        yield from (("column", head, str(number), cell) for head, cell in zip(rows[0], row, strict=False))


def toml_values(text: str) -> Iterator[Value]:
    for path, name, value in json_scalars(tomllib.loads(text)):
        yield "setting", path.rpartition(".")[0], name, value


def xml_values(text: str) -> Iterator[Value]:
    """Texts of leaf elements and attributes, by the element around them."""
    todo = [ET.fromstring(text)]
    for e in todo:
        local = e.tag.rpartition("}")[2]
        yield from (("attribute", local, k.rpartition("}")[2], v) for k, v in e.attrib.items())
        for x in e:
            if not len(x) and (x.text or "").strip():
                yield "element", local, x.tag.rpartition("}")[2], x.text.strip()
        todo += list(e)


def sql_values(text: str) -> Iterator[Value]:
    """Rows of ``INSERT ... (columns) VALUES (...)`` whose cells are literals."""
    for _, sql in split_statements(text):
        m = re.match(r"insert\s+into\s+([\w.\"`]+)\s*\(([^)]*)\)\s*values\s*(.*)$", sql, re.I | re.S)
        for row in re.finditer(r"\(((?:'(?:[^']|'')*'|[^()'])*)\)", m[3]) if m else ():
            cells = re.findall(r"'((?:[^']|'')*)'|([^\s,']+)", row[1])
            yield from (("row", m[1], c.strip(' "`'), a.replace("''", "'") if a or not b else b) for c, (a, b) in zip(m[2].split(","), cells, strict=False))


READERS: dict[str, Callable[[str], Iterator[Value]]] = {
    "py": python_values,
    "java": java_values,
    "csv": lambda text: delimited_values(text, ","),
    "tsv": lambda text: delimited_values(text, "\t"),
    "toml": toml_values,
    "xml": xml_values,
    "sql": sql_values,
}


def _rows(files: DataFrame, read: Callable[[str, str], Iterator[tuple]], ddl: str) -> DataFrame:
    fields = [x.split() for x in ddl.split(", ")]
    schema = pa.schema([(name, pa.int32() if kind == "int" else pa.string()) for name, kind in fields])

    def run(batches):
        for batch in batches:
            out = []
            for path, suffix, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    out += [(path, *row) for row in read(suffix, text or "")]
                except (SyntaxError, ValueError, ET.ParseError, csv.Error):
                    out.append((path, "unreadable", *[None] * (len(fields) - 2)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return files.select("path", "suffix", "text").mapInArrow(run, ddl)


def declared_values(files: DataFrame) -> DataFrame:
    """path, kind, set_name, key, value of files (path, suffix, text); what can't be read gives one ``unreadable`` row."""
    return _rows(files.where(F.col("suffix").isin(*READERS)), lambda suffix, text: READERS[suffix](text), "path string, kind string, set_name string, key string, value string")


def changelog_facts(text: str) -> Iterator[tuple[str, str | None, str | None, str | None, str | None, int]]:
    """(kind, table, name, type or columns, reference, change set) of a change log in YAML: tables, columns, keys, references, drops and renames."""
    sets: dict[int, dict[tuple[int, str], dict[str, str]]] = {}
    for path, _, value in yaml_scalars(text):
        m = re.match(r"databaseChangeLog\[(\d+)\]\.changeSet\.changes\[(\d+)\]\.(\w+)\.(.+)$", path)
        if m and value is not None:
            sets.setdefault(int(m[1]), {}).setdefault((int(m[2]), m[3]), {})[m[4]] = value
    for number, changes in sorted(sets.items()):
        for (_, change), given in sorted(changes.items()):
            table = ".".join(x for x in (given.get("schemaName"), given.get("tableName")) if x) or None
            if change in ("createTable", "addColumn"):
                if change == "createTable":
                    yield "table", table, table, None, None, number
                columns = sorted({int(m[1]) for k in given if (m := re.match(r"columns\[(\d+)\]\.", k))})
                for c in columns:
                    own = lambda name: given.get(f"columns[{c}].column.{name}")  # noqa: B023, E731
                    yield "column", table, own("name"), own("type"), None, number
                    if (own("constraints.primaryKey") or "").lower() == "true":
                        yield "primary_key", table, None, own("name"), None, number
            elif change in ("addPrimaryKey", "addUniqueConstraint"):
                yield "primary_key" if change == "addPrimaryKey" else "unique", table, given.get("constraintName"), given.get("columnNames"), None, number
            elif change == "addForeignKeyConstraint":
                yield "foreign_key", given.get("baseTableName"), given.get("constraintName"), given.get("baseColumnNames"), f"{given.get('referencedTableName')}({given.get('referencedColumnNames')})", number
            elif change == "createIndex":
                names = ",".join(v for k, v in given.items() if k.endswith("column.name"))
                yield "unique_index" if given.get("unique", "").lower() == "true" else "index", table, given.get("indexName"), names, None, number
            elif change == "dropTable":
                yield "drop", table, None, None, None, number
            elif change == "renameTable":
                yield "rename", given.get("oldTableName"), given.get("newTableName"), None, None, number


_SCHEMA = "path string, kind string, table_name string, name string, detail string, reference string, line int"


def changelogs(files: DataFrame) -> DataFrame:
    """Schema facts of YAML change logs, in the form of ``files.schema_facts``; ``line`` is the number of the change set."""
    logs = files.where(F.col("suffix").isin("yaml", "yml") & F.contains("text", F.lit("databaseChangeLog")))
    return _rows(logs, lambda _, text: changelog_facts(text), _SCHEMA)


def database_schema(files: DataFrame) -> DataFrame:
    """Schema facts of all sources: DDL, change logs, and generated table classes, each with its source."""
    from tracewright.sources.code import code_facts

    generated = code_facts(files.select("path", "text")).where("reader = 'jooq' and kind <> 'unreadable'")
    kind = F.when(F.col("kind") == "unique_key", "unique").otherwise(F.col("kind"))
    table = F.coalesce("owner", "name")
    own = generated.select("path", kind.alias("kind"), table.alias("table_name"), "name", "detail", F.lit(None).cast("string").alias("reference"), "line")
    parts = {"ddl": schema_facts(files), "changelog": changelogs(files), "generated": own}
    out = None
    for source, df in parts.items():
        df = df.withColumn("source", F.lit(source))
        out = df if out is None else out.unionByName(df)
    return out
