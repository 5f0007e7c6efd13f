"""Files of repositories as rows, and the facts in them.

Files are listed and read by Spark's own sources; parsing runs in Arrow batches, one file at a time.
"""

from __future__ import annotations

import configparser
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that hold no sources, and the suffixes and names of files that are analysed.
SKIPPED = (".git", "target", "build", ".gradle", ".idea", ".venv", "node_modules")
SUFFIXES = ("java", "py", "sql", "xml", "yml", "yaml", "properties", "json", "csv", "tsv", "toml", "conf", "avsc", "proto", "gradle")
NAMES = ("pom.xml", "Dockerfile", "pyproject.toml", "requirements.txt", "setup.py", "setup.cfg", "build.gradle.kts", "settings.gradle.kts", "libs.versions.toml")
#: Other suffixes that readers of this package take: SQL in other files, notes, and models.
ALSO_READ = ("hql", "q", "scala", "kt", "kts", "sh", "md", "pdm")
EMBEDDED = ("py", "scala", "java", "kt", "yaml", "yml", "json", "properties", "conf", "sh")


def scan_files(spark: SparkSession, root: str, with_text: bool = False) -> DataFrame:
    """path (below ``root``), suffix, size and, if wanted, text of every file that a reader takes; sorted by path when collected in order of ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/*", "/")
    base = re.escape(re.sub(r"^[a-z0-9]+:/*", "/", root).rstrip("/"))
    out = files.withColumn("path", F.regexp_replace(relative, f"^{base}/", "")).withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    hidden = F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(s) for s in SKIPPED]))
    out = out.where(~hidden & (_analysed() | F.col("suffix").isin(*ALSO_READ)))
    columns = ["path", "suffix", F.col("length").alias("size")]
    return out.select(*columns, F.col("content").cast("string").alias("text")) if with_text else out.select(*columns)


def _analysed() -> Column:
    return F.col("suffix").isin(*SUFFIXES) | F.regexp_extract("path", r"([^/]+)$", 1).isin(*NAMES)


def eligible(files: DataFrame) -> DataFrame:
    """The files that are analysed, by suffix or name."""
    return files.where(_analysed())


def detect_stack(files: DataFrame) -> DataFrame:
    """One row of flags: which technologies the file names show."""
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return files.agg(
        any_of(name == "pom.xml").alias("maven"),
        any_of(name.startswith("build.gradle")).alias("gradle"),
        any_of(F.col("suffix") == "java").alias("java"),
        any_of(F.col("suffix") == "py").alias("python"),
        any_of(F.col("suffix").isin("sql", "hql", "q")).alias("sql"),
        any_of(F.col("path").rlike(r"(?i)(^|/)(liquibase|changelog|migrations?)(/|\.)")).alias("migrations"),
        any_of(name.rlike(r"(openapi|swagger).*\.(ya?ml|json)$")).alias("openapi"),
    )


def sql_units(files: DataFrame) -> DataFrame:
    """(path, ordinal, sql): whole SQL files, and statements in quotes of other sources."""
    whole = files.where(F.col("suffix").isin("sql", "hql", "q")).select("path", F.lit(0).alias("ordinal"), F.col("text").alias("sql"))
    quoted = F.regexp_extract_all("text", F.lit(r"(?is)(?:\"\"\"|\"|')\s*((?:select|insert|create|merge|with|update|delete)\s.*?)(?:\"\"\"|\"|')"), F.lit(1))
    inside = files.where(F.col("suffix").isin(*EMBEDDED)).select("path", F.posexplode(quoted).alias("ordinal", "sql"))
    return whole.unionByName(inside.where(F.col("sql").rlike(r"(?is)\b(from|into|table|view|set)\b")))


def json_scalars(value: object, path: str = "$") -> Iterator[tuple[str, str, str | None]]:
    """(path, leaf name, scalar) of a JSON value."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from json_scalars(v, f"{path}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from json_scalars(v, f"{path}[{i}]")
    else:
        leaf = re.sub(r"\[\d+\]$", "", path).rpartition(".")[2]
        yield path, leaf, None if value is None else json.dumps(value) if not isinstance(value, str) else value


def property_scalars(text: str) -> Iterator[tuple[str, str, str | None]]:
    for line in re.sub(r"\\\r?\n\s*", "", text).splitlines():
        m = re.match(r"\s*(?:export\s+)?([\w.\-\[\]]+)\s*[=:]\s*(.*?)\s*$", line)
        if m and not line.lstrip().startswith(("#", "!")):
            yield m[1], m[1].rpartition(".")[2], m[2].strip("\"'")


def yaml_scalars(text: str) -> Iterator[tuple[str, str, str | None]]:
    """Scalars of block-style YAML: mappings, lists of scalars and of mappings."""
    stack: list[tuple[int, str]] = []
    counts: dict[tuple[str, int], int] = {}
    for line in text.splitlines():
        bare = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not bare.strip() or bare.strip() in ("---", "..."):
            continue
        indent, body = len(bare) - len(bare.lstrip()), bare.strip()
        while stack and stack[-1][0] >= indent and not (body.startswith("- ") and stack[-1][0] == indent and not stack[-1][1].startswith("[")):
            stack.pop()
        while body.startswith("- ") or body == "-":
            key = (".".join(n for _, n in stack), indent)
            n = counts[key] = counts.get(key, -1) + 1
            stack.append((indent, f"[{n}]"))
            rest = body[1:].lstrip()
            indent += len(body) - len(rest) if rest else 2
            body = rest
        m = re.match(r"(\"[^\"]*\"|'[^']*'|[^:\s][^:]*?)\s*:(?:\s+(.*))?$", body)
        path = ".".join(n for _, n in stack).replace(".[", "[")
        if m:
            name = m[1].strip("\"'")
            if m[2] is None or m[2] in ("|", ">", "|-", ">-"):
                stack.append((indent, name))
            else:
                yield f"{path}.{name}".lstrip("."), name, m[2].strip("\"'")
        elif body:
            yield path, re.sub(r"\[\d+\]$", "", path).rpartition(".")[2], body.strip("\"'")


def _ini_scalars(text: str) -> Iterator[tuple[str, str, str | None]]:
    parser = configparser.ConfigParser(interpolation=None, strict=False)
    parser.read_string(text)
    for section in parser.sections():
        for k, v in parser.items(section):
            yield f"{section}.{k}", k, v


def config_scalars(files: DataFrame) -> DataFrame:
    """(path, config_path, name, value) of JSON, YAML, properties, conf and shell files; a file that can't be read gives one row with null path."""
    schema = pa.schema([("path", pa.string()), ("config_path", pa.string()), ("name", pa.string()), ("value", pa.string())])

    def read(suffix: str, text: str) -> list:
        if suffix == "json":
            return list(json_scalars(json.loads(text)))
        if suffix in ("yaml", "yml"):
            return list(yaml_scalars(text))
        if suffix == "conf" and re.search(r"(?m)^\[", text):
            return list(_ini_scalars(text))
        return list(property_scalars(text))

    def run(batches):
        for batch in batches:
            out = []
            for path, suffix, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found = read(suffix, text or "")
                except (ValueError, configparser.Error):
                    found = [(None, None, None)]
                out += [(path, *x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in range(4)], schema=schema)

    chosen = files.where(F.col("suffix").isin("json", "yaml", "yml", "properties", "conf", "sh"))
    return chosen.select("path", "suffix", "text").mapInArrow(run, "path string, config_path string, name string, value string")


def resolve_references(scalars: DataFrame) -> DataFrame:
    """Values that are one ``${name}`` with what files give that name: matched, ambiguous or unresolved."""
    from tracewright.operators.joins import unique_or_ambiguous

    wanted = F.regexp_extract("value", r"^\$\{([^:}]+)(?::[^}]*)?\}$", 1)
    uses = scalars.withColumn("reference", wanted).where("reference <> ''").select("path", "config_path", "reference")
    given = scalars.where(~F.coalesce(F.col("value").contains("${"), F.lit(False))).select(F.col("config_path").alias("reference"), "value")
    return unique_or_ambiguous(uses, given, "reference", "value")


_TABLE = re.compile(r"create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.\"`${}]+)\s*\((.*)\)", re.I | re.S)


def _top_level(body: str) -> list[str]:
    """Parts of a comma list, not cut inside brackets or quotes."""
    parts, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(body):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and not depth:
            parts.append(body[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, body[start:]] if p.strip()]


def ddl_facts(text: str) -> Iterator[tuple[str, str, str | None, str | None, str | None, int]]:
    """(kind, table, name, type or columns, reference, line) of CREATE, ALTER, DROP, RENAME, index and comment statements."""
    from tracewright.functions.sqltext import split_statements

    names = lambda s: ",".join(x.strip(" \"`") for x in s.split(","))
    key = re.compile(r"(?:constraint\s+([\w\"`]+)\s+)?(primary\s+key|unique|foreign\s+key)\s*\(([^)]*)\)(?:\s*references\s+([\w.\"`${}]+)\s*\(([^)]*)\))?", re.I)
    for line, sql in split_statements(text):
        if m := _TABLE.match(sql):
            table = m[1].strip("\"`")
            yield "table", table, table, None, None, line
            for part in _top_level(m[2]):
                if k := key.match(part):
                    yield k[2].lower().replace(" ", "_").replace("__", "_"), table, k[1], names(k[3]), f"{k[4]}({names(k[5])})" if k[4] else None, line
                elif c := re.match(r"(?:constraint\s+([\w\"`]+)\s+)?check\s*\((.*)\)$", part, re.I | re.S):
                    yield "check", table, c[1], c[2].strip(), None, line
                elif c := re.match(r"([\w\"`]+)\s+([\w]+(?:\s*\([^)]*\))?)(.*)$", part, re.S):
                    yield "column", table, c[1].strip("\"`"), c[2], None, line
                    if re.search(r"primary\s+key", c[3], re.I):
                        yield "primary_key", table, None, c[1].strip("\"`"), None, line
                    if r := re.search(r"references\s+([\w.\"`]+)\s*\(([^)]*)\)", c[3], re.I):
                        yield "foreign_key", table, None, c[1].strip("\"`"), f"{r[1]}({names(r[2])})", line
        elif m := re.match(r"alter\s+table\s+(?:only\s+)?([\w.\"`${}]+)\s+add\s+(.*)$", sql, re.I | re.S):
            if k := key.match(m[2]):
                yield k[2].lower().replace(" ", "_"), m[1], k[1], names(k[3]), f"{k[4]}({names(k[5])})" if k[4] else None, line
            elif c := re.match(r"(?:column\s+)?([\w\"`]+)\s+([\w]+(?:\s*\([^)]*\))?)", m[2], re.I):
                yield "column", m[1], c[1].strip("\"`"), c[2], None, line
        elif m := re.match(r"alter\s+table\s+([\w.\"`]+)\s+rename\s+to\s+([\w.\"`]+)", sql, re.I):
            yield "rename", m[1], m[2], None, None, line
        elif m := re.match(r"drop\s+table\s+(?:if\s+exists\s+)?([\w.\"`]+)", sql, re.I):
            yield "drop", m[1], None, None, None, line
        elif m := re.match(r"create\s+(unique\s+)?index\s+(?:if\s+not\s+exists\s+)?([\w\"`]+)\s+on\s+([\w.\"`]+)[^(]*\(([^)]*)\)", sql, re.I):
            yield "unique_index" if m[1] else "index", m[3], m[2], names(m[4]), None, line
        elif m := re.match(r"comment\s+on\s+(table|column)\s+([\w.\"`]+)\s+is\s+'((?:[^']|'')*)'", sql, re.I):
            table = m[2] if m[1].lower() == "table" else m[2].rpartition(".")[0]
            yield "comment", table, m[2], m[3].replace("''", "'"), None, line


def schema_facts(files: DataFrame) -> DataFrame:
    """DDL facts of SQL files: path, kind, table_name, name, detail, reference, line."""
    ddl = "path string, kind string, table_name string, name string, detail string, reference string, line int"
    schema = pa.schema([(n, pa.int32() if n == "line" else pa.string()) for n in ("path", "kind", "table_name", "name", "detail", "reference", "line")])

    def run(batches):
        for batch in batches:
            out = [(path, *f) for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in ddl_facts(text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    return files.where(F.col("suffix") == "sql").select("path", "text").mapInArrow(run, ddl)


def fold_migrations(facts: DataFrame) -> DataFrame:
    """Tables that are left after CREATE, DROP and RENAME in order of path and line: table_name, generation, active."""
    from pyspark.sql.window import Window as W

    events = facts.where(F.col("kind").isin("table", "drop", "rename"))
    born = events.where(F.col("kind") != "drop").select(F.when(F.col("kind") == "rename", F.col("name")).otherwise(F.col("table_name")).alias("t"), "path", "line", F.lit(1).alias("live"))
    gone = events.where(F.col("kind") != "table").select(F.col("table_name").alias("t"), "path", "line", F.lit(0).alias("live"))
    every = born.unionByName(gone)
    order = W.partitionBy("t").orderBy("path", "line", "live").rowsBetween(W.unboundedPreceding, 0)
    counted = every.withColumn("generation", F.sum("live").over(order))
    last = counted.groupBy("t").agg(F.max(F.struct("path", "line", "live", "generation")).alias("e"))
    return last.select(F.col("t").alias("table_name"), F.col("e.generation"), (F.col("e.live") == 1).alias("active"))


def search_lines(files: DataFrame, token: str, context: int = 2) -> DataFrame:
    """Lines that hold the token, each with the lines around it."""
    lines = F.split("text", "\n")
    hit = files.withColumn("_lines", lines).select("path", "_lines", F.posexplode("_lines").alias("at", "line")).where(F.lower("line").contains(token.lower()))
    around = F.slice("_lines", F.greatest(F.col("at") + 1 - context, F.lit(1)), F.least(F.col("at"), F.lit(context)) + 1 + context)
    return hit.select("path", (F.col("at") + 1).alias("line_number"), "line", F.array_join(around, "\n").alias("context"))


def candidate_score(files: DataFrame) -> DataFrame:
    """How likely a file declares a data model: weighted signals, their sum and a class."""
    signals: dict[str, tuple[Column, int]] = {
        "ddl": (F.col("text").rlike(r"(?i)\bcreate\s+table\b"), 5),
        "entity": (F.col("text").rlike(r"@(Entity|Table|Document)\b"), 5),
        "dataclass": (F.col("text").rlike(r"@dataclass\b|\bBaseModel\b"), 3),
        "schema_name": (F.lower("path").rlike(r"(schema|model|entity|ddl)"), 2),
        "keys": (F.col("text").rlike(r"(?i)\b(primary|foreign)\s+key\b"), 2),
    }
    flagged = files.select("path", *[F.coalesce(c, F.lit(False)).alias(k) for k, (c, _) in signals.items()])
    score = sum((F.when(F.col(k), w).otherwise(0) for k, (_, w) in signals.items()), F.lit(0))
    return flagged.withColumn("score", score).withColumn("class", F.when(F.col("score") >= 7, "strong").when(F.col("score") >= 3, "possible").otherwise("none"))
