"""Scripts around SQL: calls, variables, string expressions and references to other files.

Text functions work on one statement or file; ``script_facts`` runs them over files as Arrow batches. Variables hold from their line on, within their
file alone; what the file doesn't fix stays a placeholder.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import sqltext
from tracewright.operators.joins import unique_or_ambiguous

_STRING = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`"
_CALL_TOKENS = re.compile(rf"(?P<skip>{_STRING}|--[^\n]*|/\*.*?\*/)|(?P<call>(?<![\w.])[A-Za-z_][\w.]*)\s*\(|(?P<open>[(\[{{])|(?P<close>[)\]}}])|(?P<comma>,)", re.S)
_NAMED = re.compile(r"([A-Za-z_][\w.]*)\s*=(?!=)\s*(.*)", re.S)
_LET = re.compile(r"\s*(?:let|set|declare|var)\s+\$?([A-Za-z_][\w.]*(?:\[[^\]]+\])?)\s*=\s*(.*)", re.I | re.S)
_VARIABLE = re.compile(r"\$\{\s*\$?([A-Za-z_][\w.]*)\s*\}|(?<![A-Za-z0-9$])\$([A-Za-z_][\w.]*)")
_SCALAR = re.compile(r"-?\d+(?:\.\d+)?|true|false|null|none", re.I)
_SQL_PATH = re.compile(r"[\w${}./\\-]+\.(?:sql|hql|q)\b", re.I)
#: Variables in values of variables are replaced so often at most, which ends what refers to itself.
ROUNDS = 16


def calls(statement: str) -> list[tuple[int, str, list[str], dict[str, str]]]:
    """(offset, symbol, positional and named arguments) of each call, outer before inner; calls that don't end are left out.

    A name that comes twice keeps its first value, the second counts as positional.
    """
    found, stack = [], []
    for m in _CALL_TOKENS.finditer(statement):
        if m["call"] or m["open"]:
            stack.append((m.start(), m["call"], [m.end()], []))
        elif m["comma"] and stack:
            stack[-1][3].append(m.start())
        elif m["close"] and stack:
            start, symbol, begins, commas = stack.pop()
            if symbol:
                cuts = [begins[0] - 1, *commas, m.start()]
                found.append((start, symbol, [x for a, b in zip(cuts, cuts[1:], strict=False) if (x := " ".join(statement[a + 1 : b].split()))]))
    out = []
    for start, symbol, arguments in sorted(found):
        positional, named = [], {}
        for argument in arguments:
            m = _NAMED.fullmatch(argument)
            if m and m[1] not in named:
                named[m[1]] = m[2].strip()
            else:
                positional.append(argument)
        out.append((start, symbol, positional, named))
    return out


def filled(text: str, known: Mapping[str, str]) -> str:
    """``text`` with the variables that are known, also those in their values."""
    for _ in range(ROUNDS):
        after = _VARIABLE.sub(lambda m: known.get((m[1] or m[2]).lower(), m[0]), text)
        if after == text:
            break
        text = after
    return text


def evaluated(expression: str, known: Mapping[str, str]) -> tuple[str, str | None]:
    """(kind, value) of the right side of an assignment: literal, template (with open placeholders), reference or expression.

    Strings, numbers and exact concatenations of strings and known variables have a value; nothing else is evaluated.
    """
    text = expression.strip()
    if _SCALAR.fullmatch(text):
        return "literal", text
    if re.fullmatch(r"\$[A-Za-z_][\w.]*(?:\[[^\]]+\])?", text):
        return "reference", text
    parts = re.findall(rf"{_STRING}|\+|\|\||[^\s'\"`+|]+", text)
    values = []
    for i, part in enumerate(parts):
        if i % 2:
            if part not in ("+", "||"):
                return "expression", None
        elif part[0] in "'\"":
            values.append(part[1:-1])
        elif (m := _VARIABLE.fullmatch(part)) and (m[1] or m[2]).lower() in known:
            values.append(known[(m[1] or m[2]).lower()])
        else:
            return "expression", None
    if not values or len(parts) % 2 == 0:
        return "expression", None
    value = "".join(values)
    value = filled(value, known) if len(values) > 1 else value
    return "template" if sqltext.placeholders(value) else "literal", value


def statements(text: str) -> Iterator[tuple[int, str, str, str]]:
    """(line, kind, statement, statement with the variables that its file has fixed by then)."""
    known: dict[str, str] = {}
    for line, statement in sqltext.split_statements(text):
        kind = sqltext.fragment_kind(statement)
        yield line, kind, statement, filled(statement, known)
        if kind == "assignment" and (m := _LET.fullmatch(statement)):
            _, value = evaluated(m[2], known)
            if value is not None:
                known[m[1].lower()] = value


def variables(text: str) -> Iterator[tuple[int, str, str, str | None, str]]:
    """(line, name, kind, value, expression) of the assignments of a file."""
    known: dict[str, str] = {}
    for line, statement in sqltext.split_statements(text):
        if sqltext.fragment_kind(statement) == "assignment" and (m := _LET.fullmatch(statement)):
            kind, value = evaluated(m[2], known)
            if value is not None:
                known[m[1].lower()] = value
            yield line, m[1], kind, value, " ".join(m[2].split())


_FACTS = {
    "statements": ("file string, line int, kind string, statement string, resolved string", lambda text: [(a, b, c, d) for a, b, c, d in statements(text)]),
    "variables": ("file string, line int, name string, kind string, value string, expression string", lambda text: list(variables(text))),
    "calls": (
        "file string, line int, offset int, symbol string, positional array<string>, named map<string,string>",
        lambda text: [(line, at, symbol, positional, list(named.items())) for line, kind, statement, _ in statements(text) if kind != "sql" for at, symbol, positional, named in calls(statement)],
    ),
    "paths": ("file string, line int, template string", lambda text: [(line, path) for line, _, statement, resolved in statements(text) for path in sorted({*_SQL_PATH.findall(sqltext.strip_comments(resolved))})]),
}
_ARROW = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string())}


def script_facts(files: DataFrame, fact: str) -> DataFrame:
    """``statements``, ``variables``, ``calls`` or ``paths`` (references to SQL files) of files (file, text), each file on its own."""
    ddl, read = _FACTS[fact]
    fields = [x.split() for x in ddl.split(", ")]
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in fields])

    def run(batches):
        for batch in batches:
            rows = [(file, *row) for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in read(text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return files.select("file", "text").mapInArrow(run, ddl)


def static_suffix(template: Column) -> Column:
    """What follows the last placeholder of a path, without leading slashes; the whole path if there is none."""
    plain = F.regexp_replace(F.regexp_replace(template, r"\\", "/"), r"^[./]+", "")
    return F.regexp_replace(F.regexp_replace(plain, r"^.*(\$\{[^}]*\}|\{\{[^}]*\}\}|%\([^)]*\)s|\$[A-Za-z_]\w*)", ""), r"^/+", "")


def match_files(templates: DataFrame, files: DataFrame) -> DataFrame:
    """``templates`` (template) with status, basis and the file that is meant: the same path, else a unique file that ends with the fixed end.

    Files offer each of their ends as a key, so this is an equi-join; ends are as many as a path has characters.
    """
    known = files.select("file", F.lower("file").alias("low")).distinct()
    ends = known.select("file", F.explode(F.transform(F.sequence(F.lit(1), F.length("low")), lambda i: F.substring("low", i, F.length("low")))).alias("end"))
    wanted = templates.select("template").distinct().withColumn("low", F.lower(F.regexp_replace(F.regexp_replace("template", r"\\", "/"), r"^[./]+", "")))
    exact = unique_or_ambiguous(wanted, known, "low", "file").where("candidate_count > 0").select("template", "candidate_count", "status", F.col("selected_id").alias("file"), F.lit("exact_path").alias("basis"))
    rest = wanted.join(exact.select("template"), "template", "left_anti").withColumn("end", F.lower(static_suffix(F.col("template"))))
    rest = rest.withColumn("end", F.when(F.col("end") != "", F.col("end")))
    by_end = unique_or_ambiguous(rest, ends, "end", "file").select("template", "candidate_count", "status", F.col("selected_id").alias("file"), F.when(F.col("candidate_count") > 0, "fixed_end").alias("basis"))
    return exact.unionByName(by_end)


def quote_bare_templates(text: Column) -> Column:
    """YAML in which ``key: {{x}}`` and ``- {{x}}`` are strings, as YAML takes bare braces for mappings."""
    return F.regexp_replace(text, r"(?m)^(\s*(?:-\s+)?(?:[\w.\-]+\s*:\s+)?)(\{\{[^{}\n]*\}\}[^\n\"'#]*?)(\s*(?:#.*)?)$", "$1\"$2\"$3")


# Parts of names by which fields are classified.
IDENTIFIER_PARTS = ("id", "key", "ucp", "guid", "uuid", "object", "entity", "client", "profile", "account", "card", "phone", "agreement", "correlation", "event")
STATUS_PARTS = ("status", "state", "result", "error", "reason", "code", "success", "fail", "failed", "reject")
TIME_PARTS = ("dt", "date", "time", "timestamp", "valid", "effective", "load", "created", "updated", "business")
AUDIT_PARTS = ("created_by", "updated_by", "deleted", "actual", "version", "hash", "source")
SLICE_NAMES = ("dt", "business_dt", "load_dt", "report_dt")


def field_classes(name: Column) -> Column:
    """Classes that a field's name suggests, in a fixed order; none gives an empty array."""
    low = F.lower(F.trim(name))
    any_of = lambda parts: F.reduce(F.array(*[F.lit(p) for p in parts]), F.lit(False), lambda found, p: found | F.contains(low, p))
    classes = {
        "identifier_or_key_candidate": any_of(IDENTIFIER_PARTS),
        "status_result_or_error_candidate": any_of(STATUS_PARTS),
        "date_time_or_temporal_candidate": any_of(TIME_PARTS),
        "audit_version_or_lifecycle_candidate": any_of(AUDIT_PARTS),
        "partition_or_slice_candidate": F.contains(low, F.lit("partition")) | low.isin(*SLICE_NAMES),
    }
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in classes.items()]))


def check_values(condition: Column) -> Column:
    """The string literals of the IN list of a CHECK condition."""
    inside = F.regexp_extract(condition, r"(?is)\bin\s*\((.*?)\)\s*\)*\s*$", 1)
    return F.transform(F.regexp_extract_all(inside, F.lit(r"'((?:[^']|'')*)'"), F.lit(1)), lambda x: F.replace(x, F.lit("''"), F.lit("'")))
