"""Deterministic identifiers and normal forms, all as JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def _text(part: Column | str | None) -> Column:
    if part is None:
        return F.lit("")
    return F.coalesce((part if isinstance(part, Column) else F.lit(part)).cast("string"), F.lit(""))


def stable_id(prefix: str, *parts: Column | str | None) -> Column:
    """``prefix_`` and 20 hex digits of the SHA-256 of the parts; null counts as the empty string."""
    joined = F.concat_ws(SEPARATOR, *[_text(p) for p in parts])
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 20))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 over column values, in which null and the empty string differ."""
    marked = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat_ws(SEPARATOR, *marked), 256)


def normalize_text(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(x), r"\s+", " "))


def normalize_db_identifier(x: Column) -> Column:
    """Lower-cased, dot-separated name without quotes and alias."""
    bare = F.regexp_replace(F.trim(x), r"(?i)\s+(as\s+)?[\w$\"`]+$", "")
    return F.lower(F.regexp_replace(bare, r"[\"`\[\]\s]", ""))


def correspondence_path(x: Column) -> Column:
    """Each part of a dotted path reduced to letters and digits; empty parts go."""
    parts = F.transform(F.split(F.lower(x), r"\."), lambda p: F.regexp_replace(p, "[^0-9a-z]", ""))
    return F.array_join(F.filter(parts, lambda p: p != ""), ".")


def relation_namespace(x: Column) -> Column:
    """All but the last part of a dotted name, or the empty string."""
    return F.coalesce(F.regexp_extract(x, r"^(.*)\.[^.]*$", 1), F.lit(""))


def url_path(x: Column) -> Column:
    """Comparison form of a URL or path: no scheme, authority, query or fragment; variables, numbers and doubled slashes unified."""
    path = F.regexp_replace(x, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_replace(path, r"[?#].*$", "")
    path = F.regexp_replace(path, r"\{[^}/]*\}|\$\{[^}]*\}|:[A-Za-z_][A-Za-z0-9_]*", "{}")
    path = F.regexp_replace(path, r"/[0-9]+(?=/|$)", "/{}")
    path = F.regexp_replace(F.concat(F.lit("/"), path), r"/+", "/")
    return F.lower(F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", "")))


def url_authority(x: Column) -> Column:
    host = F.lower(F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.regexp_replace(host, r":(80|443)$", "")


def path_suffixes(path: Column) -> Column:
    """The path and each shorter tail that starts at a slash: ``/a/b`` gives ``/a/b`` and ``/b``."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, F.greatest(F.size(parts), F.lit(1))), "/")))


def match_strength(name: Column, hint: Column) -> Column:
    """3: equal, 2: ends with the hint, 1: contains it as a token, else 0."""
    a, b = F.lower(name), F.lower(hint)
    token = F.array_contains(F.split(a, r"[^0-9a-z]+"), b)
    return F.when(a == b, 3).when(a.endswith(b), 2).when(token, 1).otherwise(0)


def cardinality_hint(declared_type: Column) -> Column:
    many = declared_type.rlike(r"(?i)\b(list|set|collection|array|map|iterable|stream)\b|\[\]")
    return F.when(declared_type.isNull(), F.lit(None).cast("string")).when(many, "many").otherwise("one")


def transformation_kind(expression: Column) -> Column:
    """Kind of a column expression; the first rule that holds wins."""
    e = F.lower(expression)
    return (
        F.when(e.rlike(r"\bcase\b.*\bwhen\b"), "case_when")
        .when(e.rlike(r"\bover\s*\("), "window_function")
        .when(e.rlike(r"\b(sum|count|min|max|avg|collect_list|collect_set|first|last)\s*\("), "aggregation")
        .when(e.rlike(r"\b(coalesce|nvl|ifnull|nullif)\s*\("), "null_defaulting")
        .when(e.rlike(r"\b(cast|try_cast|trim|lower|upper|regexp_replace)\s*\("), "normalization_or_cast")
        .when(e.rlike(r"^[a-z_][\w.]*$"), "direct_column")
        .when(e.rlike(r"^('.*'|-?\d+(\.\d+)?|null|true|false)$"), "literal_or_constant")
        .otherwise("expression")
    )
