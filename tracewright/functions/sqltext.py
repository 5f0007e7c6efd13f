"""SQL scripts as text: comments, statements, placeholders, kinds of fragments."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Quoted strings, quoted names and comments, in the order in which they must be tried.
_TOKENS = re.compile(r"('(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`)|(--[^\n]*|/\*.*?\*/)|(;)", re.S)
PLACEHOLDER = re.compile(r"\$\{[^}]+\}|\{\{[^}]+\}\}|%\([^)]+\)s|\$[A-Za-z_]\w*")
_TOKEN_NAME = "ph__{}__"


def strip_comments(text: str) -> str:
    """Comments become spaces, newlines stay, so offsets and lines keep their meaning."""
    return _TOKENS.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[2] else m[0], text)


def split_statements(text: str) -> Iterator[tuple[int, str]]:
    """(first line, statement) of what semicolons separate outside strings and comments."""
    bare, start = strip_comments(text), 0
    ends = [m.start() for m in _TOKENS.finditer(bare) if m[3]] + [len(bare)]
    for end in ends:
        part = bare[start:end]
        if part.strip():
            lead = len(part) - len(part.lstrip())
            yield bare.count("\n", 0, start + lead) + 1, part.strip()
        start = end + 1


def hide_placeholders(sql: str) -> tuple[str, dict[str, str]]:
    """Placeholders as names that a parser takes, and how to put them back; equal ones share a name."""
    names: dict[str, str] = {}

    def name(m: re.Match) -> str:
        return names.setdefault(m[0], _TOKEN_NAME.format(len(names)))

    hidden = PLACEHOLDER.sub(name, sql)
    return hidden, {v: k for k, v in names.items()}


def restore_placeholders(text: str, names: dict[str, str]) -> str:
    for token, placeholder in names.items():
        text = text.replace(token, placeholder)
    return text


def fragment_kind(sql: str) -> str:
    """sql, control, assignment, logging, error or other, by the first token."""
    first = (re.match(r"\s*([A-Za-z_]+)", sql) or [""])[0].strip().lower()
    if first in {"select", "with", "insert", "create", "drop", "alter", "merge", "update", "delete", "truncate", "refresh", "analyze", "cache", "msck"}:
        return "sql"
    if first in {"if", "else", "for", "while", "begin", "end", "loop", "return", "use"}:
        return "control"
    if first in {"set", "declare", "var", "let"}:
        return "assignment"
    if first in {"print", "log", "echo", "info", "warn"}:
        return "logging"
    return "error" if first in {"raise", "signal", "throw", "error"} else "other"


def lint(sql: str) -> list[str]:
    """Names of the patterns that a reviewer would look at."""
    s = re.sub(r"'(?:[^'\\]|\\.)*'", "''", sql.lower())
    found = {
        "select_star": re.search(r"select\s+(\w+\.)?\*", s),
        "cross_join": re.search(r"\bcross\s+join\b", s),
        "many_joins": len(re.findall(r"\bjoin\b", s)) > 5,
        "insert_without_columns": re.search(r"insert\s+(into|overwrite)\s+(table\s+)?[\w.`${}]+\s+(select|with)\b", s),
        "order_without_limit": re.search(r"\border\s+by\b", s) and not re.search(r"\blimit\b", s),
        "delete_without_where": re.search(r"^\s*delete\b", s) and " where " not in s,
    }
    return sorted(k for k, v in found.items() if v)


def regex_relations(sql: str) -> tuple[list[str], list[str]]:
    """(read, written) names found without a parser, for statements that don't parse."""
    names = r"([A-Za-z_`][\w.`]*)"
    read = re.findall(rf"\b(?:from|join)\s+{names}", sql, re.I)
    written = re.findall(rf"\binsert\s+(?:into|overwrite)\s+(?:table\s+)?{names}|\bcreate\s+(?:or\s+replace\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?{names}", sql, re.I)
    return sorted(set(read)), sorted({a or b for a, b in written})


def conflict_keys(sql: str) -> list[str]:
    """The columns of each ``ON CONFLICT (...)``, which the parser doesn't take, joined by commas."""
    return [",".join(c.strip(' `"') for c in found.split(",")) for found in re.findall(r"\bon\s+conflict\s*\(([^()]*)\)", strip_comments(sql), re.I)]


def masked(text: str) -> str:
    """Quoted strings, quoted names and comments as spaces; offsets and lines keep their meaning."""
    return _TOKENS.sub(lambda m: m[0] if m[3] else re.sub(r"[^\n]", " ", m[0]), text)


def placeholders(text: str) -> list[tuple[int, str]]:
    """(offset, placeholder) in the order of the text."""
    return [(m.start(), m[0]) for m in PLACEHOLDER.finditer(text)]
