"""Optional filters and token search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def equals(**wanted: object) -> Column:
    """Equality on every column whose wanted value is given."""
    given = [F.col(k) == F.lit(v) for k, v in wanted.items() if v not in (None, "")]
    return reduce(lambda a, b: a & b, given, F.lit(True))


def token_search(token: str | None, *columns: str) -> Column:
    """Substring of the columns put together; ``%`` and ``_`` in the token stay wildcards."""
    if not token:
        return F.lit(True)
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    return text.like(f"%{token.lower()}%")


def json_member(column: str, value: str) -> Column:
    """Whether a JSON array of strings holds the value."""
    return F.array_contains(F.from_json(F.col(column), "array<string>"), value)


def blob_search(token: str) -> Column:
    """Token anywhere in the row's JSON."""
    return F.lower(F.to_json(F.struct("*"))).contains(token.lower())
