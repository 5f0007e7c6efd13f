"""Pages in total order, with tokens bound to the query and its filters."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 500


def page_size(wanted: int | None, default: int = 100) -> int:
    return max(1, min(MOST, wanted or default))


def filter_print(filters: Mapping) -> str:
    return hashlib.sha256(json.dumps(filters, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:24]


def encode_token(query: str, filters: Mapping, offset: int) -> str:
    body = {"v": 1, "q": query, "f": filter_print(filters), "o": offset}
    return base64.urlsafe_b64encode(json.dumps(body, separators=(",", ":")).encode()).decode()


def decode_token(token: str | None, query: str, filters: Mapping) -> int:
    """The offset; a token of another query or of other filters is refused."""
    if not token:
        return 0
    try:
        body = json.loads(base64.urlsafe_b64decode(token))
        good = body["v"] == 1 and body["q"] == query and body["f"] == filter_print(filters) and body["o"] >= 0
    except (ValueError, KeyError, TypeError) as e:
        raise ValueError("page token can't be read") from e
    if not good:
        raise ValueError("page token is for another query")
    return body["o"]


def total_order(columns: Sequence[str | Column]) -> list[Column]:
    """Ascending, nulls last; the last column should be an identifier."""
    return [(F.col(c) if isinstance(c, str) else c).asc_nulls_last() for c in columns]


def page(df: DataFrame, order: Sequence[str | Column], size: int | None = None, offset: int = 0) -> DataFrame:
    return df.orderBy(*total_order(order)).offset(offset).limit(page_size(size))


def page_result(df: DataFrame, order: Sequence[str | Column], query: str, filters: Mapping, size: int | None = None, token: str | None = None) -> dict:
    """Items (as dicts), total count and the next token."""
    offset, n = decode_token(token, query, filters), page_size(size)
    total = df.count()
    items = [r.asDict(recursive=True) for r in page(df, order, n, offset).collect()]
    return {"items": items, "total_count": total, "next_token": encode_token(query, filters, offset + n) if offset + n < total else None}
