"""Token counts by heap-and-linked-list byte-pair merging.

A text is escaped, cut where no piece of the vocabulary can reach across, and each cut is merged on its own:
the adjacent pair of lowest rank is popped from a heap, its symbols are linked into one, and its two new
neighbour pairs are pushed. The count is the initial symbols less the merges; characters outside the
vocabulary count as their UTF-8 bytes (byte fallback). No identifiers are emitted.

Null texts count as empty (0 bytes, 0 tokens). Very long texts cost O(n log n) time and O(n) memory for each
run without a space. Repeated rows and ids are counted row by row; other columns pass through, but for
``n_bytes``, ``n_tokens`` and ``over_limit``, which are replaced.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

#: The mark that stands for a space in the vocabulary.
SPACE = "▁"
CUTS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Counts kept by a worker, and the longest cut that is worth keeping.
KEPT, KEPT_LENGTH = 600_000, 48


def merges(symbols: str | list[str], rank: dict[str, int]) -> int:
    """How many pairs merge until no adjacent pair is in the vocabulary.

    A heap entry holds rank and place; it is stale unless the pair that now starts there has that rank.
    """
    n, get = len(symbols), rank.get
    parts = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    current = [get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
    current.append(None)
    heap = [r << 32 | i for i, r in enumerate(current) if r is not None]
    heapify(heap)
    merged = 0
    while heap:
        entry = heappop(heap)
        i = entry & 0xFFFFFFFF
        if current[i] != entry >> 32:
            continue
        j = after[i]
        k = after[i] = after[j]
        parts[i] += parts[j]
        current[j] = None
        merged += 1
        if k < n:
            before[k] = i
            r = current[i] = get(parts[i] + parts[k])
            if r is not None:
                heappush(heap, r << 32 | i)
        else:
            current[i] = None
        h = before[i]
        if h >= 0:
            r = current[h] = get(parts[h] + parts[i])
            if r is not None:
                heappush(heap, r << 32 | h)
    return merged


class Counter(dict):
    """Token counts of cuts, each computed once while it is kept.

    When the young generation is full it becomes the old one; what is used again moves back.
    """

    def __init__(self, model_path: str):
        super().__init__()
        import sentencepiece

        self.old: dict[str, int] = {}
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        usable = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.rank = {model.id_to_piece(i): round(-model.get_score(i)) for i in usable}
        self.known = frozenset(p for p in self.rank if len(p) == 1)
        crossing = [p for p in self.rank if SPACE in p.lstrip(SPACE)]
        if crossing:
            raise ValueError(f"pieces reach across spaces, cuts would be wrong: {crossing[:3]}")

    def __missing__(self, cut: str) -> int:
        n = self.old.get(cut)
        if n is None:
            n = len(cut) - merges(cut, self.rank)
            if not self.known.issuperset(cut):
                n += sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c in cut if c not in self.known)
        if len(cut) <= KEPT_LENGTH:
            self[cut] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self) > KEPT:
            self.old = dict(self)
            self.clear()
        return sum(map(self.__getitem__, CUTS.findall(SPACE + text.replace(" ", SPACE))))


_counters: dict[str, Counter] = {}


def counter(model_path: str) -> Counter:
    if model_path not in _counters:
        _counters[model_path] = Counter(model_path)
    return _counters[model_path]


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``model_path`` must be readable at the same place on every executor.
    """
    bounded_batches(docs.sparkSession)

    def n_tokens(texts: pa.Array) -> pa.Array:
        own = counter(model_path)
        return pa.array([own.count(x) for x in texts.to_pylist()], pa.int64())

    counted = docs.withColumn("n_tokens", F.arrow_udf(n_tokens, T.LongType())(F.col(text)))
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    return counted.withColumn("n_bytes", n_bytes).withColumn("over_limit", F.col("n_tokens") > limit)
