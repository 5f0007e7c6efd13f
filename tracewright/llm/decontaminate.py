"""Benchmark decontamination by winnowing.

Of every ``window - k + 1`` consecutive k-gram hashes the smallest is kept as a fingerprint, on both sides by the same
rule, so any shared span of ``window`` words shares a fingerprint at the same place. Fingerprints of documents and items
meet in a join on the hash; each carries the words around it, so a hit is extended and verified
word by word without moving the text again. Items shorter than the window are one window of their own length, found by
the hash of all their words.

A bitmap of fixed size over the item fingerprints keeps most document fingerprints out of the join; it only filters,
so a full one costs time and not results. Candidates are joined by hash with either side of any size; a fingerprint that very many
documents hold is dealt over several tasks.

Null and empty texts have no words and no hits; items without words occur nowhere. An item id of null counts as the id "".
Repeated document rows give one result row each; repeated items count once by id. Empty tables give empty
results or documents without hits. Only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, bitmap_of, bounded_batches, in_bitmap, kept_rows, spread_join, stage, text_key, tidy, with_row_id
from .words import run_hashes, word_hashes

#: Bits of the bitmap that filters document fingerprints.
BITMAP_BITS = 1 << 23
#: Bytes that separate words: all ASCII but digits and small letters (texts are lower-cased before).
_SPACES = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACES).split()


def winnow(h: np.ndarray, span: int) -> np.ndarray:
    """Places that are the last smallest of some ``span`` consecutive hashes (of all, if there are fewer)."""
    if not len(h):
        return np.empty(0, dtype=np.int64)
    if len(h) <= span:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))])
    views = np.lib.stride_tricks.sliding_window_view(h, span)[:, ::-1]
    return np.unique(np.arange(len(views)) + span - 1 - views.argmin(axis=1))


def fingerprints(words: list[bytes], k: int, window: int) -> list[tuple[int, int]]:
    """(hash, place) of what winnowing keeps."""
    h = run_hashes(word_hashes(words), k)
    return [(int(h[i]), int(i)) for i in winnow(h, window - k + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _context(words: list[bytes], place: int, before: int, after: int) -> tuple[int, str]:
    start = max(0, place - before)
    return start, b" ".join(words[start : place + after]).decode("utf-8", "surrogatepass")


_ITEM = "item string, hash long, place int, length int, start int, context string"
_HIT = "row_id long, doc_id {id}, text_key long, n_words long, hash long, place int, length int, start int, context string"
_SPAN = "row_id long, item string, first int, last int"


def item_fingerprints(items: DataFrame, item_id: str, text: str, k: int, window: int) -> DataFrame:
    """``length`` is 0 for a fingerprint of whole windows, else the number of words of a short item."""

    def run(batches):
        for batch in batches:
            out = []
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(body)
                if len(words) >= window:
                    for h, i in fingerprints(words, k, window):
                        start, context = _context(words, i, window - k, window)
                        out.append((item or "", _signed(h), i, 0, start, context))
                elif words:
                    n = len(words)
                    h = run_hashes(word_hashes(words), n)
                    out.append((item or "", _signed(int(h[0])), 0, n, 0, b" ".join(words).decode("utf-8", "surrogatepass")))
            yield arrow_batch(out, _ITEM)

    return items.select(F.col(item_id).cast("string"), F.col(text)).mapInArrow(run, _ITEM)


def contaminated_spans(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 5, window: int = 10, bits: int = BITMAP_BITS) -> tuple[DataFrame, DataFrame]:
    """(row_id, doc_id, text_key, n_words) of all rows, and the verified spans (row_id, item, first, last) in
    words, both ends included."""
    spark = docs.sparkSession
    bounded_batches(spark)
    hit = _HIT.format(id=docs.schema["doc_id"].dataType.simpleString())
    prints = stage(item_fingerprints(items, item_id, item_text, k, window), "items")
    lengths = [r[0] for r in prints.where("length > 0").select("length").distinct().collect()]  # fewer than ``window``
    bitmap = spark.sparkContext.broadcast(bitmap_of(prints, bits))

    def run(batches):
        for batch in batches:
            out = []
            for row, doc, key, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(body)
                out.append((row, doc, key, len(words), None, None, None, None, None))
                own = word_hashes(words)
                runs = run_hashes(own, k)
                at = winnow(runs, window - k + 1)
                at = at[in_bitmap(bitmap.value, runs[at])]
                for i in at.tolist():
                    start, context = _context(words, i, window - k, window)
                    out.append((row, None, None, None, _signed(int(runs[i])), i, 0, start, context))
                for n in lengths:
                    short = run_hashes(own, n)
                    for i in np.flatnonzero(in_bitmap(bitmap.value, short)).tolist():
                        out.append((row, None, None, None, _signed(int(short[i])), i, n, i, b" ".join(words[i : i + n]).decode("utf-8", "surrogatepass")))
            yield arrow_batch(out, hit)

    rows = with_row_id(docs.select("doc_id", text_key(text).alias("text_key"), text))
    scanned = stage(rows.select("row_id", "doc_id", "text_key", text).mapInArrow(run, hit), "fingerprints")
    hits = scanned.where(F.col("hash").isNotNull()).drop("doc_id", "text_key", "n_words")
    theirs = prints.select("item", "hash", "length", F.col("place").alias("item_place"), F.col("start").alias("item_start"), F.col("context").alias("item_context"))
    pairs = spread_join(hits, theirs, ["hash", "length"], F.struct("row_id", "place"))

    def extend(batches):
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                own, other = x["context"].split(" "), x["item_context"].split(" ")
                if x["length"]:
                    if own == other:
                        out.append((x["row_id"], x["item"], x["place"], x["place"] + x["length"] - 1))
                    continue
                a, b = x["place"] - x["start"], x["item_place"] - x["item_start"]
                lo = 0
                while lo < min(a, b, window - k) and own[a - lo - 1] == other[b - lo - 1]:
                    lo += 1
                hi, most = 0, min(len(own) - a, len(other) - b, window)
                while hi < most and own[a + hi] == other[b + hi]:
                    hi += 1
                if hi >= k and lo + hi >= window:  # the run itself matches, and some whole window around it
                    out.append((x["row_id"], x["item"], x["place"] - lo, x["place"] + hi - 1))
            yield arrow_batch(out, _SPAN)

    spans = stage(pairs.mapInArrow(extend, _SPAN), "spans")
    return scanned.where(F.col("n_words").isNotNull()).select("row_id", "doc_id", "text_key", "n_words"), spans


@tidy
def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """One row per document row: row_id, doc_id, text_key, n_words, n_hit, n_items, items (sorted ids), contaminated."""
    counts, spans = contaminated_spans(docs, items, **options)
    places = spans.select("row_id", F.explode(F.sequence("first", "last")).alias("place")).distinct().groupBy("row_id").agg(F.count("*").alias("n_hit"))
    found = spans.select("row_id", "item").distinct().groupBy("row_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    per_row = places.join(found, "row_id")
    return (
        counts.join(per_row, "row_id", "left")
        .select(
            "row_id",
            "doc_id",
            "text_key",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.col("n_hit").isNotNull().alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window."""
    counts, spans = contaminated_spans(docs, items)
    hit = spans.select("row_id").distinct().withColumn("hit", F.lit(True))
    return kept_rows(docs, counts.join(hit, "row_id", "left").select("doc_id", "text_key", F.col("hit").isNull().alias("kept")))
