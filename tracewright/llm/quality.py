"""Quality classifier: random Fourier features over document statistics, ridge by partition-summed normal equations,
isotonic calibration.

Statistics of every whole text (shape, repetition, symbols, no identifiers and no labels) are standardised and mapped to
``FEATURES`` random cosines, which approximate a Gaussian kernel. Each partition of the training rows sums its normal equations; the
sums, of fixed size, are added up and solved, for all rows and for each of two halves. Raw scores are calibrated by isotonic regression on binned
scores of training rows, each by the half that has not seen it, mixed with a little of the raw rank so that scores of one level still differ.

At most ``TRAIN_ROWS`` labelled rows are used, those of the smallest hash of the id; all else covers all rows.

Null texts count as empty; an empty text has all statistics 0 and gets a score like any other. Rows of ``labels`` without a
document, with a null id or a null label are not used; repeated ones count each time. Without labelled rows of both kinds every score is the
share of label 1 (0.5 without any). Repeated document rows give one result row each. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batch, bounded_batches, fold, labelled_sample, stage, text_key, tidy, unstage, with_row_id

TRAIN_ROWS = 30_000
FEATURES, RIDGE, WIDTH, BINS = 256, 1e-3, 4.0, 200
#: Partitions of the training rows: so many matrices of FEATURES + 1 squared reach the driver.
TRAIN_PARTS = 8
#: Classes of bytes.
_SPACE, _LOWER, _UPPER, _WIDE, _DIGIT, _MARK, _SYMBOL = range(7)
_CLASS = np.full(256, _SYMBOL, dtype=np.uint8)
for _bytes, _kind in ((b" \t\n\r\x0b\x0c", _SPACE), (b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (bytes(range(128, 256)), _WIDE), (b"0123456789", _DIGIT), (b".,;:!?'\"-()", _MARK)):
    _CLASS[list(_bytes)] = _kind
_RARE = (b"|", b"!!", b"http", b"@", b"<", b"{")
N_STATISTICS = 33


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text; all are 0 for an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    folded = Counter(raw.lower().split())
    if not folded:
        return [0.0] * N_STATISTICS
    kinds = _CLASS[np.frombuffer(raw, dtype=np.uint8)]
    size, of = len(raw), np.bincount(kinds, minlength=7)
    letters = of[_LOWER] + of[_UPPER] + of[_WIDE]
    solid = np.flatnonzero(np.diff((kinds != _SPACE).astype(np.int8), prepend=0, append=0))
    starts, stops = solid[::2], solid[1::2]
    n, lengths = len(starts), (stops - starts).astype(float)
    upper, lower = (np.add.reduceat((kinds == k).astype(np.int32), starts) for k in (_UPPER, _LOWER))
    first, last = kinds[starts], kinds[stops - 1]
    top = [c for _, c in folded.most_common(5)]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    line_lengths = np.fromiter(map(len, lines), dtype=float, count=len(lines))
    again = Counter(lines)
    return [
        float(np.log1p(n)),
        float(np.log1p(size)),
        letters / size,
        of[_UPPER] / max(1, letters),
        of[_DIGIT] / size,
        of[_MARK] / size,
        of[_SYMBOL] / size,
        of[_SYMBOL] / n,
        of[_SPACE] / size,
        of[_WIDE] / size,
        lengths.mean() / 10,
        lengths.std() / 10,
        float((lengths > 20).mean()),
        float((lengths <= 3).mean()),
        len(folded) / n,
        len(folded) / n**0.75,
        sum(top) / n,
        top[0] / n,
        1 - len(again) / len(lines),
        max(again.values()) / len(lines),
        float(np.log1p(len(lines))),
        float(np.log1p(line_lengths.mean())),
        line_lengths.std() / (1 + line_lengths.mean()),
        float((first == _UPPER).mean()),
        float(((upper > 1) & (lower == 0)).mean()),
        float((first >= _MARK).mean()),
        float((last == _SYMBOL).mean()),
        *(raw.count(x) / n for x in _RARE[:4]),
        (raw.count(_RARE[4]) + raw.count(_RARE[5])) / n,
        len(zlib.compress(raw, 1)) / size,
    ]


@dataclass
class Model:
    """Everything scoring needs; a few hundred KB whatever the input."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray
    constant: float | None = None

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return features(stats, self.mean, self.scale, self.directions, self.phases) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        raw = self.raw(stats)
        level = self.levels[np.clip(np.searchsorted(self.edges, raw, side="right"), 0, len(self.levels) - 1)]
        return np.clip(0.98 * level + 0.02 / (1 + np.exp(-4 * (raw - 0.5))), 0.0, 1.0)


def features(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    x = np.clip((stats - mean) / scale, -6, 6)
    return np.hstack([np.sqrt(2 / len(phases)) * np.cos(x @ directions + phases), np.ones((len(x), 1))])


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit of least weighted squares."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([float(v), float(w), 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks])


def described(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, text_key and the statistics of every row."""
    out_type = f"row_id long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, stats array<double>"

    def run(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield arrow_batch([(row, doc, key, statistics(text)) for row, doc, key, text in rows], out_type)

    rows = with_row_id(docs.select("doc_id", text_key().alias("text_key"), "text"))
    return rows.select("row_id", "doc_id", "text_key", "text").mapInArrow(run, out_type)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(training: DataFrame, f) -> np.ndarray:
    """The sum over all rows of f(stats, labels), an array of fixed shape, made by each partition."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = f(_matrix(batch.column(0)), batch.column(1).to_numpy())
                total = part if total is None else total + part
        if total is not None:
            yield arrow_batch([(total.ravel().tolist(),)], "total array<double>")

    parts = training.mapInArrow(run, "total array<double>").toArrow()["total"].to_pylist()  # TRAIN_PARTS at most
    return np.sum(np.array(parts), axis=0)


def fit(training: DataFrame) -> Model:
    """``training``: stats array<double>, label double; at most TRAIN_ROWS rows."""
    staged = stage(training.select("stats", "label").coalesce(TRAIN_PARTS), "training")
    try:
        return _fitted(staged.coalesce(TRAIN_PARTS))
    finally:
        unstage(staged)


def _halves(x: np.ndarray) -> np.ndarray:
    """0 or 1 for each row, by its statistics, so that equal rows are in one half."""
    return np.fromiter((zlib.crc32(row.tobytes()) & 1 for row in np.ascontiguousarray(x)), dtype=np.int8, count=len(x))


def _fitted(training: DataFrame) -> Model:
    d = N_STATISTICS
    n, positive = training.agg(F.count("*"), F.sum("label")).first()
    rng = np.random.default_rng(7)
    directions, phases = rng.normal(size=(d, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)
    model = Model(np.zeros(d), np.ones(d), directions, phases, np.zeros(FEATURES + 1), np.array([]), np.array([]))
    if not n or positive in (0, n):
        model.constant = float(positive / n) if n else 0.5
        return model
    moments = _sums(training, lambda x, _: np.stack([x.sum(0), (x * x).sum(0)])).reshape(2, d)
    model.mean = moments[0] / n
    spread = np.sqrt(np.maximum(moments[1] / n - model.mean**2, 0))
    model.scale = np.where(spread > 1e-9, spread, 1.0)
    args = (model.mean, model.scale, directions, phases)

    def normal(x, y):
        z, half = features(x, *args), _halves(x)
        return np.stack([np.hstack([z[half == h].T @ z[half == h], (z[half == h].T @ y[half == h])[:, None]]) for h in (0, 1)])

    def solved(equations, rows):
        return np.linalg.solve(equations[:, :-1] + RIDGE * rows * np.eye(FEATURES + 1) / FEATURES, equations[:, -1])

    equations = _sums(training, normal).reshape(2, FEATURES + 1, FEATURES + 2)
    model.weights = solved(equations.sum(axis=0), n)
    halves = [solved(e, max(e[-1, -2], 1.0)) for e in equations]  # the last feature is 1, so its square counts the rows
    inner = np.linspace(-0.25, 1.25, BINS - 1)

    def binned(x, y):
        z, half = features(x, *args), _halves(x)
        raw = np.where(half == 0, z @ halves[1], z @ halves[0])  # by the half that has not seen the row
        at = np.searchsorted(inner, raw, side="right")
        return np.stack([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)]).astype(float)

    counts = _sums(training, binned).reshape(2, BINS)
    some = counts[0] > 0
    levels = isotonic(counts[1][some] / counts[0][some], counts[0][some])
    model.edges = inner
    model.levels = np.interp(np.arange(BINS), np.flatnonzero(some), levels)
    return model


@tidy
def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, left_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """One row per document row: row_id, doc_id, text_key, held_out, score, predicted."""
    bounded_batches(docs.sparkSession)
    stats = stage(described(docs), "statistics")
    sample = F.broadcast(labelled_sample(labels, label, parts, left_out, TRAIN_ROWS))  # TRAIN_ROWS rows at most
    shared = docs.sparkSession.sparkContext.broadcast(fit(stats.join(sample, "doc_id")))

    def run(batches):
        for batch in batches:
            score = shared.value.score(_matrix(batch.column(3))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score, pa.float64())], names=["row_id", "doc_id", "text_key", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = stats.mapInArrow(run, f"row_id long, doc_id {kind}, text_key long, score double")
    return scored.withColumn("held_out", fold("doc_id", parts) == left_out).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_poor(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, left_out: int = 2, threshold: float = 0.7) -> DataFrame:
    """``docs`` without those that the classifier rejects.

    A row is scored where it is read, so no text is shuffled.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sample = F.broadcast(labelled_sample(labels, label, parts, left_out, TRAIN_ROWS))  # TRAIN_ROWS rows at most
    shared = spark.sparkContext.broadcast(fit(described(docs.select("doc_id", "text").join(sample.select("doc_id").distinct(), "doc_id")).join(sample, "doc_id")))

    def good(texts: pa.Array) -> pa.Array:
        stats = np.array([statistics(x) for x in texts.to_pylist()]).reshape(-1, N_STATISTICS)
        return pa.array(shared.value.score(stats) >= threshold, pa.bool_())

    return docs.where(F.arrow_udf(good, T.BooleanType())("text"))
