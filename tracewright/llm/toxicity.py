"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer maps words to symbols with weights: insult, threat, target, negation, reported speech, other. Five pattern transducers read the symbols
of a clause: insult and threat mark that they matched, target and reported speech that they were met, and negation, with a short scope, weakens the arcs of
insults and threats behind it. They are composed into one machine, whose arcs multiply the factors and join the marks of theirs; the lexical transducer
is composed with it word by word as texts are read. A clause matches if an insult or threat does: it scores the sum of the weights along its path, times the
weight of its pattern, which is the set of its marks. The best clause, the sum over the clauses, its density and the number of matching clauses give a
document's probability by logistic regression. Without a match the score rests on the prior alone.

Threats, targets, negations and verbs of reported speech are fixed lists. Insults are learned: words and word beginnings
that labelled toxic documents have far more often than others, with their log odds as weights; so are the weights of threats that labels bear out, and those of
the patterns. At most ``TRAIN_ROWS`` labelled rows are used, those of the smallest hash of the id, near copies with one label once. All else covers
all rows and whole texts. The result doesn't depend on how rows are dealt over partitions.

Null texts count as empty and match nothing. Rows of ``labels`` without a document, with a null id or a null label are not
used; repeated ones count once. Without labels of both kinds the fixed lists alone score. Repeated document rows give one result row each; texts of any length are
read whole. Only doc_id and text are read, so clashing names do no harm. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, bounded_batches, fold, labelled_sample, stage, tidy, unstage
from .words import shingles

TRAIN_ROWS = 20_000
#: A learned unit occurs in so many toxic documents, has such log odds and so many standard deviations more of them than chance gives.
LEAST_DOCS, LEAST_ODDS, LEAST_SIGMAS = 5, 1.5, 6.0
#: Lengths of word beginnings that are candidates beside whole words.
STEMS = (4, 5, 6, 7, 8)
SCOPE = 3
INSULT, THREAT, TARGET, NEGATION, REPORTED, OTHER = SYMBOLS = ("insult", "threat", "target", "negation", "reported", "other")
#: Marks of a clause, in the order of the pattern machines.
IS_INSULT, IS_THREAT, IS_AIMED, IS_REPORTED, IS_NEGATED = 1, 2, 4, 8, 16
PATTERNS = 32
# Words of the four languages of the corpus.
THREATS = frozenset("kill hurt destroy murder shoot stab strangle töten umbringen zerstören tuer détruire frapper matar destruir golpear".split())
TARGETS = frozenset("you your yours he she him her they them du dich dein ihr euch er sie tu toi vous ton votre il elle ils tú te usted ustedes tu él ella ellos".split())
NEGATIONS = frozenset("not no never isn't aren't wasn't nicht kein keine nie niemals ne pas jamais non nunca jamás".split())
REPORTS = frozenset("said says say called wrote quoted claimed told sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió".split())
#: Weight of a threat that labels don't bear out; what negation leaves of an insult or threat.
THREAT_WEIGHT, NEGATED = 0.25, 0.5
CLAUSES = re.compile(r"[.!?;:,\n]+")
WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


@dataclass(frozen=True)
class Transducer:
    """Arcs from (state, symbol) to (next state, factor, marks), from state 0; a missing arc stays, with factor 1 and no mark."""

    arcs: dict[tuple[int, str], tuple[int, float, int]]


def matched(symbol: str, mark: int) -> Transducer:
    """Marks the clause at the symbol."""
    return Transducer({(0, symbol): (1, 1.0, mark)})


def negation(scope: int) -> Transducer:
    """The state is the number of words that a negation still covers."""
    arcs = {(s, NEGATION): (scope, 1.0, 0) for s in range(scope + 1)}
    for s in range(1, scope + 1):
        arcs |= {(s, x): (s - 1, 1.0, 0) for x in (OTHER, TARGET, REPORTED)} | {(s, x): (s - 1, NEGATED, IS_NEGATED) for x in (INSULT, THREAT)}
    return Transducer(arcs)


def compose(machines: list[Transducer]) -> list[dict[str, tuple[int, float, int]]]:
    """The product machine: for each state, 0 being the start, its arcs."""
    start = (0,) * len(machines)
    number, arcs, todo = {start: 0}, [], [start]
    for state in todo:
        row = {}
        for x in SYMBOLS:
            steps = [m.arcs.get((s, x), (s, 1.0, 0)) for m, s in zip(machines, state, strict=True)]
            after = tuple(s for s, _, _ in steps)
            if after not in number:
                number[after] = len(todo)
                todo.append(after)
            row[x] = (number[after], math.prod(f for _, f, _ in steps), sum(mark for _, _, mark in steps))
        arcs.append(row)
    return arcs


GRAMMAR = (matched(INSULT, IS_INSULT), matched(THREAT, IS_THREAT), matched(TARGET, IS_AIMED), matched(REPORTED, IS_REPORTED), negation(SCOPE))
N_FEATURES = 7


@dataclass
class Grammar:
    """Lexical weights, pattern weights and regression; what TRAIN_ROWS texts bear out bounds its size."""

    insults: dict[str, float] = field(default_factory=dict)
    patterns: list[float] = field(default_factory=lambda: [1.0] * PATTERNS)
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    _symbols: dict[str, tuple[str, float]] = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.arcs = compose(list(GRAMMAR))

    def __getstate__(self):
        return self.__dict__ | {"_symbols": {}}

    def symbol(self, word: str) -> tuple[str, float]:
        """The lexical transducer: the word's symbol and weight."""
        found = self._symbols.get(word)
        if found is None:
            get = self.insults.get
            weight = max([get(word, 0.0), *(get(word[:k] + "*", 0.0) for k in STEMS if len(word) >= k)])
            if word in THREATS:
                found = (THREAT, max(weight, THREAT_WEIGHT))
            elif weight > 0:
                found = (INSULT, weight)
            else:
                found = (TARGET if word in TARGETS else NEGATION if word in NEGATIONS else REPORTED if word in REPORTS else OTHER, 0.0)
            if len(self._symbols) > 400_000:
                self._symbols.clear()
            self._symbols[word] = found
        return found

    def path(self, clause: str) -> tuple[int, float]:
        """The clause's marks and the sum of the weights along its path through lexicon and grammar."""
        state, marks, total = 0, 0, 0.0
        for word in WORDS.findall(clause):
            symbol, weight = self.symbol(word)
            state, factor, mark = self.arcs[state][symbol]
            marks |= mark
            total += weight * factor
        return marks, total

    def matches(self, text: str | None) -> tuple[int, list[tuple[int, float]]]:
        """The number of words of the whole text, and (marks, weight) of each clause that matches."""
        text = (text or "").lower()
        words = WORDS.findall(text)
        if not any(self.symbol(w)[1] for w in set(words)):
            return len(words), []
        paths = (self.path(clause) for clause in CLAUSES.split(text))
        return len(words), [(marks, weight) for marks, weight in paths if marks & (IS_INSULT | IS_THREAT)]

    def features(self, n_words: int, matches: list[tuple[int, float]]) -> list[float]:
        clauses = [weight * self.patterns[marks] for marks, weight in matches]
        whole = sum(clauses)
        return [np.log1p(whole), np.log1p(100 * whole / max(10, n_words)), max(clauses, default=0.0) / 5, float(bool(clauses)), np.log1p(len(clauses)), np.log1p(n_words) / 5, float(len(clauses) > 1)]

    def score(self, features: list[list[float]]) -> np.ndarray:
        x = np.array(features, dtype=float).reshape(-1, N_FEATURES)
        if self.weights is None:  # the fixed lists alone
            return x[:, 2] / (1 + x[:, 2])
        odds = (_squared((x - self.mean) / self.scale) * self.weights).sum(axis=1)  # row by row, whatever the batch
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _squared(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, x * x, np.ones((len(x), 1))])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's method for ridge logistic regression."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b += np.linalg.solve(x.T @ (x * (q * (1 - q) + 1e-9)[:, None]) + ridge * np.eye(len(b)), x.T @ (y - q) - ridge * b)
    return b


def units(text: str | None) -> set[str]:
    """Candidate units of a text: its words, and beginnings of longer words, marked by a star."""
    words = set(WORDS.findall((text or "").lower()))
    return {w for w in words if len(w) >= 3} | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}


def fit(training: DataFrame) -> Grammar:
    """``training``: text string, label double; at most TRAIN_ROWS rows."""

    def sketched(batches):
        for batch in batches:
            out = []
            for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                least = shingles(text)[:2].view(np.int64).tolist()
                out.append((text, label, *least, *[0] * (2 - len(least))))
            yield arrow_batch(out, "text string, label double, a long, b long")

    # near copies mostly share their two smallest shingles; one of them is enough
    sketches = training.mapInArrow(sketched, "text string, label double, a long, b long")
    staged = stage(sketches.groupBy("a", "b", "label").agg(F.min("text").alias("text")).select("text", "label"), "training")
    try:
        return _fitted(staged)
    finally:
        unstage(staged)


def _fitted(training: DataFrame) -> Grammar:
    n, positive = training.agg(F.count("*"), F.sum("label")).first()
    if not n or positive in (0, n):
        return Grammar()
    negative = n - positive

    def counted(batches):
        of = defaultdict(lambda: [0, 0])
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for u in units(text):
                    of[u][int(label < 0.5)] += 1
        yield arrow_batch([(u, p, q) for u, (p, q) in of.items()], "unit string, p long, q long")

    sums = training.select("text", "label").mapInArrow(counted, "unit string, p long, q long").groupBy("unit").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    odds = F.log((F.col("p") + 0.5) / (positive + 1)) - F.log((F.col("q") + 0.5) / (negative + 1))
    all_docs = F.col("p") + F.col("q")
    sigmas = (F.col("p") - all_docs * positive / n) / F.sqrt(all_docs * positive * negative / n**2)
    chosen = sums.where(F.col("p") >= LEAST_DOCS).withColumn("odds", odds).where((F.col("odds") >= LEAST_ODDS) & (sigmas >= LEAST_SIGMAS))
    grammar = Grammar(dict(chosen.select("unit", "odds").collect()))  # of TRAIN_ROWS texts

    def in_pattern(batches):
        of = Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                of.update((marks, int(label > 0.5)) for marks in {marks for marks, _ in grammar.matches(text)[1]})
        yield arrow_batch([(marks, y, k) for (marks, y), k in of.items()], "marks long, label long, n long")

    summed = training.select("text", "label").mapInArrow(in_pattern, "marks long, label long, n long").groupBy("marks", "label").agg(F.sum("n").alias("n"))
    met = {(marks, y): k for marks, y, k in summed.collect()}  # 2 * PATTERNS rows at most
    grammar.patterns = [(met.get((m, 1), 0) + 2) / (met.get((m, 1), 0) + met.get((m, 0), 0) + 2) for m in range(PATTERNS)]

    def described(batches):
        for batch in batches:
            yield arrow_batch([(grammar.features(*grammar.matches(text)), label) for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], "features array<double>, label double")

    rows = training.select("text", "label").mapInArrow(described, "features array<double>, label double").toArrow()  # TRAIN_ROWS small rows at most
    x, y = np.array(rows["features"].to_pylist()), rows["label"].to_numpy()
    order = np.lexsort((y, *x.T))  # sums of floats depend on it
    x, y = x[order], y[order]
    grammar.mean, grammar.scale = x.mean(0), x.std(0) + 1e-9
    grammar.weights = logistic(_squared((x - grammar.mean) / grammar.scale), y)
    return grammar


@tidy
def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 3, left_out: int = 1, threshold: float = 0.7) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted, n_matches."""
    bounded_batches(docs.sparkSession)
    sample = F.broadcast(labelled_sample(labels, label, parts, left_out, TRAIN_ROWS))  # TRAIN_ROWS rows at most
    grammar = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text").join(sample, "doc_id").select("text", "label")))
    out_type = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, n_matches int"

    def run(batches):
        own = grammar.value
        for batch in batches:
            matches = [own.matches(text) for text in batch.column(1).to_pylist()]
            scores = own.score([own.features(*m) for m in matches]).tolist()
            yield arrow_batch([(doc, x, len(m)) for doc, x, (_, m) in zip(batch.column(0).to_pylist(), scores, matches, strict=True)], out_type)

    scored = docs.select("doc_id", "text").mapInArrow(run, out_type)
    return scored.withColumn("held_out", fold("doc_id", parts) == left_out).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
