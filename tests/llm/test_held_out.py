"""Held-out accuracy of the classifiers, and results that don't depend on how rows are dealt."""

import pytest
from pyspark.sql import functions as F

from tracewright.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def _held_out(scored, labels, label):
    return scored.where("held_out").join(labels.where(F.col(label).isNotNull()), "doc_id").select("predicted", F.col(label).alias("label")).collect()


def test_toxicity_finds_held_out_toxic_documents(tables):
    docs, labels = tables
    rows = _held_out(toxicity.toxicity(docs, labels), labels, "toxic")
    toxic = [r.predicted for r in rows if r.label == 1]
    clean = [r.predicted for r in rows if r.label == 0]
    assert len(toxic) >= 10 and sum(toxic) >= 0.75 * len(toxic)  # the misses hold no insult at all
    assert sum(clean) <= 0.02 * len(clean)


def test_toxicity_is_the_same_for_other_partitions(tables):
    docs, labels = tables
    one, two = ({r.doc_id: r.score for r in toxicity.toxicity(d, labels).collect()} for d in (docs.repartition(3), docs.repartition(7, "text")))
    assert one == two


def test_quality_is_right_on_held_out_documents(tables):
    docs, labels = tables
    rows = _held_out(quality.quality(docs, labels), labels, "quality")
    assert len(rows) >= 50 and sum(r.predicted == r.label for r in rows) >= 0.95 * len(rows)


def test_dropping_poor_documents_follows_the_scores(tables):
    docs, labels = tables
    kept = sorted(r.doc_id for r in quality.drop_poor(docs, labels).select("doc_id").collect())
    assert kept == sorted(r.doc_id for r in quality.quality(docs, labels).where("predicted = 1").select("doc_id").collect())


def test_ties_and_repeated_labels(spark):
    docs = spark.createDataFrame([(i, "same text here" if i % 2 else "you idiot you fool") for i in range(60)] + [(1, "same text here"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(60)] * 2, "doc_id long, quality int, toxic int")
    for f in (quality.quality, toxicity.toxicity):
        rows = f(docs, labels).collect()
        assert len(rows) == 62 and len({round(r.score, 12) for r in rows}) <= 3 and all(0 <= r.score <= 1 for r in rows)
