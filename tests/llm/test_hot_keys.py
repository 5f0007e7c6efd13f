"""Keys that hold a third of all rows or more, nulls among them, and archives."""

import gzip

from pyspark.sql import functions as F

from tracewright.llm import common, decontaminate, mixing, warc


def test_spread_join_splits_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(common, "hot_from", lambda total: 50)
    left = common.stage(spark.createDataFrame([(1 if i < 400 else i, i) for i in range(600)], "k long, a long"), "left")
    right = common.stage(spark.createDataFrame([(1, 10), (1, 11), (1, 12), (450, 13), (7, 14)], "k long, b long"), "right")
    got = sorted(tuple(r) for r in common.spread_join(left, right, ["k"], F.col("a")).select("k", "a", "b").collect())
    assert got == sorted((1 if i < 400 else i, i, b) for i in range(600) for k, b in [(1, 10), (1, 11), (1, 12), (450, 13), (7, 14)] if k == (1 if i < 400 else i))


def test_a_passage_in_most_documents_and_many_items(spark):
    passage = " ".join(f"p{i}" for i in range(14))
    docs = spark.createDataFrame([(i, f"own{i} {passage} end{i}") for i in range(1500)] + [(9000, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"{passage} item{i}") for i in range(20)], "item_id long, text string")
    got = decontaminate.contamination(docs, items)
    assert got.where("n_items = 20 and n_hit = 14 and contaminated").count() == 1500 and got.where("not contaminated").count() == 1


def test_mixing_of_many_sources_and_null_ids(spark):
    rows = [(None if i % 3 else i, "w " * (1 + i % 7) + str(i % 50), None if i % 4 == 0 else f"s{i % 190:03d}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3, "source")).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken, tuple(r.positions))
    assert len(got) == 2000 and sorted(map(key, got)) == sorted(map(key, again))
    by = {}
    for i, (_, text, source) in enumerate(rows):
        by.setdefault(source, 0)
        by[source] += len(text.split())
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted((s for s in by if s is not None)) + [None])}
    lo, hi = 0.0, float(sum(by.values()))
    for _ in range(200):  # the level at which the capped shares add up, by halving
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(weights[s] * level, 3 * n) for s, n in by.items()) < sum(by.values()) else (lo, level)
    want = {(n, round(min(weights[s] * hi, 3 * n), 4)) for s, n in by.items()}
    assert {(r.source_size, round(r.target, 4)) for r in got} == want
    copies = mixing.with_copies(mixing.mix(docs)).collect()
    assert all((r.position is not None) + (r.position_2 is not None) + (r.position_3 is not None) == r.copies for r in copies)


def test_mixing_without_words(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken, r.positions) for r in mixing.mix(docs).collect()] == [(0, 0.0, 0, [])] * 3


def test_records_of_an_archive(spark, tmp_path):
    body = "z" * 200
    pages = spark.createDataFrame([(1, "u", body), (1, "u", body), (1, "t", body), (2, "v", body), (3, "w", "other" * 50), (4, None, None)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"))
    found = [x for f in (tmp_path / "w").glob("*.gz") for x in warc.records(gzip.open(f))]
    ids = [h["warc-record-id"] for h, _ in found]
    assert len(found) == 6 and len(set(ids)) == 6 and all(h["warc-date"] > "2020" for h, _ in found)
    (original,) = {h["warc-refers-to"] for h, _ in found if h["warc-type"] == "revisit"}
    (kept,) = [h for h, _ in found if h["warc-record-id"] == original]
    assert (kept["warc-type"], kept["x-page-id"], kept["warc-target-uri"]) == ("response", "1", "t")


def test_long_pages_and_clashing_columns(spark):
    rows = [(i, "u", chr(97 + i % 3) * 3_000_000, "x", 1) for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, revisit int")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert got == [(i, 3_000_000, "response" if i < 3 else "revisit", None if i < 3 else i - 3) for i in range(6)]
