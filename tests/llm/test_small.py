"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, exact_dedup, line_dedup, mixing, near_dedup, quality, tokens, toolcalls, toxicity, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, text_key long, row_id long, kept string"
LONG = " ".join(f"w{i % 977}" for i in range(20_000))
NEAR = [" ".join(f"a{i}" if i != k * 9 else f"z{k}" for i in range(160)) for k in range(1, 12)]
TEXTS = [None, "", " ", "a", "a b c d", "a\tb  c\nd", LONG, LONG + " end", "Übung ß 😀 x", *NEAR]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", 1, 2, 3, "x") for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[4], (None, "a b c d", None, None, 1, 2, 3, "x"), (None, None, None, "s1", 1, 2, 3, "x")]
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_exact_groups(docs, empty):
    got = exact_dedup.exact_groups(docs).collect()
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in docs.collect()]
    assert len(got) == len(texts) and sum(r.kept for r in got) == len(set(texts))
    assert {r.text_sha256 for r in got} == {hashlib.sha256(t.encode()).hexdigest() for t in texts}
    assert {r.keep_id for r in got if r.group_size == 5} == {4}  # id 4 three times, id 5 by white space, and a null id
    assert exact_dedup.drop_copies(docs).count() == len(set(texts)) and exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_copies(docs).columns == docs.columns


def test_chunks_are_found_again_after_an_insertion(spark):
    text = "".join(f"Sentence {i * 7919 % 1000} about things, and more. Else " for i in range(2000))
    df = spark.createDataFrame([(text,), ("x" + text,)], "t string").select(exact_dedup.chunks_of(F.col("t"), 64, 4096).alias("c"))
    a, b = ([*r.c] for r in df.collect())
    assert "".join(a) == text and len(set(a) & set(b)) > 0.5 * len(set(a))


def _brute(pairs):
    sets = [(d, set(near_dedup.shingles(t).tolist())) for d, t in pairs]
    group = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (d, _) in zip(group, sets, strict=True):
        least[g] = min([x for x in (least.get(g), d) if x is not None], default=None)
    return sorted(((d, len(s), least[g]) for g, (d, s) in zip(group, sets, strict=True)), key=repr)


@pytest.mark.parametrize("small", [64, 3])
def test_near_groups(docs, empty, small, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", small)  # at 3, the way of long lists
    monkeypatch.setattr(near_dedup, "PART", 2 * small)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs).collect()), key=repr)
    assert got == _brute([(r.doc_id, r.text) for r in docs.collect()])
    if small == 64:
        kept = near_dedup.drop_near_copies(docs)
        assert kept.columns == docs.columns and [r.doc_id for r in kept.where("doc_id = 4").collect()] == [4]
        assert near_dedup.near_groups(empty).count() == 0


def test_decontamination(spark, docs, empty):
    run = " ".join(NEAR[0].split()[20:35])
    items = spark.createDataFrame([(1, run), (1, run), (2, "B c"), (3, None), (4, ""), (None, LONG), (5, "zz yy xx")], "item_id long, text string")
    windows = {}
    for item, text in ((r.item_id, r.text) for r in items.collect()):
        w = decontaminate.words_of(text)
        for i in range(max(0, len(w) - 10) + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    want = []
    for r in docs.collect():
        w, hit, found = decontaminate.words_of(r.text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        want.append((r.doc_id, len(w), len(hit), sorted(found)))
    got = [(r.doc_id, r.n_words, r.n_hit, [*r["items"]]) for r in decontaminate.contamination(docs, items).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(x[2] for x in got)
    assert decontaminate.drop_contaminated(docs, items).count() == sum(not x[2] for x in want)
    assert decontaminate.contamination(empty, items).count() == 0
    assert not decontaminate.contamination(docs, items.limit(0)).where("contaminated").count()


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and sum(r.size for r in got) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect())
    assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) and len(r.positions) == r.copies for r in got)
    assert all(0 <= p <= 1 for r in got for p in r.positions)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect())) and mixing.mix(empty).count() == 0
    order = [r.position for r in mixing.training_order(mixing.mix(docs)).collect()]
    assert order == sorted(order)


def test_targets_fill_up(spark):
    df = spark.createDataFrame([("=a", "a", 100), ("=b", "b", 1), ("=c", "c", 10), ("", None, 50)], "key string, source string, size long")
    got = {r.key: r.target for r in mixing.source_targets(df, (1, 2, 3), 3).collect()}
    assert got["=b"] == 3 and got["=c"] == 30 and abs(sum(got.values()) - 161) < 1e-9 and abs(got["=a"] - got[""]) < 1e-9


def test_demand_is_inverted(spark):
    df = spark.range(101).select((F.col("id") / 100).alias("y")).withColumn("t", mixing.invert_demand(F.col("y"), (0.0, 2.0, 1.0)))
    for y, t in df.collect():
        area = 2 * t * t if t <= 0.5 else 0.5 + (t - 0.5) * (2 + (2 - 2 * (t - 0.5))) / 2
        assert abs(area / 1.25 - y) < 1e-9


def test_tokens(spark, docs, empty):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = tokens.count_tokens(docs, path)
    for r in got.collect():
        assert r.n_tokens == len(library.encode(r.text or "")) and r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 4096)
    assert tokens.count_tokens(empty, path).count() == 0
    own = tokens.counter(path)
    for text in ("<s>x</s>", "  a  b ", "\x00\n\n", "▁▁x", "a" * 5000, "é́ﬁ梦", "<0x41>"):
        assert own.count(text) == len(library.encode(text))
    assert tokens.merges(list("aab"), {"aa": 2, "ab": 1, "aab": 3}) == 2


def test_classifiers_take_anything(docs, empty, labels):
    n = docs.count()
    for got in (quality.quality(docs, labels), toxicity.toxicity(docs, labels)):
        rows = got.collect()
        assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert quality.quality(empty, labels).count() == 0 and toxicity.toxicity(empty, labels).count() == 0
    none = labels.limit(0)
    assert {r.score for r in quality.quality(docs, none).collect()} == {0.5} and toxicity.toxicity(docs, none).count() == n
    held = {r.doc_id for r in quality.quality(docs, labels).where("held_out").collect()}
    assert held == {i for i in range(len(TEXTS)) if zlib.crc32(str(i).encode()) % 4 == 2} | ({None} if zlib.crc32(b"") % 4 == 2 else set())


def test_isotonic():
    import numpy as np

    assert quality.isotonic(np.array([0, 1, 0, 2.0]), np.ones(4)).tolist() == [0, 0.5, 0.5, 2]


def test_grammar_contexts():
    g = toxicity.Grammar({"idiot": 3.0, "lowei*": 2.0})
    insult, aimed, reported, negated = toxicity.IS_INSULT, toxicity.IS_AIMED, toxicity.IS_REPORTED, toxicity.IS_NEGATED
    found = g.matches("You idiot. He said idiot, not an idiot; loweichen")[1]
    assert [marks for marks, _ in found] == [insult | aimed, insult | aimed | reported, insult | negated, insult]
    assert [weight for _, weight in found] == [3.0, 3.0, 1.5, 2.0]
    assert g.matches("nothing here") == (2, []) and g.matches(None) == (0, [])


def test_lines(docs, empty):
    got = {(r.doc_id, r.row_id): r for r in line_dedup.removed_lines(docs).collect()}
    assert len(got) == docs.count() and sum(r.n_lines for r in got.values()) == sum(len(r.text.split("\n")) if r.text else 0 for r in docs.collect())
    fours = sorted(r.n_removed for (d, _), r in got.items() if d == 4)
    assert fours == [0, 1, 1]
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and line_dedup.removed_lines(empty).count() == 0


PAGE = "page_id long, url string, html string"


def test_warc(spark, tmp_path):
    body = "x" * 150 + "\r\n\r\nWARC/1.1\r\n\r\né"
    rows = [(5, "u", body), (3, "u b", body), (3, "u b", body), (9, None, "tiny"), (8, None, "tiny"), (7, "v", None), (None, "n", body), (4, "w", "y" * 100)]
    got = warc.round_trip(spark.createDataFrame(rows, PAGE), str(tmp_path / "w")).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to) for r in got) == [
        (False, 3, "response", None), (False, 3, "revisit", 3), (False, 4, "response", None), (False, 5, "revisit", 3),
        (False, 7, "response", None), (False, 8, "response", None), (False, 9, "response", None), (True, 0, "revisit", 3),
    ]
    texts = {5: body, 4: "y" * 100, 7: "", 9: "tiny", 8: "tiny"}
    for r in got:
        text = texts.get(r.page_id, body).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(text), hashlib.sha256(text).hexdigest())
    assert warc.round_trip(spark.createDataFrame([], PAGE)).count() == 0


def test_tool_calls(spark):
    call = lambda i, a, after=None: {"id": i, "name": "add", "arguments": a, "after": after}
    import json

    texts = [
        ("assistant", json.dumps({"tool_calls": [call("c2", {"b": 1.0, "a": "é"}, "c1"), call("c1", '{"a": 3}'), call("x", {}, "y"), call("y", {}, "x")]})),
        ("tool", json.dumps({"tool_call_id": "c2", "content": {"k": 1}})),
        ("tool", json.dumps({"tool_call_id": "none"})),
        ("assistant", json.dumps({"tool_calls": [call("c1", "not json"), call(None, [1])]})),
        ("user", "{"), ("user", None),
    ]
    messages = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(texts)], "conv_id long, turn long, role string, text string")
    schemas = {"add": {"type": "object", "required": ["b"], "properties": {"a": {"type": "string"}, "b": {"type": "integer"}}}}
    got = {(r.turn, r.place, r.kind): r for r in toolcalls.link(toolcalls.parse_messages(messages), schemas).collect()}
    assert (got[0, 0, "call"].status, got[0, 0, "call"].depth, got[0, 0, "call"].canonical, got[0, 0, "call"].errors) == ("answered", 1, '{"a":"é","b":1}', None)
    assert got[0, 1, "call"].status == "unanswered" and got[0, 1, "call"].errors == "$.b: missing; $.a: not string"
    assert got[0, 2, "call"].status == got[0, 3, "call"].status == "cyclic"
    assert got[3, 0, "call"].status == "duplicate" and got[3, 0, "call"].errors == "$: not JSON" and got[3, 1, "call"].status == "duplicate"
    assert got[1, 0, "result"].status == "linked" and got[2, 0, "result"].status == "orphan"
    assert toolcalls.link(toolcalls.parse_messages(messages.limit(0)), schemas).count() == 0


def test_deep_call_chain(spark):
    events = toolcalls.turns_as_events(spark.createDataFrame([(1, 2 * i, "user", "x") for i in range(40)], "conv_id long, turn long, role string, text string"))
    got = {r.turn: (r.depth, r.ready) for r in toolcalls.link(events, toolcalls.TURN_SCHEMAS).collect()}
    assert got == {2 * i: (i, 2 * i) for i in range(40)}
