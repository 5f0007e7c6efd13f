"""A posting list of many near copies with outsiders, against brute force."""

from tracewright.llm import near_dedup


def test_outsiders_of_a_long_list(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART", 128)
    base = [f"a{i}" for i in range(60)]
    rows = []
    for i in range(2000):  # near copies: one word of their own
        words = list(base)
        words[i % 60] = f"own{i}"
        rows.append((i, " ".join(words)))
    for i in range(50):  # outsiders share the first half of the words alone, some of them in pairs that are near to each other
        words = base[:30] + [f"b{i // 2}x{k}" for k in range(30)]
        words[45] = f"z{i}"
        rows.append((10_000 + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_groups(docs).collect()}
    sets = {d: frozenset(near_dedup.shingles(t).tolist()) for d, t in rows}
    first = {}
    for i in range(0, 50, 2):
        a, b = sets[10_000 + i], sets[10_001 + i]
        assert 100 * len(a & b) >= 75 * len(a | b)
        first |= {10_000 + i: 10_000 + i, 10_001 + i: 10_000 + i}
    assert not any(100 * len(sets[o] & sets[d]) >= 75 * len(sets[o] | sets[d]) for o in range(10_000, 10_050) for d in range(2000))
    for d, (n, component) in got.items():
        assert n == len(sets[d]) and component == (0 if d < 2000 else first[d])
