"""Rows with null and repeated ids keep what is theirs."""

from tracewright.llm import line_dedup, near_dedup

OWN = [" ".join(f"{name}{i}" for i in range(160)) for name in "bcdefgh"]


def _near(text):
    return text.replace(text.split()[80], "other")


def test_near_copies_go_by_component(spark):
    rows = [(None, OWN[0]), (None, _near(OWN[0])), (None, OWN[1]), (None, OWN[2]), (7, OWN[3]), (7, OWN[4]), (7, _near(OWN[4])), (None, _near(OWN[3]))]
    rows += [(8, OWN[5]), (8, OWN[5]), (None, OWN[5]), (9, OWN[6]), (3, _near(OWN[6])), (None, ""), (None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(((r.doc_id, r.text) for r in near_dedup.drop_near_copies(docs).collect()), key=repr)
    want = [(None, OWN[0]), (None, OWN[1]), (None, OWN[2]), (7, OWN[3]), (7, OWN[4]), (8, OWN[5]), (3, _near(OWN[6])), (None, ""), (None, None), (7, "")]
    assert got == sorted(want, key=repr)


def _deduped(rows):
    """Rows (id, text) without lines that equal or resemble an earlier one, by comparison of all with all."""
    seen, out = [], {}
    for at in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)):
        kept = []
        for line in (rows[at][1] or "").split("\n"):
            words = set(line.lower().split())
            if not any(100 * len(words & w) >= 75 * len(words | w) for w in seen if words):
                kept.append(line)
            seen += [words] if words else []
        out[at] = (rows[at][0], rows[at][1] and "\n".join(kept))
    return sorted(out.values(), key=repr)


def test_repeated_rows_keep_the_lines_of_the_first(spark):
    twice = "alpha beta gamma delta\n\nepsilon zeta eta\nAlpha beta gamma delta epsilon"
    rows = [(2, twice), (2, twice), (2, twice), (1, "eins zwei drei\nvier fuenf"), (3, "sechs\neins zwei drei"), (3, "sechs\neins zwei drei")]
    rows += [(None, "sieben acht"), (None, "sieben acht"), (None, "neun zehn\nsieben acht"), (4, ""), (4, None), (5, "\n"), (5, "\n"), (6, "unlike all\nvier fuenf")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(docs).collect()), key=repr)
    assert got == _deduped(rows)
    assert (2, "alpha beta gamma delta\n\nepsilon zeta eta") in got and (3, "sechs") in got and (None, "sieben acht") in got
