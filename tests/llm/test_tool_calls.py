"""Messages that could stop a job, calls that need several others, long texts and clashing names."""

import json
import random

from tracewright.llm import toolcalls

SCHEMAS = {"add": {"type": "object", "properties": {"n": {"type": "integer"}, "s": {"type": "string"}}}}
MESSAGE = "conv_id long, turn long, role string, text string"


def _link(spark, texts):
    messages = spark.createDataFrame([(1, i, role, text) for i, (role, text) in enumerate(texts)], MESSAGE)
    return {(r.turn, r.place, r.kind): r for r in toolcalls.link(toolcalls.parse_messages(messages), SCHEMAS).collect()}


def _call(call, arguments="{}", after=None):
    return ("assistant", json.dumps({"tool_calls": [{"id": call, "name": "add", "arguments": arguments, "after": after}]}))


def test_hostile_messages(spark):
    deep = '{"tool_calls":' + "[" * 200_000
    got = _link(spark, [
        ("user", deep), ("assistant", deep), ("assistant", deep + "]" * 200_000 + "}"),
        ("assistant", '{"tool_calls":[{"id":"\\ud800","name":"add","arguments":{"s":"\\udfff"}}]}'),
        ("tool", '{"tool_call_id":"\\ud800","content":"\\ud800"}'),
        _call("big", '{"n": ' + "9" * 400 + "}"), _call("nested", '{"s": ' + "[" * 100_000), _call("nan", '{"n": NaN}'),
        ("assistant", '{"tool_calls":[1,null,{"id":2}]}'), ("tool", "{}"), ("tool", '{"tool_call_id":[1]}'), (None, "{"), ("assistant", "[]"),
    ])
    assert got[3, 0, "call"].status == "answered" and got[3, 0, "call"].canonical == '{"s":"\\udfff"}' and got[3, 0, "call"].errors is None
    assert got[4, 0, "result"].status == "linked" and got[4, 0, "result"].content == "\\ud800"
    assert got[5, 0, "call"].errors is None and got[5, 0, "call"].canonical == '{"n":' + "9" * 400 + "}"
    assert got[6, 0, "call"].errors == got[7, 0, "call"].errors == "$: not JSON"
    assert got[8, 0, "call"].call_id == "2" and got[10, 0, "result"].status == "orphan"
    assert {k[0] for k in got} == {3, 4, 5, 6, 7, 8, 10}


def _depths(needs):
    """Depth by call; None for calls that need a cycle, all by looking at one call at a time."""
    depth, open_calls = {}, dict(needs)
    while ready := [c for c, ups in open_calls.items() if all(u in depth for u in ups if u in needs)]:
        for c in ready:
            depth[c] = max((depth[u] + 1 for u in open_calls[c] if u in needs), default=0)
        for c in ready:
            del open_calls[c]
    return depth | dict.fromkeys(open_calls)


def test_calls_that_need_several_others(spark):
    rng = random.Random(5)
    needs = {f"c{i}": [f"c{rng.randrange(i)}" for _ in range(rng.choice([0, 1, 1, 2, 3]))] if i else [] for i in range(60)}
    needs |= {"x": ["y", "c3"], "y": ["x"], "z": ["y", "c1"], "self": ["self"], "none": ["missing", "c5"]}
    got = _link(spark, [_call(c, after=ups) for c, ups in needs.items()])
    at = {c: i for i, c in enumerate(needs)}
    depths = _depths(needs)
    for c in needs:
        row = got[at[c], 0, "call"]
        assert (row.depth, row.status == "cyclic") == (depths[c], depths[c] is None), c
        ups, seen = [c], set()
        while ups:
            up = ups.pop()
            if up in needs and up not in seen:
                seen.add(up)
                ups += needs[up]
        assert row.ready == (None if depths[c] is None else max(at[u] for u in seen))


def test_long_texts_and_clashing_columns(spark):
    long = "w" * 3_000_000
    messages = spark.createDataFrame([(1, 0, *_call("a", json.dumps({"s": long})), "x", 1), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": long}), "y", 2)], MESSAGE + ", status string, event_id int")
    got = {r.kind: r for r in toolcalls.link(toolcalls.parse_messages(messages), SCHEMAS).collect()}
    assert len(got["call"].canonical) == 3_000_008 and got["call"].status == "answered" and len(got["result"].content) == 3_000_000
