"""Tool-call linking for chat data.

Calls and results are hash-joined by (conversation, identifier). Each call may name earlier calls that it needs (``after``), so calls form a
graph: ``depth`` is the number of calls on the longest chain before it and ``ready`` the latest turn of all that it needs and its own, so sorting by
(ready, depth, turn) puts every call behind what it needs and every result behind its call. The order is found in rounds: what needs a finished call takes over
its depth, and what needs a call that waits for one other waits for that one instead. Chains halve in each round; where calls wait for several open
ones, each such level takes a round of its own. Arguments are checked against a JSON schema per tool and serialised as canonical JSON (sorted
keys, no spaces, shortest numbers).

A repeated identifier belongs to its first call (by turn, then place); later ones are ``duplicate``, and so is a call without conversation or identifier. A
result without call is ``orphan``, a call without result ``unanswered``. ``after`` that names no call counts as absent; calls on a cycle, and those that
need one, have depth and ready null and status ``cyclic``. Null identifiers link with nothing; a null turn comes first. Arguments that are no JSON are
invalid and have no canonical form; a half surrogate pair, which UTF-8 cannot hold, is written as its escape. A message that is too deeply nested to be read has no
calls. Null texts are empty. Texts may be of any length. Other columns are not read, so clashing names do no harm. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, bounded_batches, hot_join, stage, tidy, unstage, with_row_id

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: object) -> str:
    """Canonical JSON; whole floats become integers, and what JSON has no form for is refused."""

    def plain(x):
        if isinstance(x, float):
            if not math.isfinite(x):
                raise ValueError("not a JSON number")
            return int(x) if x.is_integer() and abs(x) < 2**53 else x
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return _utf8(json.dumps(plain(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False))


def _utf8(text: str) -> str:
    """``text`` with half surrogate pairs as their escapes."""
    return text.encode("utf-8", "backslashreplace").decode()


def _text(value: object) -> str | None:
    return None if value is None else _utf8(value if isinstance(value, str) else json.dumps(value))


def violations(value: object, schema: Mapping, path: str = "$") -> Iterator[str]:
    """Where ``value`` breaks ``schema``: type, enum, required, properties, additionalProperties, items, and bounds."""
    kind = schema.get("type")
    if kind in ("integer", "number"):
        whole = isinstance(value, int) or isinstance(value, float) and value.is_integer()
        good = isinstance(value, int | float) and not isinstance(value, bool) and (kind == "number" or whole)
    else:
        good = kind is None or isinstance(value, _TYPES[kind])
    if not good:
        yield f"{path}: not {kind}"
        return
    if "enum" in schema and value not in schema["enum"]:
        yield f"{path}: not in enum"
    if isinstance(value, dict):
        own = schema.get("properties", {})
        yield from (f"{path}.{k}: missing" for k in sorted(schema.get("required", ())) if k not in value)
        for k in sorted(value):
            if k in own:
                yield from violations(value[k], own[k], f"{path}.{k}")
            elif schema.get("additionalProperties") is False:
                yield f"{path}.{k}: not allowed"
    elif isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            yield from violations(x, schema["items"], f"{path}[{i}]")
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            yield f"{path}: length"
    elif isinstance(value, int | float) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            yield f"{path}: out of bounds"


_EVENT = "row_id long, kind string, place int, call_id string, after array<string>, name string, arguments string, content string"


def _events(role: str | None, text: str | None) -> list[tuple]:
    """(kind, place, call_id, after, name, arguments, content) of one message."""
    if role not in ("assistant", "tool") or not (text or "").lstrip().startswith("{"):
        return []
    try:
        body = json.loads(text)
        if role == "tool":
            return [] if body.get("tool_call_id") is None else [("result", 0, _text(body["tool_call_id"]), None, None, None, _text(body.get("content")))]
        calls = body.get("tool_calls")
        out = []
        for i, c in enumerate(x for x in calls if isinstance(x, dict)) if isinstance(calls, list) else ():
            after = c.get("after")
            after = [_text(x) for x in (after if isinstance(after, list) else [after]) if x is not None]
            out.append(("call", i, _text(c.get("id")), after, _text(c.get("name")), _text(c.get("arguments")), None))
        return out
    except (ValueError, RecursionError):
        return []


def parse_messages(messages: DataFrame) -> DataFrame:
    """Events of messages (conv_id, turn, role, text) whose text is JSON: an assistant's ``tool_calls`` and a tool's ``tool_call_id``."""
    bounded_batches(messages.sparkSession)

    def run(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield arrow_batch([(row, *event) for row, role, text in rows for event in _events(role, text)], _EVENT)

    rows = stage(with_row_id(messages.select("conv_id", "turn", "role", "text")), "messages")
    events = rows.select("row_id", "role", "text").mapInArrow(run, _EVENT)
    return rows.select("row_id", "conv_id", "turn").join(events, "row_id").drop("row_id")


def check_arguments(calls: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """``calls`` with ``canonical`` and ``errors`` (null if the arguments fit the schema of the tool)."""
    out_type = "event_id long, canonical string, errors string"

    def run(batches):
        for batch in batches:
            out = []
            for event, name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    value = json.loads(text or "")
                    form = canonical(value)
                    found = [f"unknown tool {name}"] if name not in schemas else list(violations(value, schemas[name]))
                except (ValueError, RecursionError):
                    form, found = None, ["$: not JSON"]
                out.append((event, form, _utf8("; ".join(found)) or None))
            yield arrow_batch(out, out_type)

    return calls.select("event_id", "name", "arguments").mapInArrow(run, out_type)


def _needs(calls: DataFrame) -> DataFrame:
    """(child, parent, dist) of calls that need others; ``dist`` is the number of calls from the one to the other."""
    needs = calls.select(F.col("event_id").alias("child"), "conv_id", F.explode("after").alias("call_id")).distinct()
    uses = needs.groupBy("conv_id", "call_id").agg(F.count("*").alias("uses"))
    named = stage(calls.select("conv_id", "call_id", F.col("event_id").alias("parent")).join(uses, ["conv_id", "call_id"]), "named")
    met = hot_join(needs, named, ["conv_id", "call_id"], "uses", calls.count())
    return met.select("child", "parent", F.lit(1).cast("long").alias("dist"))


def _ordered(calls: DataFrame) -> DataFrame:
    """(event_id, depth, ready, cyclic) of first calls (event_id, conv_id, call_id, after, turn)."""
    total = calls.count()
    edges = stage(_needs(calls), "needs")
    state = stage(calls.select("event_id", F.lit(0).cast("long").alias("depth"), F.col("turn").alias("ready"), F.lit(False).alias("cyclic")), "order")
    while n_edges := edges.count():
        waits = edges.groupBy(F.col("child").alias("event_id")).agg(F.count("*").alias("n"), F.first("parent").alias("up"), F.first("dist").alias("up_dist"))
        uses = edges.groupBy(F.col("parent").alias("event_id")).agg(F.count("*").alias("uses"))
        above = stage(state.join(uses, "event_id").join(waits, "event_id", "left").withColumnRenamed("event_id", "parent"), "above")
        moved = hot_join(edges, above, ["parent"], "uses", n_edges)
        onward = F.when(F.col("n") == 1, F.struct(F.col("up").alias("parent"), (F.col("dist") + F.col("up_dist")).alias("dist"))).when(F.col("n") > 1, F.struct("parent", "dist"))
        moved = moved.select("child", "depth", "ready", "cyclic", "dist", F.when(~F.col("cyclic"), onward).alias("next"), (F.coalesce("n", F.lit(0)) < 2).alias("moves"))
        # a way longer than all calls, or back to its start, is a cycle
        round_trip = F.coalesce((F.col("next.parent") == F.col("child")) | (F.col("next.dist") > total), F.lit(False))
        moved = stage(moved.withColumn("cyclic", F.col("cyclic") | round_trip), "moved")
        stuck = moved.where("moves").isEmpty()
        taken = moved.groupBy(F.col("child").alias("event_id")).agg(
            F.max(F.col("depth") + F.col("dist")).alias("from_depth"), F.max("ready").alias("from_ready"), (F.bool_or("cyclic") | F.lit(stuck)).alias("from_cyclic")
        )
        now = state.join(taken, "event_id", "left")
        now = now.select("event_id", F.greatest("depth", "from_depth").alias("depth"), F.greatest("ready", "from_ready").alias("ready"), (F.col("cyclic") | F.coalesce("from_cyclic", F.lit(False))).alias("cyclic"))
        before, state = state, stage(now, "order")
        left = moved.where(F.col("next").isNotNull() & ~F.lit(stuck)).groupBy("child", F.col("next.parent").alias("parent")).agg(F.max("next.dist").alias("dist"))
        left = left.join(state.where("cyclic").select(F.col("event_id").alias("child")), "child", "left_anti")
        older, edges = edges, stage(left, "needs")
        unstage(before, older, above, moved)
    return state.select("event_id", F.when(~F.col("cyclic"), F.col("ready")).alias("ready"), F.when(~F.col("cyclic"), F.col("depth")).alias("depth"), "cyclic")


@tidy
def link(events: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """``events`` (conv_id, turn, kind, place, call_id, after, name, arguments, content; ``after`` is an array), each with status, ready, depth, canonical, errors, n_results.

    ``ready``, ``depth``, ``kind`` and ``turn`` sort the events of a conversation topologically.
    """
    bounded_batches(events.sparkSession)
    events = stage(with_row_id(events, "event_id"), "events")
    calls, results = events.where("kind = 'call'"), events.where("kind = 'result'")
    key = ["conv_id", "call_id"]
    order = F.struct("turn", "place", "event_id")
    first = calls.where(F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()).groupBy(*key).agg(F.min(order)["event_id"].alias("event_id"))
    own = stage(calls.join(first.select("event_id"), "event_id"), "calls")
    ordered = _ordered(own)
    answered = results.where(F.col("call_id").isNotNull()).groupBy(*key).agg(F.count("*").alias("n_results"))
    done = own.join(ordered, "event_id").join(answered, key, "left").withColumn("n_results", F.coalesce("n_results", F.lit(0).cast("long")))
    done = stage(done.select("event_id", *key, "ready", "depth", "cyclic", "n_results"), "linked")
    checked = check_arguments(calls, schemas)
    status = F.when(F.col("n_results").isNull(), "duplicate").when(F.col("cyclic"), "cyclic").when(F.col("n_results") == 0, "unanswered").otherwise("answered")
    call_rows = calls.join(done.drop(*key), "event_id", "left").join(checked, "event_id").withColumn("status", status)
    targets = done.where("n_results > 0").select(*key, F.col("ready").alias("call_ready"), F.col("depth").alias("call_depth"), "n_results")
    n = results.count()
    met = hot_join(results, targets, key, "n_results", n, "left")
    found = F.col("call_depth").isNotNull()
    result_rows = (
        met.withColumn("ready", F.greatest("turn", "call_ready"))
        .withColumn("depth", F.col("call_depth"))
        .withColumn("status", F.when(found, "linked").otherwise("orphan"))
        .withColumns({"canonical": F.lit(None).cast("string"), "errors": F.lit(None).cast("string"), "n_results": F.lit(None).cast("long")})
    )
    columns = [*events.columns, "status", "ready", "depth", "n_results", "canonical", "errors"]
    return call_rows.select(*columns).unionByName(result_rows.select(*columns))


#: Schema of the calls that plain conversations are turned into.
TURN_SCHEMAS = {
    "say": {"type": "object", "required": ["conversation", "text", "turn"], "additionalProperties": False,
            "properties": {"conversation": {"type": "integer"}, "text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}},
}


def turns_as_events(messages: DataFrame) -> DataFrame:
    """Plain turns as events: what is not the assistant's is a call ``say`` that needs the call two turns before it (turn 1: turn 0),
    and an assistant's turn is the result of the turn before it. Identifiers are made of conversation and turn."""

    def name(turn):
        return F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))

    call = F.coalesce(F.col("role") != "assistant", F.lit(True))
    turn = F.col("turn")
    arguments = F.to_json(F.struct(turn.alias("turn"), F.coalesce("text", F.lit("")).alias("text"), F.col("conv_id").alias("conversation")))
    return messages.select(
        "conv_id",
        "turn",
        F.when(call, "call").otherwise("result").alias("kind"),
        F.lit(0).alias("place"),
        F.when(call, name(turn)).otherwise(name(turn - 1)).alias("call_id"),
        F.when(call & (turn > 0), F.array(name(F.greatest(turn - 2, F.lit(0))))).alias("after"),
        F.when(call, F.lit("say")).alias("name"),
        F.when(call, arguments).alias("arguments"),
        F.when(~call, F.col("text")).alias("content"),
    )
