"""Chat formatting: tool calls are joined to their results, ordered, validated and written as canonical JSON.

Messages have conv_id, turn, role, text; optionally calls (array of structs id, name, arguments as JSON text, after: ids
of calls whose results it needs) and call_id (the call that a message answers). Calls and results meet in a hash join
on (conversation, identifier), so a conversation with a third of all messages spreads over its identifiers. Of calls
that repeat an identifier, the first by turn and place links; the others are `duplicate`. A result without a call is
`orphan`, a call without a result `unanswered`.

Order: every item has the key (turn, tick). An item comes after what it waits for: where its own turn does not see to that, it
moves to just after the latest of them, and what depends on it moves along. So its key is the latest (turn, length) over the
chains that end in it. Items that wait for nothing more are peeled off, round by round; in between, an item that waits for
one other only is passed over by those that wait for it, so that a chain of n takes log n rounds. A chain longer than the
conversation's items, or items that all wait for several others in a ring, can't be peeled: these items, and what waits for
them, are `cyclic` and keep their own turn. Arguments are checked against the tool's schema; the JSON has sorted keys, no
blanks, and no escapes but those JSON needs.

Nulls: a message with a null turn comes first, a null role counts as 'user', null text is the empty string; an identifier
that is null links with nothing. Arguments that don't parse, hold lone surrogates or numbers that Python refuses, or nest too deep
for its parser are no JSON, and are written as null. Repeated rows are kept, each with the result of the same rules.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import drop, materialise, table

ITEM = "conv_id long, turn long, place int, kind string, role string, call_id string, name string, body string, after array<string>"


def canonical(value: Any) -> str:
    """Sorted keys, no blanks; whole floats as integers; NaN and infinities are null."""

    def plain(v: Any) -> Any:
        if isinstance(v, dict):
            return {str(k): plain(x) for k, x in v.items()}
        if isinstance(v, list | tuple):
            return [plain(x) for x in v]
        if isinstance(v, float):
            if not math.isfinite(v):
                return None
            return int(v) if v.is_integer() and abs(v) < 2**53 else v
        return v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: Any, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    return kind in _TYPES and isinstance(value, _TYPES[kind])


def violation(value: Any, schema: dict, path: str = "$") -> str | None:
    """The first thing in which value breaks the schema, or None: type, enum, bounds, required, properties, items."""
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{path}: not of type {kinds}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: not one of {canonical(schema['enum'])}"
    if isinstance(value, int | float) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            return f"{path}: below {schema['minimum']}"
        if "maximum" in schema and value > schema["maximum"]:
            return f"{path}: above {schema['maximum']}"
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            return f"{path}: shorter than {schema['minLength']}"
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            return f"{path}: longer than {schema['maxLength']}"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for k in schema.get("required", []):
            if k not in value:
                return f"{path}.{k}: missing"
        for k in sorted(value):
            if k in known:
                if bad := violation(value[k], known[k], f"{path}.{k}"):
                    return bad
            elif schema.get("additionalProperties") is False:
                return f"{path}.{k}: unknown"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if bad := violation(x, schema["items"], f"{path}[{i}]"):
                return bad
    return None


def items(messages: DataFrame) -> DataFrame:
    """One row per message (kind message or result) and per call that it makes (kind call, in order of place)."""
    m = messages.withColumn("role", F.coalesce("role", F.lit("user")))
    none = F.lit(None).cast("string")
    calls = F.col("calls") if "calls" in messages.columns else F.lit(None).cast("array<struct<id:string,name:string,arguments:string,after:array<string>>>")
    answers = F.col("call_id") if "call_id" in messages.columns else none
    own = m.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.lit(0).alias("place"), F.when(answers.isNotNull(), "result").otherwise("message").alias("kind"),
        "role", answers.alias("call_id"), none.alias("name"), F.coalesce("text", F.lit("")).alias("body"), F.lit(None).cast("array<string>").alias("after"),
    )
    made = m.select("conv_id", "turn", "role", F.posexplode(calls).alias("k", "c")).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), (F.col("k") + 1).alias("place"), F.lit("call").alias("kind"),
        "role", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("body"), F.col("c.after").alias("after"),
    )
    return own.unionByName(made)


def linked(all_items: DataFrame) -> DataFrame:
    """The items with call_turn (of the call that a result answers), answer_turn, and link: linked, orphan, unanswered, duplicate."""
    low = F.coalesce("turn", F.lit(-(2**62)))
    calls = all_items.where("kind = 'call' and call_id is not null").groupBy(F.col("conv_id").alias("c1"), F.col("call_id").alias("i1")).agg(F.min(F.struct(low.alias("turn"), "place")).alias("first"))
    results = all_items.where("kind = 'result' and call_id is not null").groupBy(F.col("conv_id").alias("c2"), F.col("call_id").alias("i2")).agg(F.min(low).alias("answer_turn"))
    both = calls.join(results, F.col("c1").eqNullSafe(F.col("c2")) & (F.col("i1") == F.col("i2")), "full").select(
        F.coalesce("c1", "c2").alias("c"), F.coalesce("i1", "i2").alias("i"), "first", "answer_turn"
    )
    j = all_items.join(both, all_items.conv_id.eqNullSafe(both.c) & (all_items.call_id == both.i), "left")
    is_first = (F.col("first.turn") == low) & (F.col("first.place") == F.col("place"))
    link = (
        F.when(F.col("kind") == "call", F.when(F.col("call_id").isNull(), "unanswered").when(~is_first, "duplicate").when(F.col("answer_turn").isNull(), "unanswered").otherwise("linked"))
        .when(F.col("kind") == "result", F.when(F.col("first").isNull(), "orphan").otherwise("linked"))
    )
    return j.withColumn("link", link).withColumn("call_turn", F.when(F.col("kind") == "result", F.col("first.turn"))).drop("c", "i", "first")


def ordered(links: DataFrame) -> DataFrame:
    """order_turn, order_tick, cyclic for every item: results after their calls, calls after the results they need."""
    low = F.coalesce("turn", F.lit(-(2**62)))
    own = links.select("conv_id", "call_id", "kind", low.alias("t"), "place", "after", "call_turn", "link")
    # the nodes are (conversation, identifier, call or result); an identifier's first call and results stand for it
    nodes = own.where("link in ('linked', 'unanswered', 'orphan') and call_id is not null").groupBy("conv_id", "call_id", "kind").agg(
        F.min("t").alias("t"), F.flatten(F.collect_set(F.coalesce("after", F.array().cast("array<string>")))).alias("after")
    )
    needs = (
        nodes.where("kind = 'result'").select("conv_id", "call_id", "kind", F.col("call_id").alias("dep"), F.lit("call").alias("dep_kind"))
        .union(nodes.where("kind = 'call'").select("conv_id", "call_id", "kind", F.explode("after").alias("dep"), F.lit("result").alias("dep_kind")))
    )
    # items as numbers; a conversation's number of items bounds its chains
    known = materialise(nodes.select("conv_id", "call_id", "kind", "t", F.monotonically_increasing_id().alias("v")), "chat-nodes")
    d = known.select(F.col("conv_id").alias("dc"), F.col("call_id").alias("di"), F.col("kind").alias("dk"), F.col("v").alias("u"))
    own_v = known.select(F.col("conv_id").alias("vc"), F.col("call_id").alias("vi"), F.col("kind").alias("vk"), "v")
    waits = needs.where("dep is not null").distinct().join(d, F.col("conv_id").eqNullSafe(F.col("dc")) & (F.col("dep") == F.col("di")) & (F.col("dep_kind") == F.col("dk")))
    waits = waits.join(own_v, F.col("conv_id").eqNullSafe(F.col("vc")) & (F.col("call_id") == F.col("vi")) & (F.col("kind") == F.col("vk")))
    sizes = known.groupBy(F.col("conv_id").alias("sc")).agg(F.count("*").alias("most"))
    waits = waits.join(sizes, F.col("conv_id").eqNullSafe(F.col("sc"))).select("v", "u", F.lit(1).cast("long").alias("len"), "most")
    keys, left = _peeled(known.select("v", F.struct("t", F.lit(0).cast("long").alias("tick")).alias("k")), materialise(waits, "chat-waits"))
    cyclic = left.select("v", F.lit(True).alias("moved")).distinct()
    k = known.join(keys, "v").join(cyclic, "v", "left").select(F.col("conv_id").alias("kc"), F.col("call_id").alias("ki"), F.col("kind").alias("kk"), "k", "moved")
    j = links.join(k, links.conv_id.eqNullSafe(F.col("kc")) & (links.call_id == F.col("ki")) & (links.kind == F.col("kk")), "left")
    moved = F.coalesce("moved", F.lit(False))
    free = F.col("k").isNull() | moved | (F.col("link") == "duplicate") | (F.struct(low.alias("t"), F.lit(0).cast("long").alias("tick")) > F.col("k"))
    return j.select(
        *links.columns, F.when(free, low).otherwise(F.col("k.t")).alias("order_turn"), F.when(free, 0).otherwise(F.col("k.tick")).cast("int").alias("order_tick"), (moved & F.coalesce(F.col("link") != "duplicate", F.lit(True))).alias("cyclic")
    )


def _peeled(keys: DataFrame, waits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """keys (v, k) moved behind what they wait for, and the rows of waits that are left: those of items that wait for themselves.

    waits: v waits for u by a chain of len items. Each round applies every wait once; it ends if u waits for nothing, and
    goes on to what u waits for if that is one item. A wait of more than `most` items goes round in a ring and stays.
    """
    first = True
    while True:
        one = waits.groupBy("v").agg(F.count("*").alias("n"), F.first("u").alias("w"), F.first("len").alias("more"))
        one = one.select(F.col("v").alias("ov"), "n", "w", "more")
        step = waits.join(one, F.col("u") == F.col("ov"), "left").join(keys.select(F.col("v").alias("kv"), F.col("k").alias("ku")), F.col("u") == F.col("kv"))
        on = F.col("n").isNotNull() & (F.col("n") == 1) & (F.col("len") <= F.col("most"))
        step = materialise(step.select("v", "u", "len", "most", "ku", F.col("n").isNull().alias("ends"), on.alias("goes_on"), "w", "more"), "chat-step")
        behind = step.groupBy("v").agg(F.max(F.struct(F.col("ku.t").alias("t"), (F.col("ku.tick") + F.col("len")).alias("tick"))).alias("b"))
        keys_next = materialise(keys.join(behind, "v", "left").select("v", F.when(F.col("b") > F.col("k"), F.col("b")).otherwise(F.col("k")).alias("k")), "chat-keys")
        still = step.where("not ends").select("v", F.when(F.col("goes_on"), F.col("w")).otherwise(F.col("u")).alias("u"), (F.col("len") + F.when(F.col("goes_on"), F.col("more")).otherwise(0)).alias("len"), "most")
        waits_next = materialise(still.groupBy("v", "u").agg(F.max("len").alias("len"), F.max("most").alias("most")), "chat-waits")
        changed = step.where("ends or goes_on").limit(1).count()
        drop(step)
        drop(waits)
        if not first:
            drop(keys)
        first, keys, waits = False, keys_next, waits_next
        if not changed:
            return keys, waits


def formatted(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per item: its order, link, whether its arguments are valid, and canonical JSON."""
    done = ordered(linked(items(messages)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            valid, error, out = [], [], []
            for kind, role, call_id, name, body in zip(pdf["kind"], pdf["role"], pdf["call_id"], pdf["name"], pdf["body"], strict=True):
                bad, value = None, None
                if kind == "call":
                    try:
                        value = json.loads(body if isinstance(body, str) else "null")
                        canonical(value).encode()  # lone surrogates are no text
                        bad = violation(value, schemas[name]) if name in schemas else f"unknown tool {name}"
                    except (ValueError, RecursionError):
                        bad, value = "arguments are no JSON", None
                    row = {"role": role, "type": "tool_call", "id": call_id, "name": name, "arguments": value}
                elif kind == "result":
                    row = {"role": role, "type": "tool_result", "tool_call_id": call_id, "content": body}
                else:
                    row = {"role": role, "content": body}
                valid.append(None if kind != "call" else bad is None)
                error.append(bad)
                out.append(canonical(row))
            yield pdf.drop(columns=["body"]).assign(valid=pd.array(valid, dtype="boolean"), error=error, json=out)

    cols = ["conv_id", "turn", "place", "kind", "role", "call_id", "name", "link", "order_turn", "order_tick", "cyclic", "body"]
    kinds = "conv_id long, turn long, place int, kind string, role string, call_id string, name string, link string, order_turn long, order_tick int, cyclic boolean, valid boolean, error string, json string"
    return _arrow(done.select(*cols), run, kinds)


def _arrow(df: DataFrame, run, kinds: str) -> DataFrame:
    """mapInPandas turns integers with nulls into floats; identifiers travel as text beside it."""
    ints = ("conv_id", "turn", "order_turn")
    text = df.select(*[F.col(c).cast("string").alias(c) if c in ints else F.col(c) for c in df.columns])
    out = text.mapInPandas(run, ", ".join(f"{k.split()[0]} string" if k.split()[0] in ints else k for k in kinds.split(", ")))
    return out.select(*[F.col(c).cast("long").alias(c) if c in ints else F.col(c) for c in out.columns])


#: The tool that the query reads into a plain conversation: a user's turn asks, the assistant's next turn answers.
ASK = {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 400}, "turn": {"type": "integer", "minimum": 0}}}


def as_tool_traffic(conversations: DataFrame) -> DataFrame:
    """Plain conversations as tool traffic: each user turn also calls `ask`, each assistant turn answers the turn before it."""
    def name(turn: Column) -> Column:
        return F.concat(F.lit("ask-"), turn.cast("string"))

    t = F.col("turn")
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("prompt"), t.alias("turn")))
    after = F.when(t >= 2, F.array(name(t - 2))).otherwise(F.array().cast("array<string>"))
    call = F.struct(name(t).alias("id"), F.lit("ask").alias("name"), arguments.alias("arguments"), after.alias("after"))
    return conversations.select(
        "conv_id", "turn", "role", "text",
        F.when((F.col("role") == "user") & t.isNotNull(), F.array(call)).otherwise(F.array().cast("array<struct<id:string,name:string,arguments:string,after:array<string>>>")).alias("calls"),
        F.when(F.col("role") == "assistant", name(t - 1)).alias("call_id"),
    )


#: A second tool: shorter prompts, early turns.
NOTE = {"type": "object", "required": ["prompt"], "properties": {"prompt": {"type": "string", "maxLength": 200}, "turn": {"type": "integer", "maximum": 4}}}


def disordered(traffic: DataFrame) -> DataFrame:
    """Tool traffic as it really comes. By conversation, one in five each: in order; calls that need a later call's result;
    identifiers that repeat; rings of calls; results before their calls. Every other call is of `note`."""
    kind, t = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(5)), F.col("turn")

    def name(turn: Column) -> Column:
        return F.concat(F.lit("ask-"), turn.cast("string"))

    def call(c: Column) -> Column:
        after = F.when(kind == 1, F.array(name(t + 2))).when((kind == 3) & (t < 2), F.array(name(t + 2))).otherwise(c["after"])
        return F.struct(
            F.when(kind == 2, name(t - F.pmod(t, F.lit(4)))).otherwise(c["id"]).alias("id"), F.when(F.pmod(t, F.lit(4)) == 3, "note").otherwise(c["name"]).alias("name"), c["arguments"].alias("arguments"), after.alias("after")
        )

    answered = F.when(kind == 2, name((t - 1) - F.pmod(t - 1, F.lit(4)))).when(kind == 4, name(t + 1)).otherwise(F.col("call_id"))
    return traffic.withColumn("calls", F.transform("calls", call)).withColumn("call_id", F.when(F.col("call_id").isNotNull(), answered))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(disordered(as_tool_traffic(table(spark, sf_dir, "conversations"))), {"ask": ASK, "note": NOTE})
