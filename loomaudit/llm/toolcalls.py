"""Linking of tool calls and results, in DataFrame operations only.

Calls and results are hash-joined by conversation and call id.  A call may name the
call whose result it needs (``after``); its level is the length of that chain, found
by pointer doubling, so a chain of any length takes logarithmically many joins.
Sorting by level, then position, is a topological order.  Arguments are checked
against a schema as JSON variants and everything is serialised as canonical JSON:
sorted keys, no white space, shortest escapes.  No conversation is ever collected:
one row a call is the largest group.

Defined cases: of several calls, or results, with one id the first by position (then
by content) counts, and ``repeats`` tells how many there were more; a result without
a call is an ``orphan``, a call without a result ``pending``; ``after`` a missing call
is level 0; calls on a cycle have a null level and the error ``cycle``; arguments
that are null or no JSON object give the error ``json``; an unknown tool gives
``tool``; null ids are one id; a long text is one value of its row; empty tables give
empty results; other columns are ignored, whatever their names.

Schemas are JSON schemas with type, properties (at any depth), required, enum, minimum,
maximum, minLength, maxLength and the type of items; properties that a schema does not
name are errors.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: JSON type names of schemas and what a variant of that type looks like.
_TYPES = {"string": "^STRING$", "integer": "^BIGINT$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT<.*", "array": "^ARRAY<.*"}


def quoted(text: Column) -> Column:
    """A string as JSON; a null as ``null``."""
    return F.coalesce(F.to_json(text.cast("variant")), F.lit("null"))


def _broken(parsed: Column, path: str, name: str, rule: dict, required: bool) -> list[Column]:
    """What a value breaks of its rule, in fixed order; of objects also their properties, of arrays their items."""
    value = F.try_variant_get(parsed, path, "variant")
    kind, found = F.schema_of_variant(value), []
    there = value.isNotNull() & (kind != "VOID")
    if required:
        found.append(F.when(value.isNull(), f"missing:{name}"))
    if "type" in rule:
        found.append(F.when(value.isNotNull() & ~kind.rlike(_TYPES[rule["type"]]), f"type:{name}"))
    text, number = F.try_variant_get(parsed, path, "string"), F.try_variant_get(parsed, path, "double")
    limits = (
        ("minLength", "short", lambda most: F.length(text) < most),
        ("maxLength", "long", lambda most: F.length(text) > most),
        ("minimum", "small", lambda most: number < most),
        ("maximum", "large", lambda most: number > most),
        ("enum", "enum", lambda all_: there & ~text.isin([x if isinstance(x, str) else json.dumps(x) for x in all_])),
    )
    found += [F.when(broken(rule[key]), f"{word}:{name}") for key, word, broken in limits if key in rule]
    if "items" in rule and "type" in rule["items"]:
        wrong = F.exists(F.try_variant_get(parsed, path, "array<variant>"), lambda x: x.isNull() | ~F.schema_of_variant(x).rlike(_TYPES[rule["items"]["type"]]))
        found.append(F.when(wrong, f"item:{name}"))
    if "properties" in rule:
        found += [F.when(kind.startswith("OBJECT<"), e) for e in _properties(value, parsed, path, f"{name}.", rule)]
    return found


def _properties(value: Column, parsed: Column, path: str, prefix: str, schema: dict) -> list[Column]:
    found = []
    for key, rule in sorted(schema["properties"].items()):
        found += _broken(parsed, f"{path}.{key}", f"{prefix}{key}", rule, key in schema.get("required", ()))
    known = F.array(*(F.lit(k) for k in sorted(schema["properties"])))
    extra = F.array_sort(F.array_except(F.json_object_keys(F.to_json(value)), known))
    return [*found, F.when(F.size(extra) > 0, F.concat(F.lit("unknown:"), F.array_join(F.transform(extra, lambda x: F.concat(F.lit(prefix), x)), "+")))]


def _errors(name: Column, parsed: Column, schemas: dict[str, dict]) -> Column:
    """Errors of a call's arguments in fixed order, joined by commas."""
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT<"), F.lit(False))
    out = F.when(is_object, F.lit("tool")).otherwise(F.lit("json"))
    for tool, schema in sorted(schemas.items()):
        out = F.when((name == tool) & is_object, F.concat_ws(",", *_properties(parsed, parsed, "$", "", schema))).otherwise(out)
    return out


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` for calls with ``conv_id, call_id, after``; null on a cycle.

    Each round replaces a pointer by its target's pointer and adds up the lengths, so
    after ``r`` rounds all chains of up to ``2 ** r`` calls are done.  Only calls whose
    chain has not ended take part in a round's join.
    """
    node = F.struct("conv_id", "call_id")
    here = calls.select(node.alias("node"), F.when(F.col("after").isNotNull(), F.struct("conv_id", F.col("after").alias("call_id"))).alias("up"))
    known = here.select(F.col("node").alias("up"), F.lit(True).alias("there"))
    some = here.filter("up is not null").join(known.hint("shuffle_hash"), "up", "left")
    some = some.select("node", F.when(F.col("there"), F.col("up")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("bigint").alias("d"))
    none = here.filter("up is null").select("node", "up", F.lit(0).cast("bigint").alias("d"))
    since = len(common.written(calls.sparkSession))
    state = common.materialise(some.unionByName(none), "levels")
    total = state.count()
    for _ in range(max(1, total).bit_length() + 1):
        live = state.filter("up is not null")
        if live.isEmpty():
            break
        target = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("d").alias("more"))
        step = live.join(target.hint("shuffle_hash"), "up", "left").select("node", F.col("next").alias("up"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"))
        state = common.materialise(step.unionByName(state.filter("up is null")), "levels")
        common.keep_last(calls.sparkSession, since)
    return state.select("node.conv_id", "node.call_id", F.when(F.col("up").isNull(), F.col("d")).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each call or orphan result.

    ``calls``: conv_id, position, call_id, name, arguments (JSON text), after.
    ``results``: conv_id, position, call_id, content.
    """
    first = lambda d, *cols: d.groupBy("conv_id", "call_id").agg(F.min(F.struct("position", *cols)).alias("x"), (F.count("*") - 1).alias("r"))
    one = first(calls, "name", "arguments", "after").select("conv_id", "call_id", "x.*", F.col("r").alias("more_calls"))
    one = common.materialise(one, "calls")
    two = first(results, "content").select(
        F.col("conv_id").alias("rc"), F.col("call_id").alias("rk"), F.col("x.position").alias("answered"), "x.content", F.col("r").alias("more_results")
    )
    same = F.col("conv_id").eqNullSafe(F.col("rc")) & F.col("call_id").eqNullSafe(F.col("rk"))
    depth = levels(one).select(F.col("conv_id").alias("lc"), F.col("call_id").alias("lk"), "level", F.lit(True).alias("is_call"))
    one = one.join(depth.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("lc")) & F.col("call_id").eqNullSafe(F.col("lk"))).drop("lc", "lk")
    both = one.join(two.hint("shuffle_hash"), same, "full_outer")
    call, answer = F.col("is_call").isNotNull(), F.col("more_results").isNotNull()
    status = F.when(call & answer, "linked").when(call, "pending").otherwise("orphan")
    parsed = F.try_parse_json("arguments")
    wrong = _errors(F.col("name"), parsed, schemas)
    errors = F.when(call, F.concat_ws(",", F.when(wrong != "", wrong), F.when(F.col("level").isNull(), "cycle"))).otherwise("")
    who = F.coalesce("call_id", "rk")
    text = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json(parsed), F.lit("null")), F.lit(',"call_id":'), quoted(who), F.lit(',"name":'), quoted(F.col("name")),
        F.lit(',"result":'), quoted(F.col("content")), F.lit(',"status":"'), status, F.lit('"}'),
    )
    return both.select(
        F.coalesce("conv_id", "rc").alias("conv_id"),
        who.alias("call_id"),
        F.col("position"),
        F.col("answered"),
        "level",
        status.alias("status"),
        (call & (errors == "")).alias("valid"),
        errors.alias("errors"),
        (F.coalesce("more_calls", F.lit(0)) + F.coalesce("more_results", F.lit(0))).alias("repeats"),
        text.alias("json"),
    )


#: The tool that :func:`chat_calls` makes of a conversation.
CHAT_SCHEMA = {"reply": {"properties": {"prompt": {"type": "string", "minLength": 25}, "turn": {"type": "integer", "minimum": 0}}, "required": ["prompt", "turn"]}}


def context(chat: DataFrame) -> DataFrame:
    """Turns that neither call nor answer (system turns, other and null roles), one row each, as :func:`link` has them."""
    other = chat.filter("role is null or role not in ('user', 'assistant')")
    none = lambda kind: F.lit(None).cast(kind)
    text = F.concat(F.lit('{"content":'), quoted(F.col("text")), F.lit(',"role":'), quoted(F.col("role")), F.lit("}"))
    return other.select(
        "conv_id", none("string").alias("call_id"), F.col("turn").alias("position"), none(chat.schema["turn"].dataType).alias("answered"), none("bigint").alias("level"),
        F.lit("context").alias("status"), F.lit(False).alias("valid"), F.lit("").alias("errors"), F.lit(0).cast("bigint").alias("repeats"), text.alias("json"),
    )


def chat_calls(chat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text).

    A user turn calls ``reply`` and needs the result of the user turn two before; an
    assistant turn is the result of the turn before it.  A null turn has a null call id, and
    nothing is linked to it but other null turns.  Other roles are for :func:`context`.
    """
    key = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn = F.col("turn")
    args = F.concat(F.lit('{"turn": '), turn.cast("string"), F.lit(', "prompt": '), quoted(F.col("text")), F.lit("}"))
    calls = chat.filter("role = 'user'").select(
        "conv_id", turn.alias("position"), key(turn).alias("call_id"), F.lit("reply").alias("name"), args.alias("arguments"), key(turn - 2).alias("after")
    )
    results = chat.filter("role = 'assistant'").select("conv_id", turn.alias("position"), key(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
