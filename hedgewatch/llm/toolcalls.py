"""Tool-call linking: calls meet their results by identifier, in an order in which every call follows those it needs.

Calls and results are hash-joined on (conversation, identifier). A call's level is 0, or one more than the highest level of
the calls it refers to; sorting by level, turn and position is a topological order. A conversation's levels are found in one
task; those of very large conversations for all of them at once, one round a level. Arguments are checked against the tool's schema, and each call is written as canonical JSON.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hedgewatch.session import broadcast_up_to, cut_lineage

#: Turns of a conversation that are numbered in one task; a longer conversation is numbered in parts.
TURNS_AT_ONCE = 512
#: Calls and references of a conversation whose levels are found in one task, and how many larger conversations are broadcast.
REFERENCES_AT_ONCE, LARGE_BROADCAST = 50_000, 1_000_000
#: Stands for a missing turn: such rows come last.
NO_TURN = 1 << 62
_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical_json(value: object) -> str:
    """JSON without white space, keys in code-point order, no escapes but those JSON demands, whole numbers without a fraction."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical_json(str(k))}:{canonical_json(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        value = int(value)
    return json.dumps(value, ensure_ascii=False, allow_nan=False)


def fits(value: object, kind: str) -> bool:
    if kind in ("number", "integer"):
        number = isinstance(value, int | float) and not isinstance(value, bool) and math.isfinite(value)
        return number and (kind == "number" or float(value).is_integer())
    return isinstance(value, _TYPES[kind])


def problems(value: object, schema: dict, at: str = "$") -> list[str]:
    """What in ``value`` breaks ``schema`` (type, enum, required, properties, additionalProperties, items, minimum, maximum,
    minLength, maxLength), by place."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(fits(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not one of the choices")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in own:
                found += problems(value[k], own[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        found += [p for i, v in enumerate(value) for p in problems(v, schema["items"], f"{at}[{i}]")]
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
        found.append(f"{at}: length out of range")
    if fits(value, "number") and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        found.append(f"{at}: out of range")
    return found


def _unique_keys(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a key comes twice")
    return dict(pairs)


def _no_constant(name: str) -> object:
    raise ValueError(f"{name} is not JSON")


def parsed(arguments: str | None) -> object:
    """Arguments as JSON; raises ``ValueError`` where they are none, name a key twice, or hold NaN or infinity."""
    value = json.loads(arguments or "", object_pairs_hook=_unique_keys, parse_constant=_no_constant)
    canonical_json(value)  # a number too large for a double reads as infinity
    return value


def call_levels(needs: dict[str, set[str]]) -> dict[str, int | None]:
    """Levels of the calls of one conversation, by Kahn's method: a call is ready once all that it needs are."""
    followers: dict[str, list[str]] = {}
    waits = {}
    for call, needed in needs.items():
        known = [n for n in needed if n in needs]
        waits[call] = len(known)
        for n in known:
            followers.setdefault(n, []).append(call)
    level: dict[str, int | None] = dict.fromkeys(needs)
    ready, step = [c for c, n in waits.items() if not n], 0
    while ready:
        after = []
        for call in ready:
            level[call] = step
            for follower in followers.get(call, ()):
                waits[follower] -= 1
                if not waits[follower]:
                    after.append(follower)
        ready, step = after, step + 1
    return level


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): level null for calls in a circle, and for those that need one.

    ``calls``: (conv_id, call_id, after array of call_id); calls of one identifier count as one that needs what any of them needs. A
    reference to an identifier that no call of the conversation has does not count, nor does one that is null. Conversations with up to
    ``REFERENCES_AT_ONCE`` calls and references are one row each, larger ones are never brought together. An empty table gives no rows.
    """
    calls = calls.select("conv_id", "call_id", "after")
    size = F.sum(1 + F.greatest(F.size("after"), F.lit(0))).alias("size")
    large = cut_lineage(calls.groupBy("conv_id").agg(size).where(F.col("size") > REFERENCES_AT_ONCE).select("conv_id"))
    if large.isEmpty():
        return _levels_at_once(calls)
    known = broadcast_up_to(large, LARGE_BROADCAST)
    return _levels_at_once(calls.join(known, "conv_id", "left_anti")).unionByName(
        _levels_in_rounds(calls.join(known, "conv_id", "left_semi")))


def _levels_at_once(calls: DataFrame) -> DataFrame:
    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, names, found = [], [], []
            for i in range(batch.num_rows):
                needs: dict[str, set[str]] = {}
                for call in batch.column("own").slice(i, 1).flatten().to_pylist():
                    needs.setdefault(call["call_id"], set()).update(call["after"] or ())
                level = call_levels(needs)
                owners += [i] * len(level)
                names += level
                found += level.values()
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array(owners, pa.int64())), pa.array(names, pa.string()),
                                              pa.array(found, pa.int32())], names=["conv_id", "call_id", "level"])

    each = calls.groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "after")).alias("own"))
    return each.mapInArrow(order, f"conv_id {calls.schema['conv_id'].dataType.simpleString()}, call_id string, level int")


def _levels_in_rounds(calls: DataFrame) -> DataFrame:
    """The same with one round a level, over all conversations at once."""
    nodes = cut_lineage(calls.select("conv_id", "call_id").distinct())
    edges = calls.select("conv_id", "call_id", F.explode("after").alias("needs")).distinct()
    edges = cut_lineage(edges.join(nodes.withColumnRenamed("call_id", "needs"), ["conv_id", "needs"], "left_semi"))
    waiting = cut_lineage(edges.select("conv_id", "call_id").distinct())
    done = cut_lineage(nodes.join(waiting, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0)))
    level, fresh = 0, done
    open_ = edges
    while not open_.isEmpty():
        level += 1
        # What the last level settled is needed no more; calls that need nothing else are the next level.
        after = cut_lineage(open_.join(fresh.select("conv_id", F.col("call_id").alias("needs")), ["conv_id", "needs"], "left_anti"))
        fresh = cut_lineage(open_.select("conv_id", "call_id").distinct().join(
            after.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level)))
        if fresh.isEmpty():
            break
        done, open_ = done.unionByName(fresh), after
    return nodes.join(done, ["conv_id", "call_id"], "left")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Calls with their results, in order; results that no call asked for last.

    ``calls``: (conv_id, turn, call_id, name, arguments JSON text, after array of call_id); ``results``: (conv_id, turn, call_id, content).
    Returns (conv_id, place from 0, call_id, name, level, status, problems array, result_turn, json). status: ``linked``,
    ``unanswered`` (no result), ``circular`` (in a circle of references, or needing one; placed after all levels) or ``orphan`` (a result without
    call). json is canonical: id, name, arguments (their text where they are no JSON), after, and result where there is one. Of calls or
    results that share an identifier the first counts (by turn, then content: a call's name, references and arguments); the others are dropped as repeats. Rows without
    conversation or identifier take no part. Unknown tools and arguments that break their schema are named in problems. Empty tables give no rows.
    """
    key = ["conv_id", "call_id"]
    known = calls.where("conv_id IS NOT NULL AND call_id IS NOT NULL").select(
        *key, F.coalesce("turn", F.lit(NO_TURN)).alias("turn"), "name", "arguments",
        F.sort_array(F.array_distinct(F.coalesce("after", F.array().cast("array<string>")))).alias("after"))
    answers = results.where("conv_id IS NOT NULL AND call_id IS NOT NULL").select(
        *key, F.coalesce("turn", F.lit(NO_TURN)).alias("turn"), "content")
    # The order is found on rows without arguments and contents. The first of several is the same with and without: what is left out comes last.
    slim = cut_lineage(known.groupBy(*key).agg(F.min(F.struct("turn", "name", "after")).alias("call")).select(*key, "call.turn", "call.after"))
    places = slim.select(*key, "turn", F.lit(True).alias("is_call")).join(
        answers.groupBy(*key).agg(F.min("turn").alias("result_turn")), key, "full").join(levels(slim), key, "left")
    places = _placed(places.select(*key, "level", F.coalesce("turn", "result_turn").alias("at"), F.when(
        F.col("is_call").isNull(), F.lit((1 << 31) - 1)).otherwise(F.coalesce("level", F.lit((1 << 31) - 2))).alias("step")))
    one = known.groupBy(*key).agg(F.min(F.struct("turn", "name", "after", "arguments")).alias("call"))
    answered = answers.groupBy(*key).agg(F.min(F.struct("turn", "content")).alias("result"))
    status = (F.when(F.col("call").isNull(), "orphan").when(F.col("level").isNull(), "circular")
              .when(F.col("result").isNull(), "unanswered").otherwise("linked"))
    rows = one.join(answered, key, "full").join(places.select(*key, "level", "place"), key)
    return _written(rows.select(*key, "place", "level", status.alias("status"), "call.name", "call.arguments", "call.after", "result"), schemas)


def _placed(rows: DataFrame) -> DataFrame:
    """``place`` by step, turn and identifier. A long conversation is numbered in parts of its order."""
    part = rows.withColumn("part", F.floor(F.col("at") / TURNS_AT_ONCE))
    counts = part.groupBy("conv_id", "step", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("step", "part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("conv_id", "step", "part").orderBy("at", "call_id")) - 1
    return part.withColumn("own", place).join(counts, ["conv_id", "step", "part"]).withColumn("place", F.col("before") + F.col("own"))


def _written(rows: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    known = json.dumps(schemas)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = json.loads(known)
        for batch in batches:
            found, texts = [], []
            for r in batch.select(["call_id", "name", "arguments", "after", "content", "status"]).to_pylist():
                own, out = [], {"id": r["call_id"]}
                if r["status"] != "orphan":
                    out |= {"name": r["name"], "after": r["after"]}
                    if r["name"] not in tools:
                        own.append("$: unknown tool")
                    try:
                        out["arguments"] = parsed(r["arguments"])
                        own += problems(out["arguments"], tools.get(r["name"], {}))
                    except (ValueError, RecursionError):
                        out["arguments"] = r["arguments"]
                        own.append("$: not JSON")
                if r["status"] != "unanswered" and r["content"] is not None:
                    out["result"] = r["content"]
                found.append(own)
                texts.append(canonical_json(out))
            arrays = [batch.column(c) for c in kept] + [pa.array(found, pa.list_(pa.string())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "problems", "json"])

    kept = ["conv_id", "place", "call_id", "name", "level", "status", "result_turn"]
    flat = rows.select("conv_id", "place", "call_id", "name", "level", "status", F.nullif(F.col("result.turn"), F.lit(NO_TURN)).alias("result_turn"),
                       "arguments", "after", F.col("result.content").alias("content"))
    schema = ", ".join(f"{c} {flat.schema[c].dataType.simpleString()}" for c in kept)
    return flat.mapInArrow(write, f"{schema}, problems array<string>, json string").select(
        "conv_id", "place", "call_id", "name", "level", "status", "problems", "result_turn", "json")
