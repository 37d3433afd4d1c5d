"""Chat formatting by tool-call linking: calls and results are hash-joined by identifier, ordered, validated and serialised."""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

_CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value: Any) -> str:
    """JSON with sorted keys, no spaces and plain Unicode; equal values give equal text."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def errors(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What keeps ``value`` from a JSON schema's type, enum, required, properties, additionalProperties, items, minimum and maximum."""
    found = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    number = isinstance(value, int | float) and not isinstance(value, bool)
    fits = [isinstance(value, _TYPES[k]) and (k == "boolean" or not isinstance(value, bool)) or k == "integer" and isinstance(value, float) and value.is_integer() for k in kinds if k in _TYPES]
    if fits and not any(fits):
        return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not in enum")
    if number and value < schema.get("minimum", value):
        found.append(f"{at}: below minimum")
    if number and value > schema.get("maximum", value):
        found.append(f"{at}: above maximum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k, v in value.items():
            if k in known:
                found += errors(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for i, v in enumerate(value):
            found += errors(v, schema["items"], f"{at}[{i}]")
    return found


def _object(text: str) -> dict | None:
    try:
        value = json.loads(text)
        canonical(value)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _name(value: Any) -> str | None:
    return None if value is None else value if isinstance(value, str) else canonical(value)


def parse(role: str | None, text: str | None) -> tuple[str | None, list[dict], str | None]:
    """Content, calls and the id that a result answers.

    Calls stand in an assistant's text as ``<tool_call>{"id", "name",
    "arguments"}</tool_call>``; a tool's text is ``{"tool_call_id",
    "content"}``. What does not parse stays content.
    """
    if text and role == "assistant" and "<tool_call>" in text:
        calls: list[dict] = []

        def take(m: re.Match) -> str:
            call = _object(m[1])
            if call is None or _name(call.get("name")) is None:
                return m[0]
            arguments = call.get("arguments", {})
            if isinstance(arguments, str):
                arguments = _object(arguments) or arguments
            calls.append({"id": _name(call.get("id")), "name": _name(call["name"]), "arguments": canonical(arguments)})
            return ""

        rest = _CALL.sub(take, text)
        return (rest.strip() if calls else text), calls, None
    if text and role == "tool" and (held := _object(text)) is not None and "tool_call_id" in held:
        content = held.get("content")
        return (content if isinstance(content, str) else canonical(content)), [], _name(held["tool_call_id"])
    return text, [], None


def _references(value: Any) -> Iterator[str]:
    """Ids of calls whose results ``value`` builds on: ``{"$ref": id}`` at any depth."""
    if isinstance(value, dict):
        if set(value) == {"$ref"} and (ref := _name(value["$ref"])) is not None:
            yield ref
        for v in value.values():
            yield from _references(v)
    elif isinstance(value, list):
        for v in value:
            yield from _references(v)


def order(turns: list[dict]) -> tuple[list[int], bool]:
    """``turns`` (by turn; each with calls that know the turn of their result) in topological order, and whether that failed.

    Turns other than linked results keep their sequence; a result comes after
    its call and before what follows the call; a call comes after results that
    its arguments refer to. Of what is free the earliest turn is first. If
    these wishes form a circle, the given sequence stays.
    """
    after: dict[int, set[int]] = defaultdict(set)
    results = {c["result"] for t in turns for c in t["calls"] if c["result"] is not None}
    line = [i for i in range(len(turns)) if i not in results]
    follows = dict(zip(line, line[1:]))
    for a, b in follows.items():
        after[a].add(b)
    by_id = {c["id"]: c["result"] for t in turns for c in t["calls"] if c["id"] is not None and c["result"] is not None}
    for i, t in enumerate(turns):
        for c in t["calls"]:
            if c["result"] is not None:
                after[i].add(c["result"])
                if i in follows:
                    after[c["result"]].add(follows[i])
            for ref in _references(json.loads(c["arguments"])):
                if ref in by_id:
                    after[by_id[ref]].add(i)
    waits = [0] * len(turns)
    for targets in after.values():
        for b in targets:
            waits[b] += 1
    free = [i for i, n in enumerate(waits) if not n]
    out = []
    while free:
        out.append(i := heapq.heappop(free))
        for b in after[i]:
            waits[b] -= 1
            if not waits[b]:
                heapq.heappush(free, b)
    return (out, False) if len(out) == len(turns) else (list(range(len(turns))), True)


def serialise(turns: list[dict], schemas: dict[str, dict]) -> dict:
    """One conversation: canonical JSON of its turns in order, with what is wrong with each call, and counts."""
    sequence, circular = order(turns)
    answers = {c["result"]: c["id"] for t in turns for c in t["calls"] if c["result"] is not None}
    messages, n_invalid = [], 0
    for i in sequence:
        t = turns[i]
        message: dict[str, Any] = {"role": t["role"], "content": t["content"]}
        if t["calls"]:
            message["tool_calls"] = []
            for c in t["calls"]:
                arguments = json.loads(c["arguments"])
                wrong = errors(arguments, schemas[c["name"]]) if c["name"] in schemas else [f"{c['name']}: unknown tool"]
                n_invalid += bool(wrong)
                message["tool_calls"].append({"id": c["id"], "name": c["name"], "arguments": arguments} | ({"errors": wrong} if wrong else {}))
        if t["result_id"] is not None:
            message |= {"tool_call_id": t["result_id"]} | ({} if i in answers else {"orphan": True})
        messages.append(message)
    n_calls = sum(len(t["calls"]) for t in turns)
    n_results = sum(t["result_id"] is not None for t in turns)
    return {"json": canonical({"messages": messages}), "n_messages": len(turns), "n_calls": n_calls, "n_linked": len(answers), "n_orphans": n_results - len(answers), "n_invalid": n_invalid, "circular": circular}


_PARSED = "conv_id long, turn long, role string, content string, calls array<struct<id:string,name:string,arguments:string>>, result_id string"


def linked(conversations: DataFrame, schemas: dict[str, dict] | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, json, n_messages, n_calls, n_linked, n_orphans, n_invalid, circular)`` for each conversation.

    The n-th call of an id within a conversation is answered by the n-th
    result of that id. Calls without a result stay unanswered; results without
    a call are marked orphan. Arguments are checked against ``schemas`` by tool
    name. Turns go by turn (null last), then role and text; repeated rows are
    repeated messages. A message whose conversation is null is one by itself,
    so no task ever gathers those. Other columns are not read; an empty table
    gives none. A conversation is one JSON text and so one task's work.
    """
    tools = schemas or {}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.string()) for n in ("id", "name", "arguments")]))
        for batch in batches:
            done = [parse(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            content, calls, answered = zip(*done) if done else ((), (), ())
            yield pa.record_batch([*batch.columns[:3], pa.array(content, pa.string()), pa.array(calls, kind), pa.array(answered, pa.string())], ["conv_id", "turn", "role", "content", "calls", "result_id"])

    rows = conversations.select(F.col(conv_col).cast("long"), F.col(turn_col).cast("long"), F.col(role_col).cast("string"), F.col(text_col).cast("string"))
    turns = written(rows.mapInArrow(read, _PARSED).withColumn("row", F.monotonically_increasing_id()), "turns")
    turns = turns.withColumn("conv", F.when(F.col("conv_id").isNull(), F.concat(F.lit("row "), "row")).otherwise(F.col("conv_id").cast("string")))
    place = ["turn_or_last", "role", "content", "row"]
    turns = turns.withColumn("turn_or_last", F.coalesce("turn", F.lit(2**63 - 1)))
    nth = F.row_number().over(Window.partitionBy("conv", "id").orderBy(*place))
    calls = turns.select("conv", "row", "role", "content", "turn_or_last", F.posexplode("calls").alias("k", "call")).withColumn("id", F.col("call.id"))
    calls = calls.withColumn("nth", F.row_number().over(Window.partitionBy("conv", "id").orderBy(*place, "k")))
    results = turns.where("result_id IS NOT NULL").withColumn("id", F.col("result_id")).withColumn("nth", nth)
    results = results.select("conv", "id", "nth", F.col("row").alias("result_row"))
    joined = calls.join(results, ["conv", "id", "nth"], "left")
    answered = joined.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "result_row"))), lambda x: x["result_row"]).alias("result_rows"))
    whole = turns.join(answered, "row", "left")
    turn = F.struct("turn_or_last", "role", "content", "row", "calls", "result_id", "result_rows")
    grouped = whole.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(turn)).alias("turns"))
    names = ("n_messages", "n_calls", "n_linked", "n_orphans", "n_invalid")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for held in batch.column(1):
                held = held.as_py()
                at = {t["row"]: i for i, t in enumerate(held)}
                for t in held:
                    t["calls"] = [c | {"result": None if r is None else at[r]} for c, r in zip(t["calls"] or [], t["result_rows"] or [None] * len(t["calls"] or []))]
                out.append(serialise(held, tools))
            columns = [pa.array([o["json"] for o in out], pa.string()), *(pa.array([o[n] for o in out], pa.int64()) for n in names), pa.array([o["circular"] for o in out], pa.bool_())]
            yield pa.record_batch([batch.column(0), *columns], ["conv_id", "json", *names, "circular"])

    return grouped.select("conv_id", "turns").mapInArrow(write, "conv_id long, json string, " + ", ".join(f"{n} long" for n in names) + ", circular boolean")
