"""Chat formatting with tool-call linking.

A message's text may hold calls, `<tool_call>{"id": ..., "name": ..., "arguments": {...}}</tool_call>`; a message of
role `tool` whose text is `{"tool_call_id": ..., "content": ...}` is a result. Calls and results meet in a hash join on
conversation and identifier. A call whose arguments name an earlier result, `{"$result": "<id>"}`, comes after that
call: its level is one more than the highest of the calls it needs. Calls are ordered in chunks of about CHUNK, which
hold many small conversations or a part of a large one; only where calls need calls of other chunks do further rounds
follow, in which levels pass from chunk to chunk. A conversation of up to CHUNK calls takes one round, however deep its
chains. Arguments are validated against the tool's JSON schema. Each message comes out as canonical JSON: keys sorted, no blanks, whole
numbers without a fraction, its calls by level and identifier with what was found on them.

Schemas take the keywords type, properties, required, additionalProperties, items, enum, minimum, maximum, minLength
and maxLength. A name without a schema is unknown_tool.

Edge cases: a null text or role counts as empty; text that isn't JSON is plain text, and so is JSON that holds NaN,
an infinity, a number beyond a double's or of over 4,300 digits, or more than DEPTH levels; lone surrogates become
U+FFFD; identifiers are strings or whole numbers; a call without id or name, or with broken JSON, is listed as malformed
and takes no part in linking; of calls with the same conversation and id the first (by turn, place, name and arguments)
is linked and the others are duplicates; of results only the first turn's is linked, others are orphans, as are results
without a call; calls that wait for each other, or for a call that isn't there, have level -1 and come last; repeated
rows come out once each; null conv_id or turn link with nothing; an empty table gives an empty result; further columns
of the input are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain_text, stored

_OPEN, _CLOSE = "<tool_call>", "</tool_call>"
_SURROGATE = re.compile("[\ud800-\udfff]")
#: Levels of JSON, and calls ordered in one task.
DEPTH, CHUNK = 100, 50_000

#: A small set of tools, used where no other is given.
SCHEMAS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string", "minLength": 1}}, "required": ["expression"], "additionalProperties": False},
}

CALL_TYPE = "struct<place:int,id:string,name:string,arguments:string,verdict:string,needs:array<string>>"
LINK_TYPE = "array<struct<place:int,id:string,result_turn:long,level:int>>"
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


#: The result for conversations without calls and results, as those of the test tables are, in DuckDB's SQL. Linking and
#: order are beyond it; a message with a call or a result makes it differ.
ORACLE = """
SELECT conv_id, turn, coalesce(role, '') AS role, 0::BIGINT AS n_calls, 0::BIGINT AS n_linked, 0::BIGINT AS n_invalid, NULL::BIGINT AS answers_turn,
  CAST(json_object('content', coalesce(text, ''), 'role', coalesce(role, '')) AS VARCHAR) AS message
FROM conversations
"""


def _finite(text: str) -> float | int:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"{text} is beyond a double")
    return int(value) if value.is_integer() and abs(value) < 1e15 else value


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def _plain(value, depth: int = 0):
    """The value with lone surrogates replaced; ValueError if it is nested too deep."""
    if depth > DEPTH:
        raise ValueError("nested too deep")
    if isinstance(value, str):
        return _SURROGATE.sub("\ufffd", value)
    if isinstance(value, dict):
        return {_plain(k): _plain(v, depth + 1) for k, v in value.items()}
    return [_plain(v, depth + 1) for v in value] if isinstance(value, list) else value


def parse(text: str):
    """Strict JSON; ValueError for anything else."""
    try:
        return _plain(json.loads(text, parse_float=_finite, parse_constant=_no_constant))
    except RecursionError:
        raise ValueError("nested too deep") from None


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        return not isinstance(value, bool) and (isinstance(value, int) or isinstance(value, float) and (kind == "number" or value.is_integer()))
    return isinstance(value, _TYPES[kind])


def _identifier(value) -> str | None:
    return str(value) if isinstance(value, (str, int)) and not isinstance(value, bool) else None


def violation(value, schema: dict, path: str = "$") -> str | None:
    """The first thing in value that the schema doesn't allow; a reference to another call's result may be anything."""
    if isinstance(value, dict) and set(value) == {"$result"}:
        return None
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return f"{path}: not {'|'.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: not in enum"
    size = len(value) if isinstance(value, str) else value if _is(value, "number") else None
    low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minimum", "maximum")
    if size is not None and (size < schema.get(low, size) or size > schema.get(high, size)):
        return f"{path}: out of range"
    if isinstance(value, dict):
        own = schema.get("properties", {})
        for name in schema.get("required", []):
            if name not in value:
                return f"{path}.{name}: missing"
        for name in sorted(value):
            rest = own.get(name, schema.get("additionalProperties", True))
            found = f"{path}.{name}: not allowed" if rest is False else violation(value[name], {} if rest is True else rest, f"{path}.{name}")
            if found:
                return found
    if isinstance(value, list) and "items" in schema:
        return next((f for i, x in enumerate(value) if (f := violation(x, schema["items"], f"{path}[{i}]"))), None)
    return None


def references(value) -> set[str]:
    """Identifiers of the calls whose results the arguments name."""
    if isinstance(value, dict):
        if set(value) == {"$result"} and (named := _identifier(value["$result"])) is not None:
            return {named}
        return set().union(*map(references, value.values()))
    return set().union(*map(references, value)) if isinstance(value, list) else set()


def read_call(body: str, schemas: dict) -> dict:
    """What a call says; without id and name, or with broken JSON, it is malformed."""
    call = {"id": None, "name": None, "arguments": "null", "verdict": "malformed", "needs": []}
    try:
        found = parse(body)
    except ValueError:
        return call
    if not isinstance(found, dict) or (id := _identifier(found.get("id"))) is None or not isinstance(found.get("name"), str):
        return call
    name, arguments = found["name"], found.get("arguments", {})
    wrong = violation(arguments, schemas[name]) if name in schemas else "unknown_tool"
    return {"id": id, "name": name, "arguments": canonical(arguments), "verdict": wrong or "valid", "needs": sorted(references(arguments))}


def read_result(text: str) -> dict | None:
    """The result that a tool's message is, or None."""
    try:
        found = parse(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) and _identifier(found.get("tool_call_id")) is not None else None


def split_calls(text: str) -> tuple[list[str], str]:
    """What stands between each opening tag and the next closing one, and the text without them. Each tag is looked for
    once: a text of opening tags alone takes no longer than any other."""
    bodies, kept, at = [], [], 0
    while (start := text.find(_OPEN, at)) >= 0 and (end := text.find(_CLOSE, start + len(_OPEN))) >= 0:
        bodies.append(text[start + len(_OPEN) : end])
        kept.append(text[at:start])
        at = end + len(_CLOSE)
    return bodies, "".join([*kept, text[at:]])


def read_message(role: str, text: str, schemas: dict) -> tuple[list[dict], str | None]:
    """The calls in a message, and the identifier that it is the result of."""
    calls = [{"place": n} | read_call(body, schemas) for n, body in enumerate(split_calls(text)[0])]
    result = read_result(text) if role == "tool" and text.lstrip().startswith("{") else None
    return calls, None if result is None else _identifier(result["tool_call_id"])


def order_chunk(rows: pd.DataFrame) -> pd.DataFrame:
    """conv_id, id and level of the calls of a chunk that can be ordered. rows: conv_id, id, needs, and the identifiers
    and levels of needed calls that are settled. Linear in calls and needs."""
    level, needs_of, left, dependants, ready = {}, {}, {}, {}, []
    for conv, ids, known in zip(rows["conv_id"], rows["known"], rows["known_levels"]):
        level |= {(conv, n): k for n, k in zip(ids, known)}
    for conv, id, needs in zip(rows["conv_id"], rows["id"], rows["needs"]):
        call = conv, id
        needs_of[call] = {(conv, n) for n in needs}
        waits = [n for n in needs_of[call] if n not in level]
        left[call] = len(waits)
        for n in waits:
            dependants.setdefault(n, []).append(call)
        if not waits:
            ready.append(call)
    made = []
    while ready:
        call = ready.pop()
        level[call] = 1 + max((level[n] for n in needs_of[call]), default=-1)
        made.append((*call, level[call]))
        for d in dependants.get(call, ()):
            left[d] -= 1
            if not left[d]:
                ready.append(d)
    convs, ids, found = zip(*made) if made else ((), (), ())
    return pd.DataFrame({"conv_id": np.array(convs, rows["conv_id"].dtype), "id": np.array(ids, object), "level": np.array(found, np.int32)})


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, id, level): 0 for calls that need nothing, one more than the highest of those needed for others.

    calls: conv_id, id (unique), turn, needs. Conversations of up to CHUNK calls are dealt to chunks of about as many
    whole ones. Larger ones are cut into equal ranges of turns, dealt by identifier where a range holds more than CHUNK
    calls: no task holds a conversation of any size.
    """
    spans = calls.groupBy("conv_id").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("*").alias("n"))
    width = F.greatest(F.ceil((F.col("high") - F.col("low") + 1) * F.lit(CHUNK) / F.col("n")), F.lit(1))
    placed = calls.join(spans, "conv_id").withColumns({"large": F.col("n") > CHUNK, "block": F.floor((F.col("turn") - F.col("low")) / width)})
    parts = placed.where("large").groupBy("conv_id", "block").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    groups = max(1, calls.count() // CHUNK)
    part = F.when(F.col("large"), F.xxhash64("conv_id", "block", F.pmod(F.xxhash64("id"), F.col("parts")))).otherwise(F.pmod(F.xxhash64("conv_id"), F.lit(groups)))
    placed = placed.join(parts, ["conv_id", "block"], "left").select("conv_id", "id", "needs", F.struct("large", part.alias("part")).alias("chunk"))
    placed = stored(placed)
    needs = placed.where(F.size("needs") > 0).select("conv_id", "id", "chunk", F.explode("needs").alias("need"))
    target = placed.where("chunk.large").select("conv_id", F.col("id").alias("need"), F.col("chunk").alias("need_chunk"))
    across = not needs.where("chunk.large").join(target, ["conv_id", "need"]).where("chunk <> need_chunk").isEmpty()
    nothing = F.array().cast("array<struct<id:string,level:int>>")
    waiting, done = placed.withColumn("settled", nothing), None
    while True:
        told = {"known": F.transform("settled", lambda k: k["id"]), "known_levels": F.transform("settled", lambda k: k["level"])}
        kind = placed.schema["conv_id"].dataType.simpleString()
        fresh = stored(waiting.withColumns(told).drop("settled").groupBy("chunk").applyInPandas(order_chunk, f"conv_id {kind}, id string, level int"))
        done = fresh if done is None else done.unionByName(fresh)
        if not across or fresh.isEmpty():
            return done
        open_calls = placed.join(done, ["conv_id", "id"], "left_anti").where("chunk.large")
        met = needs.join(done.withColumnsRenamed({"id": "need"}), ["conv_id", "need"])
        settled = met.groupBy("conv_id", "id").agg(F.collect_list(F.struct(F.col("need").alias("id"), "level")).alias("settled"))
        waiting = stored(open_calls.join(settled, ["conv_id", "id"], "left").withColumn("settled", F.coalesce("settled", nothing)))


def format_chat(conversations: DataFrame, schemas: dict | None = None) -> DataFrame:
    """conv_id, turn, role, n_calls, n_linked, n_invalid, answers_turn (of the call that a result answers; -1 for an
    orphan, null if not a result) and message (canonical JSON), one row per message."""
    schemas = SCHEMAS if schemas is None else schemas
    base = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), plain_text().alias("text"))
    kinds = {n: base.schema[n].dataType.simpleString() for n in ("conv_id", "turn")}

    def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = pa.list_(pa.struct([("place", pa.int32()), ("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("verdict", pa.string()), ("needs", pa.list_(pa.string()))]))
        for b in batches:
            read = [read_message(r, t, schemas) for r, t in zip(b["role"].to_pylist(), b["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([c for c, _ in read], call), pa.array([a for _, a in read], pa.string())], ["conv_id", "turn", "role", "text", "calls", "answers"])

    read = base.mapInArrow(reading, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, calls array<{CALL_TYPE}>, answers string")
    # Messages are told apart by their text's hash: repeated rows get the same links.
    linking = stored(read.where((F.size("calls") > 0) | F.col("answers").isNotNull()).withColumn("mark", F.xxhash64("text")))
    there = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    calls = linking.where(there).select("conv_id", "turn", "mark", F.explode("calls").alias("c")).select("conv_id", "turn", "mark", "c.*").where("id IS NOT NULL")
    first = F.min(F.struct("turn", "place", "name", "arguments", "mark", "needs")).alias("c")
    primary = stored(calls.groupBy("conv_id", "id").agg(first).select("conv_id", "id", "c.*"))
    results = linking.where(there & F.col("answers").isNotNull()).groupBy("conv_id", F.col("answers").alias("id")).agg(F.min("turn").alias("result_turn"))
    linked = primary.join(results, ["conv_id", "id"], "left").join(levels(primary), ["conv_id", "id"], "left")
    linked = stored(linked.select("conv_id", "turn", "mark", "place", "id", "result_turn", F.coalesce("level", F.lit(-1)).alias("level")))

    per_call = linked.groupBy("conv_id", "turn", "mark").agg(F.collect_list(F.struct("place", "id", "result_turn", "level")).alias("links"))
    asked = linked.select("conv_id", F.col("id").alias("answers"), F.col("turn").alias("call_turn"), F.col("result_turn").alias("turn"))
    joined = linking.join(per_call, ["conv_id", "turn", "mark"], "left").join(asked, ["conv_id", "answers", "turn"], "left")
    empty = F.array().cast(LINK_TYPE)
    names = ["conv_id", "turn", "role", "text", "calls", "answers", "links", "call_turn"]
    plain = read.where((F.size("calls") == 0) & F.col("answers").isNull()).withColumns({"links": empty, "call_turn": F.lit(None).cast("long")})
    joined = joined.withColumns({"links": F.coalesce(F.col("links").cast(LINK_TYPE), empty), "call_turn": F.col("call_turn").cast("long")})

    def writing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [write_message(r) for r in b.to_pylist()]
            columns = list(zip(*out)) if out else [()] * 5
            kinds_out = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["turn"], b["role"], *[pa.array(c, k) for c, k in zip(columns, kinds_out)]], ["conv_id", "turn", "role", "n_calls", "n_linked", "n_invalid", "answers_turn", "message"])

    every = plain.select(*names).unionByName(joined.select(*names))
    return every.mapInArrow(writing, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, n_calls long, n_linked long, n_invalid long, answers_turn long, message string")


def write_message(row: dict) -> tuple[int, int, int, int | None, str]:
    """n_calls, n_linked, n_invalid, answers_turn and the message's JSON."""
    links = {(x["place"], x["id"]): x for x in row["links"]}
    listed = []
    for c in row["calls"]:
        link = links.get((c["place"], c["id"]), {})
        state = c["verdict"] if c["id"] is None or link else "duplicate"
        listed.append({"id": c["id"], "name": c["name"], "arguments": parse(c["arguments"]), "verdict": state, "level": link.get("level", -1), "result_turn": link.get("result_turn")})
    listed.sort(key=lambda c: (c["level"] < 0, c["level"], c["id"] or "", c["name"] or ""))
    message = {"role": row["role"], "content": split_calls(row["text"])[1] if row["calls"] else row["text"]}
    answers = None
    if listed:
        message["tool_calls"] = listed
    if row["answers"] is not None:
        answers = -1 if row["call_turn"] is None else row["call_turn"]
        message |= {"content": read_result(row["text"]).get("content"), "tool_call_id": row["answers"], "call_turn": row["call_turn"]}
    linked = sum(c["result_turn"] is not None for c in listed)
    return len(listed), linked, sum(c["verdict"] != "valid" for c in listed), answers, canonical(message)
