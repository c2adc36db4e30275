"""Chat formatting with tool-call linking.

Assistant messages may hold ``<tool_call>{"id": .., "name": .., "arguments": {..}}</tool_call>`` blocks; messages of the role ``tool`` are results:
``{"tool_call_id": .., "content": ..}``, or the same in a ``<tool_result>`` block. Calls and results of a conversation are hash-joined by identifier,
messages get a topological order in which a result follows its call, arguments are validated against JSON schemas, and every message is
serialised as canonical JSON (sorted keys, no spaces, numbers in shortest form).

The output has one row for each message and a sort key in place of a position, so a conversation of any length is never gathered in one task.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, prepare, skew_lookup

_CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
_RESULT = re.compile(r"<tool_result>(.*?)</tool_result>", re.S)

#: JSON schema types and the Python types that hold them.
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float), "null": type(None)}


def whole(text: str) -> str:
    """``text`` with surrogate pairs joined and lone surrogates, which UTF-8 can't hold, replaced by U+FFFD."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def canonical(value) -> str:
    """Canonical JSON; raises ValueError for what JSON can't hold. Lone surrogates become U+FFFD."""

    def plain(v):
        if isinstance(v, str):
            return whole(v)
        if isinstance(v, float):
            if not math.isfinite(v):
                raise ValueError("not a finite number")
            return int(v) if v.is_integer() and abs(v) < 2**53 else v
        if isinstance(v, dict):
            return {whole(str(k)): plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def problem(value, schema: dict, at: str = "$") -> str | None:
    """The first way in which a value breaks a schema (type, enum, required, properties, additionalProperties, items, minimum, maximum)."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        real = [k for k in kinds if isinstance(value, TYPES[k]) and (k in ("boolean",) or not isinstance(value, bool))]
        if not real and not ("integer" in kinds and isinstance(value, float) and value.is_integer()):
            return f"{at}: not of type {'/'.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not one of the listed values"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"] or "maximum" in schema and value > schema["maximum"]:
            return f"{at}: out of range"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for k in sorted(schema.get("required", [])):
            if k not in value:
                return f"{at}.{k}: missing"
        for k in sorted(value):
            if k in known:
                if found := problem(value[k], known[k], f"{at}.{k}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{at}.{k}: not allowed"
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            if found := problem(v, schema["items"], f"{at}[{i}]"):
                return found
    return None


def parse_message(role: str | None, text: str | None, schemas: dict[str, dict]) -> tuple[str, list[tuple[str | None, str | None]], str | None]:
    """(canonical JSON of the message, (call id, problem) of its calls, id of the call that it answers)."""
    body, calls, result = text or "", [], None
    message: dict = {"role": role, "content": text}
    if role == "assistant" and "<tool_call>" in body:
        listed = []
        for raw in _CALL.findall(body):
            try:
                call = json.loads(raw)
                if not isinstance(call, dict):
                    raise ValueError
                args = call.get("arguments")
                if isinstance(args, str):
                    args = json.loads(args)
                own = None if call.get("id") is None else whole(str(call["id"]))
                name = call.get("name")
                wrong = "no id" if own is None else "unknown tool" if not isinstance(name, str) or name not in schemas else problem({} if args is None else args, schemas[name], "$")
                entry = {"id": own, "name": name, "arguments": {} if args is None else args}
                canonical(entry)
            except (ValueError, RecursionError):
                own, wrong, entry = None, "not JSON", {"raw": raw}
            calls.append((own, None if wrong is None else whole(wrong)))
            listed.append(entry)
        message = {"role": role, "content": _CALL.sub("", body).strip(), "tool_calls": listed}
    elif role == "tool":
        inner = _RESULT.search(body)
        try:
            found = json.loads(inner[1] if inner else body)
            if isinstance(found, dict) and (key := found.get("tool_call_id", found.get("id"))) is not None:
                result = whole(str(key))
                candidate = {"role": role, "tool_call_id": result, "content": found.get("content")}
                canonical(candidate)
                message = candidate
        except (ValueError, RecursionError):
            result = None
    return canonical(message), calls, result


def link_tool_calls(chats: DataFrame, schemas: dict[str, dict] | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each row of ``chats``: conv, turn, role, order_turn, order_rank, order_own, message, n_calls, n_answered, n_invalid, problems, result_of, result_status.

    Sorted by the three order columns a conversation is in topological order: a message stands at its turn, a result that came before its call
    right after that call. result_status is ``linked``, ``early`` (moved), ``orphan`` (no such call) or ``unreadable``; null for other messages.
    Of calls that share an id the first counts, a call of null turn before all others; a result of null turn came before any call that has a turn.
    Calls without schema, or whose name is no string, are ``unknown tool``. A null text or role is serialised as null; null conversation ids form one
    conversation; messages of the same turn tie; repeated rows stay, and each counts as a result; texts of any length are parsed whole, one message at a
    time; lone surrogates in JSON become U+FFFD; other columns are ignored; an empty table gives no rows.
    """
    prepare(chats.sparkSession)
    schemas = schemas or {}
    kinds = dict(chats.dtypes)
    read = chats.select(F.col(conv).alias("_c"), F.col(turn).alias("_t"), F.col(role).alias("_r"), F.col(text).alias("_x"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            got = [parse_message(r, t, schemas) for r, t in zip(x.column(2).to_pylist(), x.column(3).to_pylist())]
            ids = [[i for i, _ in c] for _, c, _ in got]
            wrong = [[w for _, w in c] for _, c, _ in got]
            yield pa.RecordBatch.from_arrays(
                [x.column(0), x.column(1), x.column(2), pa.array([m for m, _, _ in got], pa.string()), pa.array(ids, pa.list_(pa.string())), pa.array(wrong, pa.list_(pa.string())), pa.array([r for _, _, r in got], pa.string())],
                ["_c", "_t", "_r", "message", "ids", "wrong", "result_of"],
            )

    parsed = cut(read.mapInArrow(parse, f"_c {kinds[conv]}, _t {kinds[turn]}, _r string, message string, ids array<string>, wrong array<string>, result_of string").withColumn("_key", F.xxhash64("_c", "_t", "_r", "message")).withColumn("_conv", F.coalesce(F.col("_c").cast("string"), F.lit("\u0001"))))
    calls = parsed.where(F.size("ids") > 0).select("_conv", "_t", "_key", F.explode("ids").alias("id")).where("id is not null").distinct()
    first = calls.groupBy("_conv", "id").agg(F.min(F.struct(F.col("_t").isNotNull().alias("known"), F.col("_t").alias("t"))).alias("call"))
    results = parsed.where("result_of is not null").select("_conv", "_t", "_key", F.col("result_of").alias("id"))
    asked = results.groupBy("_conv", "id").agg(F.count("*").alias("_n"))
    linked = skew_lookup(results, first, ["_conv", "id"], asked, how="left").groupBy("_key").agg(F.min("call").alias("call"))
    uses = calls.groupBy("_conv", "id").agg(F.count("*").alias("_n"))
    answered = skew_lookup(calls, asked.select("_conv", "id"), ["_conv", "id"], uses).groupBy("_key").agg(F.count("*").alias("n_answered"))
    quiet = parsed.where("result_of is null and size(ids) = 0").select("*", F.lit(None).cast(f"struct<known:boolean,t:{kinds[turn]}>").alias("call"), F.lit(None).cast("long").alias("n_answered"))
    busy = parsed.where("result_of is not null or size(ids) > 0").join(linked, "_key", "left").join(answered, "_key", "left")
    out = quiet.unionByName(busy)
    early = F.coalesce(F.col("call.known") & (F.col("_t").isNull() | (F.col("call.t") > F.col("_t"))), F.lit(False))
    status = F.when(F.col("result_of").isNotNull(), F.when(F.col("call").isNull(), "orphan").when(early, "early").otherwise("linked")).when(F.col("_r") == "tool", "unreadable")
    bad = F.filter("wrong", lambda w: w.isNotNull())
    return out.select(
        F.col("_c").alias(conv), F.col("_t").alias(turn), F.col("_r").alias(role), F.when(early, F.col("call.t")).otherwise(F.col("_t")).alias("order_turn"), F.when(early, 1).otherwise(0).alias("order_rank"), F.col("_t").alias("order_own"),
        "message", F.size("ids").cast("long").alias("n_calls"), F.coalesce("n_answered", F.lit(0)).cast("long").alias("n_answered"), F.size(bad).cast("long").alias("n_invalid"), bad.alias("problems"), "result_of", status.alias("result_status"),
    )
