"""Tool calls of conversations, linked with their results and put in order.

Calls and results are joined by (conversation, call id). A call may name the call it waits for; its
depth is the number of calls before it on that way, found by doubling pointers, so a chain of n
calls takes log2(n) joins. Calls are numbered by depth, which is a topological order, also in a
conversation that fills many tasks. Arguments are parsed, checked against the tool's schema and
written as canonical JSON (sorted keys, no spaces, shortest numbers, UTF-8) in Arrow batches.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from poolsight.llm.ranks import ranked
from poolsight.session import cut

_TYPES = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "null": lambda v: v is None,
}


#: Keywords that are checked, and those that say nothing about a value.
CHECKED = frozenset("type enum minimum maximum required properties additionalProperties items".split())
NOTES = frozenset("$schema $id $comment title description default examples".split())


def check_schema(schema: Mapping, at: str = "$") -> None:
    """ValueError for a schema with unknown types or keywords that `schema_errors` would pass over."""
    other = sorted(set(schema) - CHECKED - NOTES)
    if other:
        raise ValueError(f"{at}: keywords that are not checked: {', '.join(other)}")
    wanted = schema.get("type", [])
    for kind in [wanted] if isinstance(wanted, str) else wanted:
        if kind not in _TYPES:
            raise ValueError(f"{at}: there is no type {kind!r}")
    if not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError(f"{at}: additionalProperties must be true or false")
    for name, inner in schema.get("properties", {}).items():
        check_schema(inner, f"{at}.{name}")
    if "items" in schema:
        check_schema(schema["items"], f"{at}[]")


def schema_errors(value: object, schema: Mapping, at: str = "$") -> list[str]:
    """What is wrong with a parsed value: type, enum, minimum, maximum, required, properties, additionalProperties, items."""
    wanted = schema.get("type")
    kinds = [wanted] if isinstance(wanted, str) else list(wanted or [])
    if kinds and not any(_TYPES[k](value) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    errors = []
    if "enum" in schema and value not in schema["enum"]:
        errors.append(f"{at}: not one of the listed values")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", -math.inf):
            errors.append(f"{at}: below {schema['minimum']}")
        if value > schema.get("maximum", math.inf):
            errors.append(f"{at}: above {schema['maximum']}")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        errors += [f"{at}.{name}: missing" for name in schema.get("required", ()) if name not in value]
        for name in sorted(value):
            if name in known:
                errors += schema_errors(value[name], known[name], f"{at}.{name}")
            elif schema.get("additionalProperties") is False:
                errors.append(f"{at}.{name}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            errors += schema_errors(item, schema["items"], f"{at}[{i}]")
    return errors


def canonical(value: object) -> str:
    """One text for each JSON value: sorted keys, no spaces, whole numbers without a fraction."""

    def plain(v: object) -> object:
        if isinstance(v, float) and v.is_integer() and abs(v) < 1 << 53:
            return int(v)
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _only_json(name: str) -> float:
    raise ValueError(f"{name} is not JSON")


def check_call(name: str | None, arguments: str | None, result: str | None, call_id: str, schemas: Mapping) -> tuple[str, list[str]]:
    """Canonical message of one call, and what is wrong with it."""
    errors: list[str] = []
    try:
        value = json.loads(arguments if arguments is not None else "", parse_constant=_only_json)
        canonical(value).encode()  # escapes may stand for half a character, which no UTF-8 text holds
    except (ValueError, RecursionError):
        value, errors = arguments, ["$: not JSON"]
    else:
        if name not in schemas:
            errors = ["unknown tool"]
        else:
            errors = schema_errors(value, schemas[name])
    return canonical({"arguments": value, "id": call_id, "name": name, "result": result}), errors


def _messages(schemas: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names, arguments, results = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("call_id", "name", "arguments", "result"))
            found = [check_call(n, a, r, i, schemas) for i, n, a, r in zip(ids, names, arguments, results)]
            kept = [c for c in batch.schema.names if c not in ("arguments", "result")]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            columns += [pa.array([m for m, _ in found], pa.string()), pa.array([e for _, e in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "message", "errors"])

    return run


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth) for unique calls with `parent_id`: calls before it on the way; null on or behind a cycle."""
    nodes = calls.select("conv_id", "call_id", F.col("parent_id").alias("ptr"))
    known = calls.select("conv_id", F.col("call_id").alias("ptr"), F.lit(1).cast("long").alias("known"))
    start = nodes.join(known, ["conv_id", "ptr"], "left").select(
        "conv_id", "call_id", F.when(F.col("known").isNotNull(), F.col("ptr")).alias("ptr"), F.coalesce("known", F.lit(0)).alias("depth")
    )
    now = cut(start)
    reach, n = 1, now.count()
    while reach <= n and not now.filter("ptr is not null").isEmpty():
        next_ = now.select("conv_id", F.col("call_id").alias("ptr"), F.col("ptr").alias("onward"), F.col("depth").alias("more"))
        now = cut(
            now.join(next_, ["conv_id", "ptr"], "left").select(
                "conv_id", "call_id", F.col("onward").alias("ptr"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")
            )
        )
        reach *= 2
    return now.select("conv_id", "call_id", F.when(F.col("ptr").isNull(), F.col("depth")).alias("depth"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping]) -> DataFrame:
    """conv_id, call_id, name, turn, step, depth, status, errors, message: a row per call.

    `calls`: conv_id, call_id, parent_id (null if it waits for none), turn, name, arguments (JSON
    text). `results`: conv_id, call_id, result. step numbers a conversation's calls from 0 by (depth,
    turn, call_id); calls on or behind a cycle come last, with depth null. A parent that is not
    there counts as none. Of repeated calls the first by turn, name and arguments stays, of repeated
    results the smallest text; results without a call are left out. Rows without conv_id or call_id
    cannot be linked and are left out too. status is the first that holds of: cycle, invalid (errors
    tells why), pending (no result), done. Arguments of any length are checked whole; text that is not
    JSON, or that no UTF-8 text can hold, is invalid and passed on as it is. Empty tables give no
    rows, other columns are ignored. Schemas may use the keywords of `CHECKED` and `NOTES`; others, and
    unknown types, are refused before anything runs.
    """
    for name, schema in schemas.items():
        check_schema(schema, name)
    first = Window.partitionBy("conv_id", "call_id").orderBy("turn", "name", "arguments")
    unique = (
        calls.select("conv_id", F.col("call_id").cast("string"), F.col("parent_id").cast("string"), F.col("turn").cast("long"), "name", "arguments")
        .dropna(subset=["conv_id", "call_id"])
        .withColumn("_tc_row", F.row_number().over(first))
        .filter("_tc_row = 1")
        .drop("_tc_row")
    )
    unique = cut(unique)
    answers = (
        results.select("conv_id", F.col("call_id").cast("string"), F.col("result").cast("string"))
        .dropna(subset=["conv_id", "call_id"])
        .groupBy("conv_id", "call_id")
        .agg(F.count("*").alias("_tc_answers"), F.min("result").alias("result"))
    )
    order = depths(unique).withColumn("_tc_late", F.coalesce("depth", F.lit(1 << 62)))
    placed = ranked(order.join(unique.select("conv_id", "call_id", "turn"), ["conv_id", "call_id"]), ["conv_id"], ["_tc_late", "turn", "call_id"], "step")
    whole = unique.drop("parent_id", "turn").join(placed.drop("_tc_late"), ["conv_id", "call_id"]).join(answers, ["conv_id", "call_id"], "left")
    ready = whole.select("conv_id", "call_id", "name", "turn", F.col("step").cast("long"), "depth", F.col("_tc_answers").isNotNull().alias("answered"), "arguments", "result")
    kind = ready.schema["conv_id"].dataType.simpleString()
    checked = ready.mapInArrow(
        _messages({k: dict(v) for k, v in schemas.items()}),
        f"conv_id {kind}, call_id string, name string, turn long, step long, depth long, answered boolean, message string, errors array<string>",
    )
    status = (
        F.when(F.col("depth").isNull(), "cycle").when(F.size("errors") > 0, "invalid").when(~F.col("answered"), "pending").otherwise("done")
    )
    return checked.select("conv_id", "call_id", "name", "turn", "step", "depth", status.alias("status"), "errors", "message")
