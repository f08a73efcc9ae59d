"""Chat formatting: tool calls linked to their results, ordered by what they depend on, validated and serialised."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topolidar.llm import shared

_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}
#: Rows of Python objects that a worker holds at once.
PIECE = 1024


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, int if kind == "integer" else (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES.get(kind, object))


def faults(value, schema: dict, at: str = "$") -> list[str]:
    """Where ``value`` breaks ``schema``: type (one or a list of them), enum, required, properties, additionalProperties,
    items, minimum, maximum, minLength and maxLength of JSON Schema; other keywords and unknown types are ignored."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    if kinds and not any(_is(value, kind) for kind in kinds):
        return [f"{at}: not of type {' or '.join(kinds)}"]
    out = [f"{at}: not in enum"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += faults(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: not allowed")
    elif isinstance(value, list):
        out += [x for i, v in enumerate(value) for x in faults(v, schema.get("items", {}), f"{at}[{i}]")]
    elif isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            out.append(f"{at}: wrong length")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if not schema.get("minimum", value) <= value <= schema.get("maximum", value):
            out.append(f"{at}: out of range")
    return out


def canonical(value) -> str:
    """JSON with sorted keys and without spaces; characters as they are. What JSON in UTF-8 can't say raises ValueError:
    numbers that aren't finite, and halves of surrogate pairs."""
    out = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    out.encode()
    return out


def _no_number(text: str):
    raise ValueError(f"{text} is no JSON")


def read_arguments(text: str | None, schema: dict | None) -> tuple[object, list[str]]:
    """(arguments, faults). Arguments that are no JSON, hold what canonical JSON can't, or are nested too deep for the reader
    stay the text that they are. Of equal keys the last counts."""
    if text is None:
        return None, ["$: missing"]
    try:
        value = json.loads(text, parse_constant=_no_number)
        canonical(value)
        return value, faults(value, schema) if schema is not None else ["$: no schema"]
    except ValueError:
        return text, ["$: no JSON"]
    except RecursionError:
        return text, ["$: nested too deep"]


def _chains(nodes: DataFrame) -> DataFrame:
    """Of ``nodes`` (call_id, n, needed: one of its n needs) those with one need, as (call_id, next, dist): the first call
    down the chain that has no need or several, and how far it is. Chains that end in an unknown call or run in a circle
    are left out. By pointer doubling: rounds grow with the logarithm of the longest chain, each is one join."""
    ends = nodes.select(F.col("call_id").alias("next"), (F.col("n") != 1).alias("end"))
    table = nodes.where("n = 1").select("call_id", F.col("needed").alias("next"), F.lit(1).cast("long").alias("dist")).join(ends, "next")
    table = shared.written(table.select("call_id", "next", "dist", "end"), "chains")
    rows, reach = table.count(), 1
    while reach <= rows and not table.where("not end").isEmpty():
        ahead = table.select(F.col("call_id").alias("next"), F.col("next").alias("_next"), F.col("dist").alias("_dist"), F.col("end").alias("_end"))
        moved = table.where("not end").join(ahead, "next").select("call_id", F.col("_next").alias("next"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_end").alias("end"))
        following = shared.written(table.where("end").union(moved), "chains")
        shared.drop(table.sparkSession, table)
        table, reach = following, 2 * reach
    return table.where("end").drop("end")


def depths(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(call_id, depth) for the calls that can be ordered: 0 for one that needs none, else one more than the deepest it
    needs. Calls in a cycle, after one, or that need an unknown call are left out.

    Calls with one need form chains, which are contracted first. Only calls of several needs then go through rounds, in
    which a call is settled once all of its needs are: as many rounds as such calls follow each other, each of two joins.
    """
    calls = calls.select("call_id").where("call_id is not null").distinct()
    needs = shared.written(needs.select("call_id", "needed").where("needed is not null").distinct().join(calls, "call_id", "left_semi"), "needs")
    some = needs.groupBy("call_id").agg(F.count(F.lit(1)).alias("n"), F.min("needed").alias("needed"))
    nodes = shared.written(calls.join(some, "call_id", "left").select("call_id", F.coalesce("n", F.lit(0)).alias("n"), "needed"), "nodes")
    chains = _chains(nodes)
    zero = F.lit(0).cast("long")
    settled = nodes.where("n = 0").select("call_id", zero.alias("depth"))
    joints = nodes.where("n > 1").select("call_id", "n")
    if not joints.isEmpty():
        # What a joint needs, as a call without need or another joint, and how far that is.
        ways = chains.select(F.col("call_id").alias("needed"), "next", "dist").union(nodes.where("n <> 1").select("call_id", "call_id", zero))
        links = shared.written(needs.join(joints, "call_id", "left_semi").join(ways, "needed").select("call_id", "next", (F.col("dist") + 1).alias("far")), "links")
        state = shared.written(joints.select("call_id", F.col("n").alias("open"), zero.alias("depth")), "joints")
        fresh = settled
        while True:
            hits = links.join(fresh.withColumnRenamed("call_id", "next"), "next").groupBy("call_id").agg(F.count(F.lit(1)).alias("met"), F.max(F.col("far") + F.col("depth")).alias("most"))
            # A joint is open down to 0 in the round that settles it, and -1 from the next one on.
            less = F.when(F.col("open") > 0, F.col("open") - F.coalesce("met", F.lit(0))).otherwise(-1)
            following = shared.written(state.join(hits, "call_id", "left").select("call_id", less.alias("open"), F.greatest("depth", F.coalesce("most", zero)).alias("depth")), "joints")
            shared.drop(state.sparkSession, state)
            state = following
            fresh = state.where("open = 0").select("call_id", "depth")
            if fresh.isEmpty():
                break
        settled = settled.union(state.where("open = -1").select("call_id", "depth"))
    rest = chains.join(settled.withColumnRenamed("call_id", "next"), "next").select("call_id", F.col("depth") + F.col("dist"))
    return settled.union(rest).select("call_id", F.col("depth").cast("int").alias("depth"))


def link_calls(calls: DataFrame, results: DataFrame, needs: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row for each call: group_id, call_id, name, depth, linked, valid, faults and the canonical JSON of call and result.

    ``calls`` (group_id, call_id, name, arguments as JSON), ``results`` (call_id, content), ``needs`` (call_id, needed).
    Repeated calls of an id count once, the one of the smallest group, name and arguments; of repeated results the smallest
    content. A null id links to nothing and such calls are left out. Without a result ``linked`` is false and the JSON has
    null; arguments that are null, no JSON (see read_arguments), or of a name without a schema are not valid. depth is null
    for what can't be ordered. Empty tables give no rows or no links; further columns are not read.
    """
    calls = calls.where("call_id is not null").groupBy("call_id").agg(F.min(F.struct("group_id", "name", "arguments")).alias("c")).select("call_id", "c.*")
    answers = results.where("call_id is not null").groupBy("call_id").agg(F.min("content").alias("content"), F.lit(True).alias("linked"))
    calls = shared.written(calls, "calls")
    joined = calls.join(answers, "call_id", "left").join(depths(calls, needs), "call_id", "left")
    kind = pa.list_(pa.string())

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at in range(0, batch.num_rows, PIECE):
                part = batch.slice(at, PIECE)
                said, broken = [], []
                for r in part.to_pylist():
                    arguments, wrong = read_arguments(r["arguments"], schemas.get(r["name"]))
                    broken.append(wrong)
                    said.append(canonical({"arguments": arguments, "depth": r["depth"], "id": r["call_id"], "name": r["name"], "result": r["content"]}))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("group_id", "call_id", "name", "depth", "linked")), pa.array([not w for w in broken]), pa.array(broken, kind), pa.array(said, pa.string())], names=names)

    names = ["group_id", "call_id", "name", "depth", "linked", "valid", "faults", "json"]
    ready = joined.select(F.col("group_id").cast("long").alias("group_id"), F.col("call_id").cast("string").alias("call_id"), F.col("name").cast("string").alias("name"), F.col("arguments").cast("string").alias("arguments"), F.col("content").cast("string").alias("content"), "depth", F.coalesce("linked", F.lit(False)).alias("linked"))
    return ready.mapInArrow(run, "group_id long, call_id string, name string, depth int, linked boolean, valid boolean, faults array<string>, json string")
