"""Chat formatting: tool calls linked with their results.

Calls and results meet by conversation and identifier.  Of calls with one
identifier the first turn counts, likewise of results; the others are marked.
Arguments may name earlier calls as ``{"$ref": id}``.  The order is
topological: a message stands after the call it belongs to and after the calls
it names.  Nearly always turns give that order already; only messages that
name later turns, and what depends on them, are moved, in rounds that touch
nothing else.  Arguments are validated against the JSON schema of their tool
(type, required, properties, additionalProperties, items, enum, bounds of
numbers and lengths), and every message is written as canonical JSON: keys in
order, no spaces, text unescaped.

A conversation is never gathered: messages stay rows, with an order key of
(turn, depth, original turn), so a conversation that holds a third of all rows
is split like any other.

Defined results: rows without conversation or identifier cannot be linked and
are marked; a null or malformed argument text is an error of validation, and so
are numbers out of range, lone surrogates and nesting beyond 200 levels, whose
text is written as it came; a malformed schema is an error of every call; a tool without schema is accepted with the status "unknown_tool"; repeated rows
are marked as duplicates; messages in a circle of names are marked "cyclic";
empty tables give none; other columns are not read.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strainlens import session

CHECKED = T.StructType([T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("refs", T.ArrayType(T.StringType())), T.StructField("json", T.StringType())])

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


# deepest nesting of arguments that is checked
MAX_DEPTH = 200


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _finite(digits: str) -> float:
    value = float(digits)
    if value - value != 0:
        raise ValueError("number out of range")
    return value


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def parse(body: str):
    """The value of a JSON text; ValueError if there is none that canonical JSON can hold.

    Beyond the grammar that excludes numbers out of range (also integers of
    more digits than Python reads), nesting deeper than ``MAX_DEPTH`` and lone
    surrogates.
    """
    try:
        value = json.loads(body, parse_float=_finite, parse_constant=_no_constant)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    level, depth = [value], 0
    while level:
        depth += 1
        if depth > MAX_DEPTH:
            raise ValueError("nested too deeply")
        level = [y for x in level if isinstance(x, dict | list) for y in (x.values() if isinstance(x, dict) else x) if isinstance(y, dict | list)]
    canonical(value).encode()
    return value


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(value, int | float) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _TYPES.get(kind, object))


def _same(x, y) -> bool:
    """Equality of JSON values: numbers by value, but no number is true or false."""
    if isinstance(x, list) and isinstance(y, list):
        return len(x) == len(y) and all(map(_same, x, y))
    if isinstance(x, dict) and isinstance(y, dict):
        return set(x) == set(y) and all(_same(x[k], y[k]) for k in x)
    return isinstance(x, bool) == isinstance(y, bool) and x == y


def violations(value, schema, where: str = "$") -> list[str]:
    """Where and how a value breaks a schema; a reference stands for any value, and only ``false`` among the schemas that are no objects forbids."""
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []
    if not isinstance(schema, dict):
        return [f"{where}: forbidden"] if schema is False else []
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{where}: type"]
    out = [f"{where}: enum"] if "enum" in schema and not any(_same(value, x) for x in schema["enum"]) else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{where}.{k}: required" for k in schema.get("required", ()) if k not in value]
        if schema.get("additionalProperties", True) is False:
            out += [f"{where}.{k}: unexpected" for k in sorted(value) if k not in known]
        for k in sorted(set(known) & set(value)):
            out += violations(value[k], known[k], f"{where}.{k}")
    elif isinstance(value, list):
        for i, x in enumerate(value):
            out += violations(x, schema.get("items", {}), f"{where}[{i}]")
    for low, high, size in (("minimum", "maximum", value), ("minLength", "maxLength", len(value) if isinstance(value, str) else None)):
        if isinstance(size, int | float) and not isinstance(size, bool):
            out += [f"{where}: {low}"] * (low in schema and size < schema[low]) + [f"{where}: {high}"] * (high in schema and size > schema[high])
    return out


def references(value) -> list[str]:
    todo, out = [value], set()
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if set(x) == {"$ref"}:
                out.add(x["$ref"] if isinstance(x["$ref"], str) else canonical(x["$ref"]))
            todo.extend(x.values())
        elif isinstance(x, list):
            todo.extend(x)
    return sorted(out)


def _check(parts: Iterator[pa.RecordBatch], names: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for part in parts:
        rows = {n: part.column(n).to_pylist() for n in ("kind", "call_id", "name", "body", "schema")}
        found = {"errors": [], "refs": [], "json": []}
        for kind, call, name, body, rule in zip(*rows.values(), strict=True):
            errors, refs = [], []
            if kind == "call":
                try:
                    value = parse(body)
                    refs = references(value)
                except (ValueError, TypeError) as e:
                    value, errors = body, [f"$: {e}" if str(e) == "nested too deeply" else "$: not JSON"]
                else:
                    try:
                        errors = violations(value, parse(rule)) if rule is not None else []
                    except (ValueError, TypeError, AttributeError):
                        errors = ["schema: malformed"]
                message = {"type": "call", "id": call, "name": name, "arguments": value}
            else:
                message = {"type": kind, "content": body} | ({"id": call} if kind == "result" else {})
            found["errors"].append(errors)
            found["refs"].append(refs)
            found["json"].append(canonical(message))
        columns = [part.column(n) for n in names] + [pa.array(found[n], schema.field(n).type) for n in found]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def _settle(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """Order keys of the messages that turns alone would put before what they need.

    ``nodes``: node, turn; ``needs``: node, needed.  First the turn a message
    must wait for is carried forward along the needs of late messages only (one
    that needs a message waiting for its own turn is late too);
    then the depth among messages that wait for the same turn, layer by layer.
    Both loops end: turns only grow, and each layer takes at least one message
    or leaves the rest as a circle.
    """
    moved = nodes.select("node", F.col("turn").alias("wait")).where("false")
    late = needs.join(nodes, "node").join(nodes.select(F.col("node").alias("needed"), F.col("turn").alias("needed_turn")), "needed")
    front = session.cut_lineage(late.where("needed_turn >= turn").groupBy("node").agg(F.max("needed_turn").alias("wait")), "late")
    while not front.isEmpty():
        moved = session.cut_lineage(moved.unionByName(front).groupBy("node").agg(F.max("wait").alias("wait")), "moved")
        reach = needs.join(front.select(F.col("node").alias("needed"), "wait"), "needed").groupBy("node").agg(F.max("wait").alias("wait"))
        now = nodes.join(moved.withColumnRenamed("wait", "has"), "node", "left").select("node", F.coalesce("has", F.col("turn") - 1).alias("has"))
        front = session.cut_lineage(reach.join(now, "node").where("wait > has").select("node", "wait"), "late")
    # depth: messages that wait for one turn, each after those it needs among them
    left = moved
    inner = session.cut_lineage(needs.join(moved, "node").join(moved.select(F.col("node").alias("needed"), F.col("wait").alias("needed_wait")), "needed").where("wait = needed_wait").select("node", "needed"), "inner")
    done, depth = moved.select("node", "wait", F.lit(0).alias("depth")).where("false"), 0
    while not left.isEmpty():
        depth += 1
        ready = session.cut_lineage(left.join(inner.select("node").distinct(), "node", "left_anti").select("node", "wait", F.lit(depth).alias("depth")), "ready")
        if ready.isEmpty():
            return done.withColumn("cyclic", F.lit(False)).unionByName(left.select("node", "wait", F.lit(depth).alias("depth"), F.lit(True).alias("cyclic")))
        done = done.unionByName(ready)
        left = session.cut_lineage(left.join(ready.select("node"), "node", "left_anti"), "left")
        inner = session.cut_lineage(inner.join(ready.select(F.col("node").alias("needed")), "needed", "left_anti").select("node", "needed"), "inner")
    return done.withColumn("cyclic", F.lit(False))


def format_calls(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """Linked, ordered, validated messages as canonical JSON.

    ``messages``: conv_id long, turn long, kind ("call", "result" or another
    word), call_id, name, body strings; ``schemas``: name, schema.  Returns
    conv_id, turn, kind, call_id, order_turn, order_depth, status, errors, json.
    """
    rules = schemas.where("name IS NOT NULL").groupBy("name").agg(F.min("schema").alias("schema"))
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "kind", "call_id", "name", "body").withColumn("node", F.monotonically_increasing_id())
    given = rows.join(rules, "name", "left").select("node", "conv_id", "turn", "kind", "call_id", "name", "body", "schema", F.col("schema").isNull().alias("no_schema"))
    names = [c for c in given.columns if c not in ("body", "schema")]
    out = T.StructType([given.schema[c] for c in names] + CHECKED.fields)
    arrow = to_arrow_schema(out)
    checked = session.cut_lineage(given.mapInArrow(lambda parts: _check(parts, names, arrow), out), "messages")

    slim = checked.where("call_id IS NOT NULL AND conv_id IS NOT NULL AND kind IN ('call', 'result')").select("node", "conv_id", "call_id", "kind", "turn")
    # the first message of each kind with an identifier, by aggregation
    first = slim.groupBy("conv_id", "call_id").agg(
        F.min(F.when(F.col("kind") == "call", F.struct("turn", "node"))).alias("c"), F.min(F.when(F.col("kind") == "result", F.struct("turn", "node"))).alias("r"))
    first = session.cut_lineage(first.select("conv_id", "call_id", F.col("c.node").alias("call_node"), F.col("r.node").alias("result_node")), "first")
    refs = checked.where("kind = 'call'").select("node", "conv_id", F.explode("refs").alias("call_id"))
    needs = first.where("call_node IS NOT NULL AND result_node IS NOT NULL").select(F.col("result_node").alias("node"), F.col("call_node").alias("needed"))
    named = refs.join(first, ["conv_id", "call_id"]).select("node", F.coalesce("result_node", "call_node").alias("needed")).where("needed IS NOT NULL")
    needs = session.cut_lineage(needs.unionByName(named).distinct(), "needs")
    moved = _settle(checked.select("node", F.coalesce("turn", F.lit(0)).alias("turn")), needs)

    lost = refs.join(first.where("call_node IS NOT NULL"), ["conv_id", "call_id"], "left_anti").select("node").distinct().withColumn("lost", F.lit(True))
    linked = checked.join(first, ["conv_id", "call_id"], "left").join(moved, "node", "left").join(lost, "node", "left")
    status = (
        F.when(~F.col("kind").isin("call", "result"), "message")
        .when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "unlinkable")
        .when(F.coalesce("cyclic", F.lit(False)), "cyclic")
        .when(F.col("node") != F.when(F.col("kind") == "call", F.col("call_node")).otherwise(F.col("result_node")), "duplicate")
        .when((F.col("kind") == "result") & F.col("call_node").isNull(), "orphan")
        .when((F.col("kind") == "call") & (F.size("errors") > 0), "invalid")
        .when(F.coalesce("lost", F.lit(False)), "unknown_reference")
        .when((F.col("kind") == "call") & F.col("result_node").isNull(), "unanswered")
        .when((F.col("kind") == "call") & F.col("no_schema"), "unknown_tool")
        .otherwise("linked")
    )
    return linked.select(
        "conv_id", "turn", "kind", "call_id", F.coalesce("wait", "turn").alias("order_turn"), F.coalesce("depth", F.lit(0)).alias("order_depth"), status.alias("status"), "errors", "json")
