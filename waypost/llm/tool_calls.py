"""Linking tool calls and their results in conversations.

A message is a row (conv_id, turn, role, text). A text that is a JSON object
may carry ``content``, ``tool_calls`` (a list of ``id``, ``name``, and
``arguments`` as an object or as its text; a ``function`` object may hold the
latter two) and, in messages of the role ``tool``, ``tool_call_id``. Any other
text is plain content.

Every message gives an event, and so does every call. Results meet their calls
by a hash join on (conversation, identifier); calls are reduced to the first
one of each identifier before, so a repeated identifier multiplies nothing.
The order keys (order_turn, order_kind, order_index) are a topological order:
within a turn the message, then its calls, then results; a result that is
recorded before its call moves to the call's turn. They are keys and not
ranks, so no conversation, however long, is gathered in one task. Each event
is serialised as JSON with sorted keys and no spaces. All of it is DataFrame
functions.

Arguments are checked against the tool's schema: types at every depth, required
and undeclared keys, types of array items, and enumerated values. A parsed
value tells its whole type as one text with sorted keys, so a schema is
compiled to a pattern of such texts; enumerations are looked up by their path.
Of objects in an array the parser tells the type they have in common, so their
required keys are those of the array as a whole, and enumerations in them
aren't supported.

Edge cases: null texts have the content null; text that isn't valid JSON is
plain content; calls without identifier, later calls of the same identifier,
and results without a call are kept with linked = false. Arguments that aren't
an object are invalid, and so are calls of unknown tools. Repeated rows are
repeated events. Rows without conv_id link to nothing. A tool without schema
columns of its own takes no arguments.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MESSAGE = "struct<content: string, tool_call_id: string, tool_calls: array<struct<id: string, name: string, arguments: string, function: struct<name: string, arguments: string>>>>"
#: JSON types of a schema, as the types that a parsed value reports.
_TYPES = {
    "integer": "BIGINT", "number": r"(?:BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))", "string": "STRING",
    "boolean": "BOOLEAN", "null": "VOID"
}


def pattern(schema: dict) -> str:
    """A pattern of the types that values of ``schema`` report; undeclared keys of objects don't fit."""
    kind = schema["type"]
    if kind == "array":
        return rf"ARRAY<(?:VOID|{pattern(schema['items'])})>"
    if kind != "object":
        return _TYPES[kind]
    required = schema.get("required", ())
    keys = "".join(
        rf"(?:`?{re.escape(k)}`?: {pattern(v)}(?:, |(?=>))){'' if k in required else '?'}" for k,
        v in sorted(schema.get("properties", {}).items())
    )
    return f"OBJECT<{keys}>"


def enumerations(schema: dict, path: str = "$") -> list[tuple[str, list[str]]]:
    """(path, allowed values as text) of the enumerations outside of arrays."""
    found = [(path, [str(x) for x in schema["enum"]])] if "enum" in schema else []
    for k, v in schema.get("properties", {}).items():
        found += enumerations(v, f"{path}['{k}']")
    return found


def tool_schemas(spark: SparkSession, tools: dict[str, dict]) -> DataFrame:
    """A table (tool, shape, enums) of the JSON schemas of the tools' arguments."""
    rows = []
    for name, schema in sorted(tools.items()):
        enums = [
            F.struct(F.lit(path).alias("path"), F.array(*map(F.lit, allowed)).alias("allowed")) for path,
            allowed in enumerations(schema)
        ]
        rows.append(
            F.struct(
                F.lit(name).alias("tool"), F.lit(f"^{pattern(schema)}$").alias("shape"),
                (F.array(*enums) if enums else F.array()).cast(
                    "array<struct<path: string, allowed: array<string>>>"
                ).alias("enums")
            )
        )
    listed = F.array(*rows) if rows else F.expr(
        "cast(array() as array<struct<tool: string, shape: string, enums: array<struct<path: string, allowed: array<string>>>>>)"
    )
    return spark.range(1).select(F.inline(listed))


def _object(*pairs: tuple[str, Column]) -> Column:
    """A JSON object of named, already serialised values; give the names in order."""
    parts: list[Column] = []
    for i, (name, value) in enumerate(pairs):
        parts += [F.lit(("," if i else "{") + f'"{name}":'), F.coalesce(value, F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def _text(value: Column) -> Column:
    """A string as JSON, by way of an array of one."""
    whole = F.to_json(F.array(value))
    return F.when(value.isNotNull(), F.substring(whole, F.lit(2), F.length(whole) - 2))


def _one_value(text: Column) -> Column:
    """Whether a text is one JSON value and nothing after it, which the parser alone would pass over."""
    return F.try_parse_json(text).isNotNull() & F.coalesce(
        F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.lit(False)
    )


def _fits(whole: Column, arguments: Column) -> Column:
    """Whether parsed arguments have the shape of their tool's schema and only enumerated values."""
    at = lambda e: F.call_function("get_json_object", arguments, e["path"])
    listed = F.forall("enums", lambda e: at(e).isNull() | F.array_contains(e["allowed"], at(e)))
    return F.regexp_like(F.schema_of_variant(whole), F.col("shape")) & listed


def _met(rows: DataFrame, first: DataFrame) -> DataFrame:
    """``rows`` with what is known of their call_id; those without one are spread by their text and meet nothing."""
    salt = F.when(F.col("call_id").isNull(), F.xxhash64("turn", "salt")).otherwise(F.lit(0))
    return rows.withColumn("salt", salt).join(
        first.withColumn("salt", F.lit(0).cast("long")), ["conv_id", "call_id", "salt"], "left"
    )


def events(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """Per message and call: conv_id, turn, kind, role, call_id, linked, valid, the order keys, json.

    ``schemas`` (tool, shape, enums) has a row a tool, as ``tool_schemas`` gives it.
    """
    text = F.col("text").cast("string")
    shaped = text.rlike(r"^\s*\{") & _one_value(text)
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), text.alias("text"),
        F.when(shaped, F.from_json(text, _MESSAGE)).alias("m")
    )
    one = rows.withColumn("call_id", F.when(F.col("role") == "tool", F.col("m.tool_call_id"))).withColumn(
        "content",
        F.when(
            F.col("m.content").isNotNull() | F.col("m.tool_calls").isNotNull() | F.col("m.tool_call_id").isNotNull(),
            F.col("m.content")
        ).otherwise(F.col("text"))
    )
    calls = rows.filter("m.tool_calls is not null").select(
        "conv_id", "turn", "role", F.posexplode("m.tool_calls").alias("index", "c")
    )
    calls = calls.select(
        "conv_id", "turn", "role", F.col("index").cast("long").alias("index"), F.col("c.id").alias("call_id"),
        F.coalesce("c.name", "c.function.name").alias("tool"),
        F.coalesce("c.arguments", "c.function.arguments").alias("arguments")
    )

    # the first call and the number of results of each identifier, reduced before any join
    first = calls.filter("call_id is not null").groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "index")).alias("f")
    )
    first = first.select(
        "conv_id", "call_id", F.col("f.turn").alias("first_turn"), F.col("f.index").alias("first_index")
    )
    answered = one.filter("call_id is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias("answers"))
    first = first.join(answered, ["conv_id", "call_id"], "left")

    said = _met(one.withColumn("salt", F.col("text")), first)
    moved = F.when(F.col("first_turn").isNotNull(), F.greatest("turn", "first_turn")).otherwise(F.col("turn"))
    result = F.col("call_id").isNotNull()
    said = said.select(
        "conv_id", "turn", F.when(result, "result").otherwise("message").alias("kind"), "role", "call_id",
        F.when(result, F.col("first_turn").isNotNull()).alias("linked"), F.lit(None).cast("boolean").alias("valid"),
        moved.alias("order_turn"), F.when(result, 2).otherwise(0).cast("int").alias("order_kind"), F.when(result, F.col("turn")).otherwise(F.lit(0)).alias("order_index"),
        F.when(result, _object(("content", _text(F.col("content"))), ("role", _text(F.col("role"))), ("tool_call_id", _text(F.col("call_id"))))).otherwise(_object(("content", _text(F.col("content"))), ("role", _text(F.col("role"))))).alias("json"),
    )

    whole = F.when(F.col("arguments").rlike(r"^\s*\{") & _one_value(F.col("arguments")), F.try_parse_json("arguments"))
    called = _met(  # a row a tool
        calls.withColumn("salt", F.col("arguments")), first
    ).join(F.broadcast(schemas), "tool", "left").withColumn("whole", whole)
    own = (F.col("turn") == F.col("first_turn")) & (F.col("index") == F.col("first_index"))
    called = called.select(
        "conv_id", "turn", F.lit("call").alias("kind"), "role", "call_id",
        F.coalesce(own & F.col("answers").isNotNull(), F.lit(False)).alias("linked"), F.coalesce(_fits(F.col("whole"), F.col("arguments")), F.lit(False)).alias("valid"),
        F.col("turn").alias("order_turn"), F.lit(1).alias("order_kind"), F.col("index").alias("order_index"),
        _object(("arguments", F.coalesce(F.to_json("whole"), _text(F.col("arguments")))), ("id", _text(F.col("call_id"))), ("name", _text(F.col("tool")))).alias("json"),
    )
    return said.unionByName(called)
