"""Nested schemas against cases worked out by hand, and what op5's messages hold."""

import json

from waypost.llm import oracles, tool_calls

NESTED = {
    "type": "object",
    "properties": {
        "at": {"type": "object", "properties": {"lat": {"type": "number"}, "lon": {"type": "number"}, "odd key": {"type": "string"}}, "required": ["lat", "lon"]},
        "unit": {"type": "string", "enum": ["km", "m"]},
        "tags": {"type": "array", "items": {"type": "string"}},
        "stops": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": "integer"}}}},
        "deep": {"type": "object", "properties": {"mode": {"type": "string", "enum": ["a"]}}},
        "none": {"type": "null"},
        "on": {"type": "boolean"},
    },
    "required": ["at"],
}
CASES = [
    ({"at": {"lat": 1, "lon": 2.5}}, True),
    ({"at": {"lon": 2.5, "lat": 1, "odd key": "x"}, "unit": "km", "tags": ["a"], "stops": [{"n": 1}, {"n": 2}], "deep": {"mode": "a"}, "none": None, "on": True}, True),
    ({"at": {"lat": 1, "lon": 2}, "tags": [], "stops": [], "deep": {}}, True),
    ({"at": {"lat": 1}}, False),
    ({"at": {"lat": "1", "lon": 2}}, False),
    ({"at": {"lat": 1, "lon": 2, "alt": 3}}, False),
    ({"at": [1, 2]}, False),
    ({"at": {"lat": 1, "lon": 2}, "unit": "miles"}, False),
    ({"at": {"lat": 1, "lon": 2}, "tags": ["a", 1]}, False),
    ({"at": {"lat": 1, "lon": 2}, "tags": "a"}, False),
    ({"at": {"lat": 1, "lon": 2}, "stops": [{"n": "x"}]}, False),
    ({"at": {"lat": 1, "lon": 2}, "deep": {"mode": "b"}}, False),
    ({"at": {"lat": 1, "lon": 2}, "none": 0}, False),
    ({"at": {"lat": 1, "lon": 2}, "on": 1}, False),
    ({"at": {"lat": 1, "lon": 2}, "other": 1}, False),
    ({}, False),
]


def test_nested_schemas(spark):
    rows = [
        (i, 0, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "go", "arguments": x}]})) for i,
        (x, _) in enumerate(CASES)
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = tool_calls.events(
        messages, tool_calls.tool_schemas(spark, {"go": NESTED, "wait": {"type": "object"}})
    ).filter("kind = 'call'")
    assert {r.conv_id: r.valid for r in got.collect()} == {i: want for i, (_, want) in enumerate(CASES)}
    assert tool_calls.events(messages, tool_calls.tool_schemas(spark, {})).filter("valid").count() == 0


def test_repeated_rows_long_texts_and_clashing_names(spark):
    call = json.dumps({"content": "x" * 3_000_000, "tool_calls": [{"id": "a", "name": "wait", "arguments": {}}]})
    rows = [(1, 0, "assistant", call)] * 2 + [
        (1, 1, "tool", '{"tool_call_id": "a"}')
    ] * 3 + [(None, None, "tool", None)] * 50
    messages = spark.createDataFrame(
        [(*r, "clash", 1, True) for r in rows],
        "conv_id long, turn long, role string, text string, json string, salt int, linked boolean"
    )
    got = tool_calls.events(
        messages, tool_calls.tool_schemas(spark, {"wait": {"type": "object"}})
    ).groupBy("kind", "linked", "valid").count()
    assert sorted((r.kind, r.linked, r.valid, r["count"]) for r in got.collect()) == [
        ("call", True, True, 2), ("message", None, None, 52), ("result", True, None, 3)
    ]


def test_the_query_meets_every_kind_of_call(duck):
    found = duck.execute(f"SELECT kind, linked, valid, count(*) FROM ({oracles.OP5}) GROUP BY ALL").fetchall()
    assert {(k, a, b) for k, a, b, n in found if n > 1} >= {
        ("call", True, True), ("call", True, False), ("call", False, True), ("call", False, False),
        ("result", True, None), ("result", False, None), ("message", None, None)
    }
    assert duck.execute(f"SELECT count(*) FROM ({oracles.OP5}) WHERE order_turn > turn").fetchone()[0] > 0
