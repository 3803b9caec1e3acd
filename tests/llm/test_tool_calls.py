from __future__ import annotations

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import tool_calls as T

EVENTS = "conv_id long, turn long, kind string, call_id string, after array<string>"


def placed(spark, rows):
    found = T.link(spark.createDataFrame(rows, EVENTS)).collect()
    return {(r["conv_id"], r["turn"], r["kind"]): (r["status"], r["level"], r["place"]) for r in found}


def test_links_orders_and_odd_cases(spark):
    rows = [
        (1, 0, "message", None, []),
        (1, 1, "call", "a", []), (1, 5, "result", "a", []),
        (1, 2, "call", "b", ["a"]), (1, 3, "call", "c", ["a", "b", "none"]),
        (1, 6, "result", "a", []), (1, 7, "result", "lost", []), (1, 8, "result", None, []),
        (2, 0, "call", "x", ["y"]), (2, 1, "call", "y", ["x"]), (2, 2, "call", "z", ["y"]), (2, 3, "call", "s", ["s"]),
        (None, 0, "call", "a", []), (None, None, "result", "a", None),
        (3, 0, "call", "d", []), (3, 1, "call", "d", []),
    ]
    got = placed(spark, rows)
    assert got[1, 1, "call"] == ("linked", 0, 1)
    assert got[1, 2, "call"] == ("unanswered", 2, 6)  # after the message, a, the orphans and a's results
    assert got[1, 5, "result"][:2] == ("linked", 1)
    assert got[1, 6, "result"][:2] == ("extra", 1)
    assert got[1, 3, "call"][:2] == ("unanswered", 3)
    assert got[1, 7, "result"][0] == got[1, 8, "result"][0] == "orphan"
    assert got[2, 0, "call"][1] is got[2, 1, "call"][1] is got[2, 2, "call"][1] is got[2, 3, "call"][1] is None
    assert got[None, 0, "call"][:2] == ("linked", 0) and got[None, None, "result"][:2] == ("linked", 1)
    assert got[3, 0, "call"][0] == "ambiguous"
    for conv in (1, 2, 3):
        assert sorted(v[2] for k, v in got.items() if k[0] == conv) == list(range(sum(k[0] == conv for k in got)))


def test_levels_against_longest_paths(spark):
    import random

    rng = random.Random(5)
    n = 60
    depends = {i: sorted(rng.sample(range(i), min(i, rng.choice([0, 1, 1, 1, 2, 3])))) for i in range(n)}
    weight = {i: rng.choice([1, 2]) for i in range(n)}
    want = {}
    for i in range(n):
        want[i] = max((want[j] + weight[j] for j in depends[i]), default=0)
    calls = spark.createDataFrame([(f"k{i}", weight[i]) for i in range(n)], "key string, weight int")
    edges = spark.createDataFrame([(f"k{i}", f"k{j}") for i in range(n) for j in depends[i]], "key string, on string")
    assert {r["key"]: r["level"] for r in T.levels(calls, edges).collect()} == {f"k{i}": want[i] for i in range(n)}


def test_long_chain_takes_few_rounds(spark):
    n = 300
    rows = [(1, i, "call", f"c{i}", [f"c{i - 1}"] if i else []) for i in range(n)]
    got = placed(spark, rows)
    assert [got[1, i, "call"][1] for i in range(n)] == list(range(n))


def test_turns_and_formats(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "user", "hi\né\u0001"), (1, 2, "assistant", None), (1, 3, "user", ""), (1, 4, "user", "x" * 5000), (None, None, None, None), (2, 2000, "user", "q"), (2, 0, "user", "p"), (2, 5000, "assistant", "late")]
    wide = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit(1)).withColumn("body", F.lit(2))
    got = {(r["conv_id"], r["turn"]): r for r in T.format_events(T.turns_as_events(wide)).collect()}
    assert got[1, 1]["json"] == '{"arguments":{"text":"hi\\né\\u0001","turn":1},"id":"call-1","name":"ask","type":"call"}'
    assert got[1, 2]["json"] == '{"content":null,"id":"call-1","type":"result"}'
    assert got[1, 3]["errors"] == "/text: shorter than 1" and got[1, 4]["errors"] == "/text: longer than 300" and got[1, 1]["errors"] == ""
    assert got[2, 5000]["call_id"] == "call-2000" and got[2, 2000]["after"] == ["call-0"]
    assert got[None, None]["kind"] == "message"


def test_same_rows_and_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert T.link(T.format_events(T.turns_as_events(empty)).drop("json", "body", "name", "role")).count() == 0
    twice = spark.createDataFrame([(1, 0, "user", "a")] * 2 + [(1, 1, "assistant", "b")] * 2, empty.schema)
    got = T.link(T.format_events(T.turns_as_events(twice)).drop("json", "body", "name", "role")).collect()
    assert sorted((r["place"], r["status"]) for r in got) == [(0, "ambiguous"), (1, "ambiguous"), (2, "linked"), (3, "linked")]


def test_schema_faults():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": ["integer", "null"], "minimum": 1, "maximum": 3}, "b": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"enum": [1, "x"]}}, "c": {"type": "boolean"}}, "additionalProperties": False}
    assert list(T.faults({"a": 2, "b": [1, "x"], "c": True}, schema)) == []
    assert list(T.faults({"b": [], "c": 1, "d": 0}, schema)) == ["/a: missing", "/b: shorter than 1", "/c: not of type boolean", "/d: not allowed"]
    assert list(T.faults({"a": True}, schema)) == ["/a: not of type integer or null"]
    assert list(T.faults({"a": 9, "b": [1, 2, 3]}, schema)) == ["/a: above 3", "/b: longer than 2", "/b/1: not one of the listed values", "/b/2: not one of the listed values"]
    for bad in ('{"a":1,"a":2}', "[1", "NaN", None, ""):
        assert T.formatted("call", None, "i", "ask", bad, T.SCHEMAS)[1] == ["/: not JSON"]
    assert T.formatted("call", None, "i", "ask", '{"text":"\\ud800","turn":1}', T.SCHEMAS) == ('{"arguments":{"text":"\\ud800","turn":1},"id":"i","name":"ask","type":"call"}', [])
    assert T.formatted("call", None, "i", "other", "{}", T.SCHEMAS)[1] == ["other: unknown tool"]


@settings(max_examples=50, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=10))
def test_canonical_round_trip(value):
    text = T.canonical(value)
    assert json.loads(text) == value and T.canonical(json.loads(text)) == text
