import json
import re

import pytest
from pyspark.sql import functions as F

from assetlytics.llm import toolcalls as T

TOOLS = {"add": {"properties": {"a": {"type": "number"}, "b": {"type": "integer"}, "o": {"type": "object"}}, "required": ["a"]}, "none": {}}


def run(spark, calls, results=()):
    c, r = spark.createDataFrame(list(calls), T.CALLS), spark.createDataFrame(list(results), T.RESULTS)
    return {(x.conv_id, x.call_id): x for x in T.link_calls(c, r, TOOLS).collect()}


def test_links_levels_and_json(spark):
    calls = [(1, 0, "a", "add", '{"b": 2, "a": 1.50, "o": {"z": [1, 2], "k": "é"}}', None), (1, 1, "b", "add", '{"a": 1}', ["a"]),
             (1, 1, "c", "none", "{}", ["a", "nowhere"]), (1, 2, "d", "add", '{"a":2}', ["b", "c"]), (1, 5, "e", "add", '{"a":2}', ["d", "a"]),
             (2, 0, "a", "add", '{"a":2}', None), (2, 1, "x", "none", "{}", ["y"]), (2, 2, "y", "none", "{}", ["x"]), (2, 3, "w", "none", "{}", ["y", "a"]), (2, 4, "v", "none", "{}", ["w"])]
    got = run(spark, calls, [(1, 3, "a", '{"y": 1, "x": null}'), (1, 0, "b", "3"), (9, 0, "a", '"lost"'), (1, 4, "a", '"later"'), (1, 9, "d", "not json")])
    assert {k[1]: v.level for k, v in got.items() if k[0] == 1} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}
    assert {k[1]: v.status for k, v in got.items() if k[0] == 1} == {"a": "linked", "b": "early_result", "c": "no_result", "d": "linked", "e": "no_result"}
    assert {k[1]: v.status for k, v in got.items() if k[0] == 2} == {"a": "no_result", "x": "cyclic", "y": "cyclic", "w": "cyclic", "v": "cyclic"}
    assert got[9, "a"].status == "orphan_result"
    a = got[1, "a"].json
    assert a == '{"arguments":{"a":1.5,"b":2,"o":{"k":"é","z":[1,2]}},"depends_on":[],"id":"a","name":"add","result":{"x":null,"y":1}}'
    assert json.loads(got[1, "d"].json) == {"arguments": {"a": 2}, "depends_on": ["b", "c"], "id": "d", "name": "add", "result": None}


@pytest.mark.parametrize("n", [1, 2, 37, 300])
def test_long_chains_and_diamonds(spark, n):
    chain = [(1, i, f"c{i}", "none", "{}", [f"c{i - 1}"] if i else None) for i in range(n)]
    fan = [(2, i, f"c{i}", "none", "{}", [f"c{i - 1}", f"c{i - 2}"]) for i in range(min(n, 37))]
    got = run(spark, chain + fan)
    assert all(got[1, f"c{i}"].level == i for i in range(n)) and all(got[2, f"c{i}"].level == i for i in range(min(n, 37)))


def test_long_runs_of_two_dependencies(spark):
    m = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(300)], "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.level, r.status) for r in T.format_conversations(m).collect()}
    assert got == {i: (i, "no_result") for i in range(300)}


def test_shortcuts_around_cycles(spark):
    edges = [("k", "a"), ("k", "b"), ("k", "c"), ("a", "b"), ("b", "c"), ("c", "a"), ("s", "s"), ("s", "z"), ("t", "s"), ("t", "z"),
             ("d", "y"), ("d", "z"), ("y", "z"), ("e", "d"), ("e", "y"), ("e", "z")]
    nodes = spark.createDataFrame([(x,) for x in "kabcstdeyz"], "k string")
    got = {r.k: r.level for r in T.levels(nodes, spark.createDataFrame(edges, "k string, dep string")).collect()}
    assert got == {**dict.fromkeys("kabcst"), "z": 0, "y": 1, "d": 2, "e": 3}


def test_argument_errors(spark):
    args = {"ok": '{"a":1,"b":2}', "miss": "{}", "type": '{"a":"1","b":1.5,"o":[]}', "more": '{"a":1,"z":0,"y":0}', "bad": "{", "null": None, "list": "[1]", "nul": '{"a":null}'}
    got = run(spark, [(1, 0, k, "add", v, None) for k, v in args.items()] + [(1, 0, "tool", "gone", "{}", None), (1, 0, "anon", None, "{}", None)])
    assert {k[1]: v.errors for k, v in got.items()} == {
        "ok": [], "miss": ["missing:a"], "type": ["type:a", "type:b", "type:o"], "more": ["unknown:y", "unknown:z"], "bad": ["malformed"], "null": ["malformed"],
        "list": ["malformed"], "nul": ["type:a"], "tool": ["unknown_tool"], "anon": ["unknown_tool"]}


def test_schemas(spark):
    """Types by value, lists of types, enumerations, bounds and open schemas; numbers beyond doubles are malformed results."""
    tool = {"f": {"properties": {"i": {"type": "integer", "minimum": 0, "maximum": 1e30}, "s": {"type": ["string", "null"]}, "any": {}, "e": {"enum": ["a", 2.0, None]}},
                  "additionalProperties": True}}
    args = {"whole": '{"i":1.0}', "big": '{"i":9223372036854775808}', "digits": '{"i":12345678901234567890123456789012345678901234}', "exp": '{"i":1E5}', "part": '{"i":1.5}',
            "low": '{"i":-1}', "none": '{"s":null}', "num": '{"s":1}', "more": '{"x":1,"any":[{}]}', "enum": '{"e":2}', "other": '{"e":"b"}', "text": '{"i":"-1"}'}
    c = spark.createDataFrame([(1, 0, k, "f", v, None) for k, v in args.items()], T.CALLS)
    r = spark.createDataFrame([(1, 1, "whole", "1e400"), (1, 1, "big", '"Infinity"')], T.RESULTS)
    got = {x.call_id: x for x in T.link_calls(c, r, tool).collect()}
    assert {k: x.errors for k, x in got.items()} == {
        "whole": [], "big": [], "digits": ["maximum:i"], "exp": [], "part": ["type:i"], "low": ["minimum:i"], "none": [], "num": ["type:s"], "more": [], "enum": [],
        "other": ["enum:e"], "text": ["type:i"]}
    assert json.loads(got["whole"].json)["result"] is None and json.loads(got["big"].json)["result"] == "Infinity"


def test_white_space_before_tool_messages(spark):
    rows = [(1, 1, "assistant", '\n\t {"tool_calls":[{"id":"k","name":"add","arguments":{"a":2}}]}'), (1, 2, "tool", ' \r\n{"tool_call_id":"k","content":1}')]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.call_id: r for r in T.format_conversations(m, TOOLS).collect()}
    assert got["k"].status == "linked" and got["k"].errors == []


def test_tool_messages(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", '{"tool_calls":[{"id":"k","name":"add","arguments":{"b":1,"a":2}},{"id":"l","name":"add","arguments":{"a":1},"depends_on":["k"]}]}'),
            (1, 2, "tool", '{"tool_call_id":"k","content":{"z":1,"a":2}}'), (1, 3, "assistant", "{ no json"), (1, 4, "tool", None)]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.call_id): r for r in T.format_conversations(m, TOOLS).collect()}
    assert got[1, "k"].status == "linked" and got[1, "k"].errors == [] and got[1, "l"].level == 1
    assert json.loads(got[1, "k"].json)["result"] == {"z": 1, "a": 2}


def test_edge_rows(spark):
    rows = [(1, 0, "user", "same"), (1, 0, "user", "same"), (1, 1, "assistant", None), (2, 0, "user", None), (None, 0, "user", "x"), (3, None, "user", "x"),
            (4, 0, None, "x"), (5, 0, "user", 'q"\\\n\t' + "w " * 100_000), (6, 0, "assistant", "alone")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(1)).withColumn("level", F.lit("x")).withColumn("name", F.lit("x"))
    got = {r.conv_id: r for r in T.format_conversations(m).collect()}
    assert sorted(got) == [1, 2, 5, 6] and got[1].status == "linked" and got[2].errors == ["type:text"] and got[6].status == "orphan_result"
    assert json.loads(got[5].json)["arguments"]["text"] == rows[7][3]
    assert T.format_conversations(m.where("false")).count() == 0


def test_native(spark):
    m = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", T.format_conversations(m)._jdf.queryExecution().executedPlan().toString())
