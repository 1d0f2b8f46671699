"""Chat formatting: tool calls linked to their results, in topological order,
with validated arguments and canonical JSON. DataFrame functions only.

Identifiers are of a conversation. A call row has conv_id, turn, call_id, name,
arguments (JSON text) and depends_on (array of call ids); a result row conv_id,
turn, call_id and content (JSON text).
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_table

CALLS = "conv_id bigint, turn bigint, call_id string, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id bigint, turn bigint, call_id string, content string"
_STRINGS = "array<string>"
_ARGS = "array<struct<arg:string,types:array<string>,required:boolean,enum:array<string>,minimum:double,maximum:double>>"


def _json(**fields) -> F.Column:
    """Canonical JSON of an object: keys in code-point order, no white space, nulls kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def canonical(json_text) -> F.Column:
    """JSON text with sorted keys, no white space and plain numbers; malformed,
    or with a number beyond doubles: null. Numbers of more than 38 digits are
    those of doubles."""
    text = F.to_json(F.try_parse_json(json_text))
    return F.when(~(F.contains(text, F.lit('Infinity"')) & ~F.contains(json_text, F.lit("Infinity"))), text)


def tool_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of messages (conv_id, turn, role, text) whose text is
    JSON: an assistant's {"tool_calls": [{"id", "name", "arguments",
    "depends_on"}]} and a tool's {"tool_call_id", "content"}."""
    m = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    shape = "struct<tool_calls:array<struct<id:string,name:string,arguments:variant,depends_on:array<string>>>>"
    calls = (m.where(F.col("role") == "assistant").where(F.regexp_replace(F.col("text"), r"^\s+", "").startswith("{"))
             .select("conv_id", "turn", F.explode(F.from_json("text", shape)["tool_calls"]).alias("c"))
             .select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"),
                     F.to_json("c.arguments").alias("arguments"), F.col("c.depends_on").alias("depends_on")))
    parsed = F.from_json("text", "struct<tool_call_id:string,content:variant>")
    results = (m.where(F.col("role") == "tool").where(F.regexp_replace(F.col("text"), r"^\s+", "").startswith("{")).withColumn("r", parsed)
               .select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.to_json("r.content").alias("content")))
    return calls.where("call_id IS NOT NULL"), results.where("call_id IS NOT NULL")


def turn_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain turns as calls and results: a user's turn calls the tool ``reply``
    and a system's turn ``set_system``; an assistant's turn is the result of
    the call in the turn before it. A call waits for the calls of the one and
    of the two turns before it, as far as there are any."""
    m = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    def of(turn):
        return F.concat(F.lit("turn-"), turn.cast("string"))
    calls = m.where(F.col("role").isin("user", "system")).select(
        "conv_id", "turn", of(F.col("turn")).alias("call_id"), F.when(F.col("role") == "user", "reply").otherwise("set_system").alias("name"),
        _json(text=F.col("text"), turn=F.col("turn")).alias("arguments"),
        F.array(of(F.col("turn") - 1), of(F.col("turn") - 2)).alias("depends_on"))
    results = m.where(F.col("role") == "assistant").select(
        "conv_id", "turn", of(F.col("turn") - 1).alias("call_id"), _json(text=F.col("text")).alias("content"))
    return calls, results


def _without_shortcuts(edges: DataFrame) -> DataFrame:
    """Edges (k, dep) less those that a longer way replaces: k -> d goes if k
    also depends on a later d' that depends on d. The longest chains stay. The
    last dependency of a call in the order used, and of those behind a cycle
    the last, always stays, so what is on or behind a cycle still is."""
    several = edges.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k")
    via = edges.join(several, "k", "left_semi").select(F.col("k").alias("via_k"), F.col("dep").alias("via"))
    nexts = edges.select(F.col("k").alias("via"), F.col("dep").alias("via_dep"))
    later = F.struct(F.length("via"), F.col("via")) > F.struct(F.length("via_dep"), F.col("via_dep"))
    gone = via.join(nexts, "via").where(later).select("via_k", "via_dep")
    return edges.join(gone, (F.col("k") == F.col("via_k")) & (F.col("dep") == F.col("via_dep")), "left_anti")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (k), edges (k, dep), both distinct and dep among the nodes -> (k,
    level): the longest chain of dependencies below; null on and behind cycles.

    Dependencies that a longer way replaces go first, so a call that waits for
    the one and the two turns before has one. Chains of calls with one
    dependency shrink by pointer doubling, so a conversation of n turns takes
    log n rounds; calls with several wait, round by round, for all of theirs,
    as many rounds as it takes. No conversation is gathered into one row."""
    edges = write_table(_without_shortcuts(edges), "call-edges")
    fan = edges.groupBy("k").agg(F.count("*").alias("n"), F.min("dep").alias("dep"))
    ptr = write_table(nodes.join(fan, "k", "left").select(
        "k", F.when(F.col("n") == 1, F.col("dep")).otherwise(F.col("k")).alias("to"), F.when(F.col("n") == 1, 1).otherwise(0).cast("long").alias("dist"),
        F.coalesce(F.col("n") > 1, F.lit(False)).alias("several")), "call-pointers")
    several = ptr.where("several").select("k")
    has_several = not several.isEmpty()
    total, rounds = ptr.count(), 0
    while True:  # a pointer that has not come to rest after log2(all calls) doublings runs in a cycle
        step = ptr.select(F.col("k").alias("to"), F.col("to").alias("next"), F.col("dist").alias("more"))
        ptr = write_table(ptr.join(step, "to").select("k", F.col("next").alias("to"), (F.col("dist") + F.col("more")).alias("dist"),
                                                     "several", (F.col("more") > 0).alias("moving")), "call-pointers")
        rounds += 1
        if not ptr.agg(F.bool_or("moving")).first()[0] or 2 ** rounds > 2 * total + 2:
            break
    rest = ptr.select("k", "to", "dist", "several", "moving")
    known = rest.where("NOT moving AND NOT several AND dist = 0").select("k", F.lit(0).cast("long").alias("level"))
    if has_several:
        ends = rest.where("NOT moving").select(F.col("k").alias("dep"), "to", "dist")
        known = write_table(known, "call-levels")
        waits = write_table(edges.join(several, "k").join(ends, "dep", "left").select("k", "to", "dist"), "call-waits")
        while True:  # each round settles a call, so it ends
            ready = (waits.join(known.select(F.col("k").alias("to"), "level"), "to", "left").groupBy("k")
                     .agg(F.max(F.col("level") + F.col("dist") + 1).alias("level"), F.count("*").alias("all_"), F.count("level").alias("got"))
                     .where("all_ = got").select("k", "level"))
            new = write_table(ready.join(known.select("k"), "k", "left_anti"), "call-levels")
            if new.isEmpty():
                break
            known = write_table(known.union(new), "call-levels")
            waits = write_table(waits.join(new.select("k"), "k", "left_anti"), "call-waits")
    return rest.join(known.select(F.col("k").alias("to"), F.col("level").alias("base")), "to", "left").select(
        "k", F.when(~F.col("moving"), F.col("base") + F.col("dist")).alias("level"))


def argument_errors(arguments, spec) -> F.Column:
    """Errors of JSON arguments against ``spec`` (see ``schema_specs``), sorted:
    malformed, missing:a, type:a, enum:a, minimum:a, maximum:a, unknown:a; a
    null spec (no such tool): unknown_tool. Types are those of JSON Schema: a
    number without a fraction is an integer, however it is written."""
    values, args = F.from_json(arguments, "map<string,variant>"), spec["args"]

    def kind(v):
        s = F.schema_of_variant(v)
        whole = s.rlike(r"^DECIMAL\(\d+,0\)$") | (s.isin("DOUBLE", "FLOAT") & (F.try_variant_get(v, "$", "double") % 1 == 0))
        return (F.when((s == "BIGINT") | whole, "integer").when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "number").when(s == "STRING", "string")
                .when(s == "BOOLEAN", "boolean").when(s == "VOID", "null").when(s.startswith("ARRAY"), "array").otherwise("object"))

    def errors(name, test):
        """``test`` of (spec, value, its kind) over the arguments that the call has."""
        def bad(s):
            v = F.element_at(values, s["arg"])
            return F.map_contains_key(values, s["arg"]) & F.coalesce(test(s, v, kind(v)), F.lit(False))
        return F.transform(F.filter(args, bad), lambda s: F.concat(F.lit(f"{name}:"), s["arg"]))

    def number(v, has):
        return F.when(has.isin("integer", "number"), F.try_variant_get(v, "$", "double"))
    found = [
        F.transform(F.filter(args, lambda s: s["required"] & ~F.map_contains_key(values, s["arg"])), lambda s: F.concat(F.lit("missing:"), s["arg"])),
        errors("type", lambda s, v, has: (F.size(s["types"]) > 0) & ~F.array_contains(s["types"], has)
               & ~((has == "integer") & F.array_contains(s["types"], F.lit("number")))),
        errors("enum", lambda s, v, has: s["enum"].isNotNull() & ~F.array_contains(s["enum"], F.to_json(v))),
        errors("minimum", lambda s, v, has: number(v, has) < s["minimum"]),
        errors("maximum", lambda s, v, has: number(v, has) > s["maximum"]),
        F.when(spec["open"], F.array().cast(_STRINGS)).otherwise(
            F.transform(F.array_except(F.map_keys(values), F.transform(args, lambda s: s["arg"])), lambda a: F.concat(F.lit("unknown:"), a))),
    ]
    return (F.when(spec.isNull(), F.array(F.lit("unknown_tool")))
            .when(arguments.isNull() | F.try_parse_json(arguments).isNull() | values.isNull(), F.array(F.lit("malformed")))
            .otherwise(F.array_sort(F.concat(*found))))


def schema_specs(schemas: dict[str, dict]) -> F.Column:
    """Tool name -> JSON Schema of its arguments, as a map of specs; schemas are
    program text, so they are literals. Read are ``required``, ``properties``
    with ``type`` (a name, a list of names, or absent: any), ``enum``,
    ``minimum`` and ``maximum``, and ``additionalProperties`` (here absent means
    false). Schemas inside properties (``items``, nested objects) are not."""
    def one(s):
        rows = []
        for a, p in sorted(s.get("properties", {}).items()):
            types = p.get("type", [])
            enum = [json.dumps(int(x) if isinstance(x, float) and x.is_integer() else x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
                    for x in p["enum"]] if "enum" in p else None
            rows.append(F.struct(
                F.lit(a).alias("arg"), F.array(*[F.lit(t) for t in ([types] if isinstance(types, str) else types)]).cast(_STRINGS).alias("types"),
                F.lit(a in s.get("required", ())).alias("required"), (F.lit(None) if enum is None else F.array(*[F.lit(x) for x in enum])).cast(_STRINGS).alias("enum"),
                F.lit(p.get("minimum")).cast("double").alias("minimum"), F.lit(p.get("maximum")).cast("double").alias("maximum")))
        return F.struct(F.lit(bool(s.get("additionalProperties", False))).alias("open"), F.array(*rows).cast(_ARGS).alias("args"))
    return F.create_map(*[x for n, s in sorted(schemas.items()) for x in (F.lit(n), one(s))])


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call, and one per result without a call: conv_id, call_id,
    turn, level, status, errors, json.

    ``level`` is the topological generation: (level, turn, call_id) orders a
    conversation's calls so that each comes after those it depends on;
    dependencies that are no call of the conversation are left out. ``status``:
    linked, no_result, early_result (the result stands before the call), cyclic
    (it depends on itself, whatever its result) or orphan_result. Of calls with
    one id the first counts (by turn, name, arguments), of results the first by
    turn and content; both are grouped maxima that are combined map-side. Rows
    of a null conv_id or call_id are left out. ``json`` holds the call, its
    dependencies and its result with sorted keys, arguments canonical if they
    are JSON and else null."""
    ids = "conv_id IS NOT NULL AND call_id IS NOT NULL"
    c = (calls.where(ids).groupBy("conv_id", "call_id")
         .agg(F.min(F.struct("turn", "name", "arguments", F.array_sort(F.array_distinct(F.coalesce("depends_on", F.array().cast(_STRINGS)))).alias("deps"))).alias("c"))
         .select("conv_id", "call_id", "c.*"))
    c = write_table(c.withColumn("k", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("call_id"))), "calls")
    r = results.where(ids).groupBy(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call")).agg(F.min(F.struct("turn", "content")).alias("r"))
    wanted = c.select("k", F.explode("deps").alias("d"), "conv_id").where("d IS NOT NULL").select(
        "k", F.col("d").alias("dep_id"), F.concat_ws("/", F.col("conv_id").cast("string"), F.col("d")).alias("dep"))
    edges = write_table(wanted.join(c.select(F.col("k").alias("dep")), "dep", "left_semi"), "call-edges")
    lev = levels(c.select("k"), edges.select("k", "dep"))
    deps = edges.groupBy("k").agg(F.array_sort(F.collect_set("dep_id")).alias("kept_deps"))  # bounded by the call's own list
    spec = F.try_element_at(schema_specs(schemas), F.coalesce("name", F.lit("")))
    both = (c.join(lev, "k").join(deps, "k", "left")
            .join(r, (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_call")), "full_outer"))
    is_call = F.col("k").isNotNull()
    status = (F.when(~is_call, "orphan_result").when(F.col("level").isNull(), "cyclic").when(F.col("r").isNull(), "no_result")
              .when(F.col("r.turn") < F.col("turn"), "early_result").otherwise("linked"))
    text = {"arguments": F.coalesce(canonical(F.col("arguments")), F.lit("null")),
            "depends_on": F.to_json(F.coalesce("kept_deps", F.array().cast(_STRINGS))), "id": F.to_json(F.array(F.coalesce("call_id", "r_call"))),
            "name": F.to_json(F.array("name")), "result": F.coalesce(canonical(F.col("r.content")), F.lit("null"))}
    for quoted in ("id", "name"):  # the one element of an array, as JSON
        text[quoted] = F.call_function("substring", text[quoted], F.lit(2), F.length(text[quoted]) - 2)
    parts = reduce(lambda a, b: [*a, F.lit(","), *b], [[F.lit(f'"{k}":'), text[k]] for k in sorted(text)])
    return both.select(
        F.coalesce("conv_id", "r_conv").alias("conv_id"), F.coalesce("call_id", "r_call").alias("call_id"),
        F.coalesce(F.col("turn"), F.col("r.turn")).alias("turn"), "level", status.alias("status"),
        F.when(is_call, argument_errors(F.col("arguments"), spec)).otherwise(F.array().cast(_STRINGS)).alias("errors"),
        F.concat(F.lit("{"), *parts, F.lit("}")).alias("json"))


#: Schemas of the tools that ``turn_calls`` names.
TURN_TOOLS = {
    "reply": {"properties": {"text": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["text", "turn"]},
    "set_system": {"properties": {"text": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["text"]},
}


def format_conversations(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """``link_calls`` over the tool messages and the plain turns of a table of
    messages (conv_id, turn, role, text; other columns are left out)."""
    m = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    (c1, r1), (c2, r2) = tool_messages(m), turn_calls(m)
    return link_calls(c2.unionByName(c1), r2.unionByName(r1), {**TURN_TOOLS, **(schemas or {})})
