"""Chat formatting: tool calls linked to their results, checked, ordered and written as canonical JSON.

Native throughout: calls and results meet in a hash join by conversation and identifier, never by conversation alone, so
one conversation of any length is spread over all tasks. Canonical JSON comes from Spark's VARIANT, whose objects keep
their keys in order.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce
from operator import gt, lt, or_
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aquila.llm.tables import load, written

def canonical(text: Column) -> Column:
    """JSON text with the keys of all objects sorted and no white space; null where it is no JSON."""
    return F.to_json(F.try_parse_json(text))


def violations(arguments: Column, schema: Mapping[str, Any]) -> Column:
    """What a JSON text breaks of a schema, as an array of short texts. Known, at any depth: type, enum, required,
    additionalProperties, properties, items, and of texts minLength and maxLength, of numbers minimum and maximum. A rule of
    another type of value doesn't bind, 1.0 is an integer, and 1 isn't "1". What is in an array counts once, as its items. A
    property's name must not hold both kinds of quotes."""
    value = F.try_parse_json(arguments)
    kind = F.schema_of_variant(value)
    found = [F.when(value.isNull() | ~kind.startswith("OBJECT"), "not an object")]
    rules = {k: v for k, v in schema.items() if k in ("required", "properties", "additionalProperties")}
    return F.array_compact(F.array(*found, *(F.when(broken, what) for broken, what in _broken(value, rules, ""))))


def _broken(value: Column, rule: Mapping[str, Any], path: str) -> list[tuple[Column, str]]:
    """Conditions under which a value that is there breaks a rule, each with its text."""
    kind = F.schema_of_variant(value)
    text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    is_text, is_object = kind == "STRING", kind.startswith("OBJECT")
    is_number = kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE")
    of_type = {"string": is_text, "number": is_number, "integer": is_number & (number == F.floor(number)), "boolean": kind == "BOOLEAN", "object": is_object, "array": kind.startswith("ARRAY"), "null": kind == "VOID"}
    out = []

    def same(other: Any) -> Column:
        if isinstance(other, bool) or other is None:
            return (kind == ("VOID" if other is None else "BOOLEAN")) & F.coalesce(text == str(other).lower(), F.lit(other is None))
        if isinstance(other, int | float):
            return is_number & (number == F.lit(float(other)))
        return is_text & (text == other) if isinstance(other, str) else F.to_json(value) == canonical(F.lit(json.dumps(other)))

    def add(condition: Column, what: str, at: str = path) -> None:
        out.append((F.coalesce(condition, F.lit(False)), f"{at}: {what}" if at else what))

    if "type" in rule:
        names = [rule["type"]] if isinstance(rule["type"], str) else rule["type"]
        add(~reduce(or_, (F.coalesce(of_type[t], F.lit(False)) for t in names)), "type")
    if "enum" in rule:
        add(~reduce(or_, (F.coalesce(same(x), F.lit(False)) for x in rule["enum"]), F.lit(False)), "enum")
    for key, bound, size, worse in (("minLength", is_text, F.char_length(text), lt), ("maxLength", is_text, F.char_length(text), gt), ("minimum", is_number, number, lt), ("maximum", is_number, number, gt)):
        if key in rule:
            add(bound & worse(size, F.lit(rule[key])), key)
    if rule.keys() & {"required", "properties", "additionalProperties"}:
        keys, properties = F.json_object_keys(F.to_json(value)), rule.get("properties", {})
        for name in rule.get("required", []):
            add(is_object & ~F.array_contains(keys, name), "missing", f"{path}.{name}" if path else name)
        if rule.get("additionalProperties", True) is False:
            known = F.array(*[F.lit(k) for k in properties]) if properties else F.array().cast("array<string>")
            add(is_object & (F.size(F.array_except(keys, known)) > 0), "unknown property")
        for name, own in properties.items():
            quote = "'" if "'" not in name else '"'
            if quote in name:
                raise ValueError(f"{name!r} can't be checked: it holds both kinds of quotes")
            there = is_object & F.array_contains(keys, name)
            for broken, what in _broken(F.try_variant_get(value, f"$[{quote}{name}{quote}]", "variant"), own, f"{path}.{name}" if path else name):
                out.append((F.coalesce(there, F.lit(False)) & broken, what))
    if isinstance(rule.get("items"), Mapping):
        some = lambda v: reduce(or_, (broken for broken, _ in _broken(v, rule["items"], path)), F.lit(False))
        add(of_type["array"] & F.exists(F.try_variant_get(value, "$", "array<variant>"), some), "items")
    return out


def _key(call: str) -> Column:
    """A call's identifier within its conversation, which may be null."""
    return F.to_json(F.struct("conv_id", F.col(call).alias("call_id")))


def levels(calls: DataFrame) -> DataFrame:
    """key and level of calls (conv_id, call_id, depends_on): 0 if they wait for no other, else one more than the highest
    that they wait for. Those in or behind a circle have none.

    A chain of calls that each wait for one other is followed by doubling steps, so its length costs its logarithm in
    rounds. What waits for several calls then takes a round for each level of such calls."""
    nodes = calls.select(_key("call_id").alias("key")).distinct()
    edges = calls.select("conv_id", _key("call_id").alias("key"), F.explode("depends_on").alias("dep")).select("key", _key("dep").alias("dep")).distinct()
    edges = written(edges.join(nodes.select(F.col("key").alias("dep")), "dep").select("key", "dep"), "waits")
    degree = written(edges.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "degrees")
    chain = edges.join(degree.where("n = 1").select("key"), "key")
    inner = chain.select(F.col("key").alias("dep"), F.lit(True).alias("goes_on"))
    chain = written(chain.join(inner, "dep", "left").select("key", F.col("dep").alias("to"), F.lit(1).cast("long").alias("far"), F.col("goes_on").isNull().alias("ends")), "chains")
    open_ = chain.where("not ends").count()
    for _ in range(open_.bit_length() + 1):  # what is open after so many steps runs in a circle
        if not open_:
            break
        ahead = chain.select(F.col("key").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"), F.col("ends").alias("done"))
        moved = chain.where("not ends").join(ahead, "to").select("key", F.col("next").alias("to"), (F.col("far") + F.col("more")).alias("far"), F.col("done").alias("ends"))
        chain = written(chain.where("ends").unionByName(moved), "chains")
        open_ = chain.where("not ends").count()
    ended = chain.where("ends").select("key", "to", "far")
    new = written(nodes.join(degree.select("key"), "key", "left_anti").withColumn("level", F.lit(0).cast("long")), "levels")
    several = edges.join(degree.where("n > 1").select("key"), "key")
    left = several.join(ended.select(F.col("key").alias("dep"), "to", "far"), "dep", "left")
    left = written(left.select("key", F.coalesce("to", "dep").alias("to"), F.coalesce("far", F.lit(0)).alias("far"), F.lit(-1).cast("long").alias("met")), "waits")
    done = new
    while not left.isEmpty() and not new.isEmpty():
        left = left.join(new.select(F.col("key").alias("to"), "level"), "to", "left").select("key", "to", "far", F.greatest("met", F.coalesce(F.col("level") + F.col("far"), F.lit(-1))).alias("met"))
        left = written(left, "waits")
        new = written(left.groupBy("key").agg(F.min("met").alias("least"), F.max("met").alias("most")).where("least >= 0").select("key", (F.col("most") + 1).alias("level")), "levels")
        done = done.unionByName(new)
        left = written(left.join(new.select("key"), "key", "left_anti"), "waits")
    done = written(done, "levels")
    return done.unionByName(ended.join(done.select(F.col("key").alias("to"), "level"), "to").select("key", (F.col("level") + F.col("far")).alias("level")))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, Any]]) -> DataFrame:
    """One row per call, of kind call: conv_id, call_id, name, turn, level, result_turn, n_calls, n_results, valid, problems and
    record (canonical JSON of arguments, call_id, depends_on, level, name and result). Results without a call have a row of kind
    result for each identifier, with no name, turn and level, n_calls 0, not valid, and a record of call_id and result.

    calls: conv_id, call_id, name, turn, arguments (JSON text), depends_on (array of call ids); results: conv_id, call_id,
    turn, content. level is the topological order: a call waits only for calls of lower levels; ties are ordered by turn.
    Of calls or results that repeat an identifier in a conversation the one of least turn, then text, counts, and n_calls
    and n_results tell how many there are. Calls and results without an identifier are left out. A null conv_id is a
    conversation like any other. Arguments that are no JSON stay as text. Calls of unknown names, without a schema, are
    not valid. Identifiers to wait for that are no calls of the conversation don't count. Empty tables give no rows or no
    results; other columns are ignored.
    """
    one = (
        calls.where("call_id is not null").groupBy("conv_id", "call_id")
        .agg(F.min(F.struct("turn", "arguments", "name", F.array_sort(F.coalesce("depends_on", F.array().cast("array<string>"))).alias("depends_on"))).alias("c"), F.count(F.lit(1)).alias("n_calls"))
        .select("conv_id", "call_id", "c.*", "n_calls")
    )
    one = written(one, "calls")
    answer = (
        results.where("call_id is not null").groupBy(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"))
        .agg(F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    )
    order = levels(one).withColumnRenamed("key", "l_key")
    linked = one.join(answer, F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("call_id") == F.col("r_call")), "full")
    linked = linked.withColumns({"kind": F.when(F.col("call_id").isNull(), "result").otherwise("call"), "conv_id": F.when(F.col("call_id").isNull(), F.col("r_conv")).otherwise(F.col("conv_id")), "call_id": F.coalesce("call_id", "r_call")})
    linked = linked.join(order, _key("call_id") == F.col("l_key"), "left")
    problems = F.lit(None).cast("array<string>")
    for name, schema in schemas.items():
        problems = F.when(F.col("name") == name, violations(F.col("arguments"), schema)).otherwise(problems)
    problems = F.when(F.col("kind") == "result", F.array(F.lit("no call"))).otherwise(F.coalesce(problems, F.array(F.lit("unknown name"))))
    text = F.to_json(F.struct(F.coalesce(F.try_parse_json("arguments"), F.to_variant_object(F.struct(F.col("arguments").alias("text")))).alias("arguments"), "call_id", "depends_on", "level", "name", F.col("r.content").alias("result")), {"ignoreNullFields": "false"})
    alone = F.to_json(F.struct("call_id", F.col("r.content").alias("result")), {"ignoreNullFields": "false"})
    return linked.withColumn("problems", problems).select(
        "kind", "conv_id", "call_id", "name", "turn", "level", F.col("r.turn").alias("result_turn"), F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), (F.size("problems") == 0).alias("valid"), "problems", canonical(F.when(F.col("kind") == "call", text).otherwise(alone)).alias("record")
    )


#: A user's turn as a call of this tool.
REPLY = {"required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1, "maxLength": 300}, "turn": {"type": "integer", "minimum": 0}}}


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User turns as calls of the tool reply, which wait for the call two turns before, and assistant turns as results of
    the turn before them."""
    call = lambda back: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), (F.col("turn") - back).cast("string"))
    of = lambda role: conversations.where((F.col("role") == role) & F.col("turn").isNotNull())
    calls = of("user").select("conv_id", call(0).alias("call_id"), F.lit("reply").alias("name"), "turn", F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"), F.array(call(2)).alias("depends_on"))
    return calls, of("assistant").select("conv_id", call(1).alias("call_id"), "turn", F.col("text").alias("content"))


def other_turns(conversations: DataFrame) -> DataFrame:
    """The turns that are neither calls nor results, as rows of kind turn with a record of content, role and turn."""
    rest = conversations.where(F.coalesce(~F.col("role").isin("user", "assistant"), F.lit(True)) | F.col("turn").isNull())
    none = lambda kind: F.lit(None).cast(kind)
    text = F.to_json(F.struct(F.col("text").alias("content"), "role", "turn"), {"ignoreNullFields": "false"})
    return rest.select(
        F.lit("turn").alias("kind"), "conv_id", none("string").alias("call_id"), "turn", none("long").alias("level"), none("long").alias("result_turn"), F.lit(0).cast("long").alias("n_calls"), F.lit(0).cast("long").alias("n_results"), none("boolean").alias("valid"), canonical(text).alias("record")
    )


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = load(spark, sf_dir, "conversations")
    return link_calls(*turns_as_calls(conversations), {"reply": REPLY}).drop("name", "problems").unionByName(other_turns(conversations))


SQL = """
WITH c AS (SELECT conv_id, turn, min(text) AS text, count(*) AS n_calls FROM conversations WHERE role = 'user' AND turn IS NOT NULL GROUP BY conv_id, turn),
r AS (SELECT conv_id, turn, min(text) AS text, count(*) AS n FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY conv_id, turn),
g AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM c),
l AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level, coalesce(conv_id::VARCHAR, '') || ':' AS head FROM g)
SELECT 'call' AS kind, l.conv_id, head || l.turn AS call_id, l.turn, l.level, r.turn AS result_turn, n_calls, coalesce(r.n, 0) AS n_results,
  l.text IS NOT NULL AND length(l.text) BETWEEN 1 AND 300 AND l.turn >= 0 AS valid,
  '{"arguments":{' || coalesce('"prompt":' || to_json(l.text)::VARCHAR || ',', '') || '"turn":' || l.turn || '},"call_id":' || to_json(head || l.turn)::VARCHAR
    || ',"depends_on":[' || to_json(head || (l.turn - 2))::VARCHAR || '],"level":' || l.level || ',"name":"reply","result":' || coalesce(to_json(r.text)::VARCHAR, 'null') || '}' AS record
FROM l LEFT JOIN r ON l.conv_id IS NOT DISTINCT FROM r.conv_id AND r.turn = l.turn + 1
UNION ALL
SELECT 'result', conv_id, coalesce(conv_id::VARCHAR, '') || ':' || (turn - 1), NULL, NULL, turn, 0, n, false,
  '{"call_id":' || to_json(coalesce(conv_id::VARCHAR, '') || ':' || (turn - 1))::VARCHAR || ',"result":' || coalesce(to_json(text)::VARCHAR, 'null') || '}'
FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id IS NOT DISTINCT FROM r.conv_id AND c.turn = r.turn - 1)
UNION ALL
SELECT 'turn', conv_id, NULL, turn, NULL, NULL, 0, 0, NULL,
  '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || ',"turn":' || coalesce(turn::VARCHAR, 'null') || '}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant') OR turn IS NULL
"""
