"""Line dedup, sharding and chat formatting."""

import json
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from llmkit import SF, documents

from pyspark.sql import functions as F

from aquila.llm import chat, line_dedup, sharding

WS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans(line_dedup.UPPER, line_dedup.UPPER.lower())


def brute_lines(rows, least=40, docs=5):
    held = defaultdict(set)
    key = lambda line: line.strip(WS).translate(LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least and i is not None:
                held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= docs and (i is None or i < max(held[key(x)])))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


def test_line_dedup(spark):
    a, b, c = "A" * 45, "é" * 39 + " x", "short line"
    rows = [(i, f"{a}\n{i} own\n\t{b}{' ' * i}\n{c}") for i in range(6)] + [(6, f"{a.lower()}\n{a}\n\n"), (7, None), (8, ""), (9, "\n"), (None, f"{a}\nkept"), (3, f"other\n{b}"), (2, f"{a}\n2 own\n\t{b}  \n{c}")]
    got = line_dedup.dedup_lines(documents(spark, rows), keep=("lang", "token"))
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped", "lang", "token"]
    assert Counter(map(tuple, got.drop("lang", "token").collect())) == brute_lines(rows)
    assert line_dedup.dedup_lines(documents(spark, rows).limit(0)).collect() == []


def test_line_dedup_needs_five_documents(spark):
    line = "x" * 40
    for n in (4, 5):
        got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(documents(spark, [line] * n)).collect()}
        assert sum(got.values()) == (0 if n < 5 else 4) and got[n - 1] == 0


def test_sharding(spark):
    rows = [(i, f"text {i % 7}") for i in range(400)] + [(5, "again"), (5, "again"), (None, "x"), (None, None), (401, ""), (402, None)]
    got = sharding.shard_records(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["shard"], r["grown_shard"]))
    assert all(len(s) == 1 for s in by.values())
    more = {r["doc_id"]: r["shard"] for r in sharding.shard_records(documents(spark, rows), n_shards=17).collect()}
    assert all(more[r["doc_id"]] == r["grown_shard"] for r in got)
    assert sharding.shard_records(documents(spark, []).limit(0)).collect() == []


def test_weights(spark):
    got = Counter(r["shard"] for r in sharding.shard_records(documents(spark, ["x"] * 3000), weights=[3.0, 1.0]).collect())
    assert 2.5 < got[0] / got[1] < 3.6


CALLS = "conv_id bigint, call_id string, name string, turn bigint, arguments string, depends_on array<string>, level int"
SCHEMA = {"required": ["q"], "additionalProperties": False, "properties": {"q": {"type": "string", "minLength": 2}, "n": {"type": "integer", "maximum": 9}, "how": {"enum": ["a", "b"]}}}


def test_linking(spark):
    calls = [
        (1, "a", "find", 0, '{"q":"xy","n":3}', [], 0), (1, "b", "find", 1, '{"n":1, "q":"zz"}', ["a", "c"], 0), (1, "c", "find", 2, '{"q":"x"}', ["a", "a", "nowhere"], 0), (1, "d", "find", 3, "{broken", None, 0),
        (1, "e", "other", 4, "{}", ["f"], 0), (1, "f", "find", 5, '{"n":"1","q":7,"z":0,"how":"c"}', ["e"], 0), (1, "g", "find", 6, None, ["e"], 0), (None, "a", "find", 7, '{"q":"ok","n":12}', ["b"], 0), (1, "a", "find", 9, '{"q":"later"}', [], 0), (2, None, "find", 1, "{}", [], 0),
    ]
    results = [(1, "a", 2, "second"), (1, "a", 1, "first"), (None, "a", 8, "for null"), (1, "zzz", 1, "no call"), (1, None, 1, "x")]
    got = {(r["conv_id"], r["call_id"]): r for r in chat.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, "conv_id bigint, call_id string, turn bigint, content string"), {"find": SCHEMA}).collect()}
    assert len(got) == 9
    alone = got[1, "zzz"]
    assert (alone["kind"], alone["turn"], alone["result_turn"], alone["n_calls"], alone["n_results"], alone["valid"], alone["record"]) == ("result", None, 1, 0, 1, False, '{"call_id":"zzz","result":"no call"}')
    assert [got[1, k]["level"] for k in "abcdefg"] == [0, 2, 1, 0, None, None, None] and got[None, "a"]["level"] == 0
    a = got[1, "a"]
    assert (a["n_calls"], a["n_results"], a["result_turn"], a["valid"]) == (2, 2, 1, True)
    assert a["record"] == '{"arguments":{"n":3,"q":"xy"},"call_id":"a","depends_on":[],"level":0,"name":"find","result":"first"}'
    assert json.loads(got[1, "d"]["record"])["arguments"] == {"text": "{broken"} and not got[1, "d"]["valid"]
    assert [got[k]["problems"] for k in ((1, "c"), (1, "e"), (1, "f"), (None, "a"))] == [["q: minLength"], ["unknown name"], ["unknown property", "q: type", "n: type", "how: enum"], ["n: maximum"]]
    assert got[1, "b"]["valid"] and got[None, "a"]["result_turn"] == 8
    empty = spark.createDataFrame(calls, CALLS).limit(0)
    answers = spark.createDataFrame(results, "conv_id bigint, call_id string, turn bigint, content string")
    assert {(r["kind"], r["call_id"]) for r in chat.link_calls(empty, answers, {}).collect()} == {("result", "a"), ("result", "zzz")}
    assert chat.link_calls(empty, answers.limit(0), {}).collect() == []


def test_schema_rules(spark):
    schema = {"required": ["a"], "properties": {
        "a": {"type": "integer", "minimum": 2, "enum": [1, 2, 7, True, None, "x", [1, {"k": 2}]]}, "it's": {"type": ["string", "null"], "maxLength": 2},
        "in": {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"maximum": 5}}}, "list": {"type": "array", "items": {"type": "string", "minLength": 2}},
    }}
    cases = {
        '{"a":2}': [], '{"a":7.0}': [], '{"a":1}': ["a: minimum"], '{"a":2.5}': ["a: type", "a: enum"], '{"a":"2"}': ["a: type", "a: enum"], '{"a":true}': ["a: type"], '{"a":"x"}': ["a: type"], '{"a":null}': ["a: type"], '{"a":[1,{"k":2}]}': ["a: type"],
        '{"a":2,"it\'s":"abc"}': ["it's: maxLength"], '{"a":2,"it\'s":null}': [], '{"a":2,"it\'s":123}': ["it's: type"], '{"a":2,"in":{}}': ["in.k: missing"], '{"a":2,"in":{"k":6,"z":1}}': ["in: unknown property", "in.k: maximum"], '{"a":2,"in":{"k":"9"}}': [], '{"a":2,"in":[]}': ["in: type"],
        '{"a":2,"list":["ab","cd"]}': [], '{"a":2,"list":["ab","c"]}': ["list: items"], '{"a":2,"list":["ab",3]}': ["list: items"], "[]": ["not an object"], "nothing": ["not an object"], "{}": ["a: missing"],
    }
    got = spark.createDataFrame([(c,) for c in cases], "t string").select("t", chat.violations(F.col("t"), schema).alias("v")).collect()
    assert {r["t"]: r["v"] for r in got} == cases
    with pytest.raises(ValueError, match="quotes"):
        chat.violations(F.col("t"), {"properties": {"a'\"": {}}})


def test_chat_keeps_all_turns(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "assistant", "again"), (1, None, "user", "lost"), (None, 5, None, None), (2, 0, "assistant", "opens"), (2, 1, "tool", "t")]
    conversations = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    linked = chat.link_calls(*chat.turns_as_calls(conversations), {"reply": chat.REPLY})
    assert sorted((r["kind"], r["call_id"]) for r in linked.collect()) == [("call", "1:1"), ("result", "1:2"), ("result", "2:-1")]
    assert sorted(r["record"] for r in chat.other_turns(conversations).collect()) == ['{"content":"lost","role":"user","turn":null}', '{"content":"s","role":"system","turn":0}', '{"content":"t","role":"tool","turn":1}', '{"content":null,"role":null,"turn":5}']


def test_queries_against_sql(spark):
    from aquila.llm.registry import QUERIES, SQL

    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in SQL.items():
        df = QUERIES[name](spark, SF)
        assert Counter(map(tuple, df.collect())) == Counter(c.execute(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()), name


def test_no_python_in_native_plans(spark):

    for df in (line_dedup.op1_line_dedup(spark, SF), sharding.op3_sharding(spark, SF), chat.op4_chat_formatting(spark, SF)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
