import json

from loomaudit.llm import toolcalls as tc

SCHEMAS = {"add": {"properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "number"}, "s": {"type": "string", "minLength": 2}}, "required": ["a"]}}
CALLS = "conv_id bigint, position int, call_id string, name string, arguments string, after string"
RESULTS = "conv_id bigint, position int, call_id string, content string"


def run(spark, calls, results):
    rows = tc.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    return {(r.conv_id, r.call_id): r for r in rows}


def test_linking_and_validation(spark):
    calls = [
        (1, 0, "x", "add", '{ "b": 1.5, "a": 2, "s": "é\\n\\"/" }', None),
        (1, 2, "y", "add", '{"a": "2", "z": 1, "c": 2}', "x"),
        (1, 4, "z", "add", '{"a": -1, "s": "q"}', "y"),
        (1, 6, "n", "add", "[1]", "missing"),
        (1, 7, "m", "other", "{}", None),
        (1, 8, "o", "add", '{"a": 1, "a": 2}', None),
        (2, 0, "x", "add", None, None),
        (2, 1, "x", "add", '{"a":1}', None),
        (None, 0, None, "add", '{"a":1}', None),
    ]
    results = [(1, 1, "x", "late\tone"), (1, 3, "x", "second"), (1, 3, "y", None), (3, 0, "lost", "o"), (None, 1, None, "v")]
    got = run(spark, calls, results)
    x = got[1, "x"]
    assert (x.status, x.valid, x.repeats, x.level, x.answered) == ("linked", True, 1, 0, 1)
    assert x.json == '{"arguments":{"a":2,"b":1.5,"s":"é\\n\\"/"},"call_id":"x","name":"add","result":"late\\tone","status":"linked"}'
    assert json.loads(x.json)["arguments"] == {"a": 2, "b": 1.5, "s": 'é\n"/'}
    errors = {k: r.errors for k, r in got.items()}
    assert errors[1, "y"] == "type:a,unknown:c+z"
    assert errors[1, "z"] == "small:a,short:s"
    assert errors[1, "n"] == "json" and errors[1, "m"] == "tool" and errors[1, "o"] == "json" and errors[2, "x"] == "json"
    assert [got[1, k].level for k in "xyzn"] == [0, 1, 2, 0]
    assert got[3, "lost"].status == "orphan" and got[1, "z"].status == "pending" and got[None, None].status == "linked"


def test_levels_of_chains_and_cycles(spark):
    chain = [(1, i, f"k{i}", "add", '{"a":1}', f"k{i - 1}" if i else None) for i in range(70)]
    loop = [(2, 0, "p", "add", '{"a":1}', "q"), (2, 1, "q", "add", '{"a":1}', "p"), (2, 2, "r", "add", '{"a":1}', "q")]
    got = run(spark, chain + loop, [])
    assert [got[1, f"k{i}"].level for i in range(70)] == list(range(70))
    assert [got[2, k].errors for k in "pqr"] == ["cycle"] * 3


def test_empty(spark):
    assert run(spark, [], []) == {}


def test_nested_schemas(spark):
    schema = {
        "book": {
            "properties": {
                "who": {"type": "object", "properties": {"name": {"type": "string", "maxLength": 5}, "age": {"type": "integer", "maximum": 120}}, "required": ["name"]},
                "kind": {"type": "string", "enum": ["a", "b"]},
                "days": {"type": "array", "items": {"type": "integer"}},
                "n": {"enum": [1, 2]},
            },
            "required": ["who"],
        }
    }
    cases = {
        '{"who":{"name":"Ann","age":3},"kind":"a","days":[1,2],"n":2}': "",
        '{"who":{"age":300},"kind":"c","days":[1,"x"]}': "item:days,enum:kind,large:who.age,missing:who.name",
        '{"who":7}': "type:who",
        '{"who":{"name":"Josephine","zip":1,"and":2},"days":[null],"n":3}': "item:days,enum:n,long:who.name,unknown:who.and+who.zip",
        '{"kind":null}': "type:kind,missing:who",
        '{"who":{"name":"Ann"},"days":[]}': "",
    }
    calls = spark.createDataFrame([(1, i, f"c{i}", "book", text, None) for i, text in enumerate(cases)], CALLS)
    got = {r.position: r.errors for r in tc.link(calls, spark.createDataFrame([], RESULTS), schema).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_clashing_columns_and_long_texts(spark):
    from pyspark.sql import functions as F

    more = {c: F.lit("x") for c in ("rc", "rk", "lc", "lk", "level", "node", "up", "json", "answered", "is_call")}
    calls = spark.createDataFrame([(1, 0, "x", "add", '{"a":1}', None), (1, 2, "y", "add", '{"a":1}', "x")], CALLS).withColumns(more)
    results = spark.createDataFrame([(1, 1, "x", "long " * 100_000)], RESULTS).withColumns(more)
    got = {r.call_id: r for r in tc.link(calls, results, SCHEMAS).collect()}
    assert got["x"].status == "linked" and len(json.loads(got["x"].json)["result"]) == 500_000 and got["y"].level == 1


def test_turns_of_every_role(spark):
    rows = [(1, 0, "system", "be \"kind\""), (1, 1, "user", "q" * 30), (1, 2, "assistant", "a"), (1, 3, None, None), (1, None, "user", "no turn"), (2, 0, "tool", "x"), (2, 0, "tool", "x")]
    chat = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = tc.link(*tc.chat_calls(chat), tc.CHAT_SCHEMA).unionByName(tc.context(chat)).collect()
    other = sorted((r.conv_id, r.position, json.loads(r.json)["role"] or "") for r in found if r.status == "context")
    assert other == [(1, 0, "system"), (1, 3, ""), (2, 0, "tool"), (2, 0, "tool")]
    assert json.loads(next(r.json for r in found if r.status == "context" and r.position == 0 and r.conv_id == 1))["content"] == 'be "kind"'
    assert sorted(r.status for r in found if r.status != "context") == ["linked", "pending"]
