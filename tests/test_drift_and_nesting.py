import json

from pyspark.sql import functions as F

from tracewright.operators.drift import file_changes, unified_table
from tracewright.operators.nesting import KEY, child_table, decoded, merged_paths, nested_nodes, token_totals

RAW = "rec_id bigint, feed string, file_name string, line_no int, raw_line string, kind string"


def feed(spark, files):
    data, n = [], 0
    for name, lines in files:
        for i, line in enumerate(lines):
            n += 1
            data.append((n, "f", name, i, line if isinstance(line, (str, type(None))) else json.dumps(line), "x"))
    return spark.createDataFrame(data, RAW)


def test_every_kind_of_change(spark, rows):
    a = [{"id": f"r{i}", "cost": i / 7, "model": "m", "gone": 1, "args": {"p": i}, "opt": None} for i in range(6)]
    b = [{"id": f"r{i}", "price": i / 7, "model": "m", "args": json.dumps({"p": i}), "new": [1], "opt": "now"} for i in range(3, 9)]
    c = [{"id": f"r{i}", "price": str(i / 7), "model": 5 if i % 2 else "m", "arguments": json.dumps({"p": i}), "opt": None} for i in range(7, 12)]
    df = feed(spark, [("1", a + ['{"id": "r1", "cut": 1', "[1]", None, ""]), ("2", b + b), ("3", c), ("4", ["not json"])])
    got = rows(file_changes(df))
    assert got == sorted(
        [
            ("2", "added", "new", ""), ("2", "added", "opt", ""), ("2", "removed", "gone", ""), ("2", "renamed", "cost", "price"), ("2", "retyped", "args", "string"),
            ("3", "removed", "new", ""), ("3", "removed", "opt", ""), ("3", "retyped", "price", "string"), ("3", "retyped", "model", "number|string"), ("3", "renamed", "args", "arguments"),
            ("4", "removed", "arguments", ""), ("4", "removed", "id", ""), ("4", "removed", "model", ""), ("4", "removed", "price", ""),
        ],
        key=str,
    )
    assert file_changes(df.limit(0)).count() == 0


def test_small_value_sets_are_no_renaming(spark, rows):
    a = [{"id": f"a{i}", "rounds": i % 50} for i in range(60)]
    b = [{"id": f"b{i}", "retries": i % 5} for i in range(60)]
    assert rows(file_changes(feed(spark, [("1", a), ("2", b)]))) == [("2", "added", "retries", ""), ("2", "removed", "rounds", "")]


def test_unified_table_keeps_all_lines_and_types(spark):
    df = feed(spark, [("1", [{"x": 1, "y": {"a": [1]}}, {"x": "1", "z": True}, "broken"])])
    got = {r.rec_id: r.fields for r in unified_table(df.union(df)).collect()}
    assert len(got) == 3 and got[3] is None
    assert got[1]["x"].kind == "number" and got[1]["x"].as_number == 1.0 and got[2]["x"].as_string == "1"
    assert got[1]["x"].as_json == got[2]["x"].as_json == "1" and got[2]["z"].as_boolean is True


def test_decoded(spark):
    good = ['{"a": 1}', json.dumps('[{"a": 1}]'), "<task>\n<task_result>\n[1]\n</task_result>", " [] ", '{"a": "]}]]"}']
    bad = [None, "", "11", '"x"', "{emit}", "[ok] done", '{"a": NaN}', "[" * 100_000, json.dumps(json.dumps("{}")), '{"a": 1} done', '{"a": 1} {"b": 2}', '{"a": 1}], [2', '{"a": 1}, {"b": 2}', '{"a": 1', json.dumps("3")]
    df = spark.createDataFrame(list(enumerate(good + bad)), "i int, text string")
    got = {r.i: r.v for r in decoded(df, ["i"], F.col("text"), tagged=True).select("i", F.col("open").cast("string").alias("v")).collect()}
    assert got == {0: '{"a":1}', 1: '[{"a":1}]', 2: "[1]", 3: "[]", 4: '{"a":"]}]]"}'}


def nodes_of(spark, *values):
    e = spark.createDataFrame([(i, "s", ((v if isinstance(v, str) else json.dumps(v),), None)) for i, v in enumerate(values)], EVENT)
    m = spark.createDataFrame([], MSG)
    return sorted(tuple(r)[1:] for r in nested_nodes(e, m).select(*KEY).collect())


def by_walking(value, path="", above="", kind=None):
    """The nodes of one value, one after the other."""
    if isinstance(value, list):
        for i, x in enumerate(value):
            here = f"{path}.{i}" if path else str(i)
            if isinstance(x, dict):
                yield above, here, kind
                yield from by_walking(x, here, here)
            elif isinstance(x, list):
                yield from by_walking(x, here, above, kind)
    elif isinstance(value, dict):
        for k, x in value.items():
            if k in ("subtasks", "files", "hits", "edits", "hunks"):
                yield from by_walking(x if isinstance(x, list) else [x], path, above, k)
            elif isinstance(x, dict):
                yield from by_walking(x, path, above)


def test_nodes(spark):
    deep = {}
    for _ in range(40):
        deep = {"files": [deep]}
    values = [
        {"files": {"path": "a", "hits": [{"l": 1}, None, {"l": 2}, 5, [{"n": 1}]]}, "subtasks": [{"subtasks": [{"files": []}]}], "stats": {"by": {"m": 1, "edits": {}}}, "tags": [{"no": 1}]},
        [None, {"a": 1, "files": [{}]}, [{"hits": {"x": 1}}], "t"], [[[{"a": {"hunks": [1, {"e": '"]['}]}}]]], {}, [], deep,
    ]
    want = sorted((i, *n) for i, v in enumerate(values) for n in by_walking(v, kind="items" if isinstance(v, list) else None))
    assert nodes_of(spark, *values) == want and len(want) > 50


MSG = "msg_id bigint, tool_calls array<struct<id string, type string, function struct<name string, arguments string>>>, fields string"
EVENT = (
    "event_id bigint, sessionid string, part struct<state struct<output string>, tokens struct<total bigint, input bigint, output bigint, reasoning bigint, cache struct<write bigint, read bigint>>>"
)


def test_nested_nodes_and_child_tables(spark, rows):
    calls = [("c1", "function", ("f", '{"edits": [{"path": "a", "hunks": {"start": 1}}]}')), None, ("c2", "function", ("g", "{cut")), ("c3", None, None)]
    m = spark.createDataFrame([(1, calls, "x"), (1, calls, "x"), (2, None, "x"), (3, [], None), (None, calls, "x")], MSG)
    e = spark.createDataFrame([(7, "s", (('[{"files": [{"p": 1}]}]',), None)), (8, "s", None), (9, None, ((None,), None))], EVENT)
    found = nested_nodes(e, m)
    want = [
        ("event", 7, "", "0", "items"), ("event", 7, "0", "0.0", "files"), ("message", 1, "", "0", "tool_calls"), ("message", 1, "", "2", "tool_calls"),
        ("message", 1, "", "3", "tool_calls"), ("message", 1, "0", "0.0", "edits"), ("message", 1, "0.0", "0.0.0", "hunks"),
    ]
    assert rows(found, "record_kind", "record_id", "parent_path", "node_path", "node_kind") == want
    assert rows(child_table(found, "hunks"), "parent_path", "ordinal") == [("0.0", 0)]
    assert rows(child_table(found, "files"), "record_id", "parent_path", "fields") == [(7, "0", {"p": "1"})]
    assert rows(nested_nodes(e, m, values=False)) == want
    assert ("message", "hunks", "start", "BIGINT", 1) in rows(merged_paths(found))
    assert nested_nodes(e.limit(0), m.limit(0)).count() == 0


def test_token_totals(spark, rows):
    t = lambda *x: (None, x)
    e = spark.createDataFrame([(1, "s", t(10, 6, 4, 0, None)), (1, "s", t(10, 6, 4, 0, None)), (2, "s", t(None, 1, 2, 3, (4, 5))), (3, "u", (None, None))], EVENT)
    assert rows(token_totals(e)) == [("s", 2, 25, 7, 6, 3, 4, 5)]
