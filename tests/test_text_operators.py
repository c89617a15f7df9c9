import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracewright.operators import extract as ex
from tracewright.operators import normalize as nz
from tracewright.operators import retrieval as rt
from tracewright.operators import runs, stats


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "command, paths, bounds",
    [
        ("cat src/a.py", ["src/a.py"], (1, -1)), ("cat -n f.py", [], (1, -1)), ("head -n 20 'a b/c.py'", ["a", "b/c.py"][1:], (1, 20)), ("head -n20 a.md", ["a.md"], (1, 20)),
        ("tail -n 8 x/y", ["x/y"], (-8, -1)), ("sed -n '3,7p' a.py", ["a.py"], (3, 7)), ("sed '3p' a.py", ["a.py"], (3, 3)), ("cat /path/to/x.py -x -q -v b.py c.py", ["b.py", "c.py"], (1, -1)), ("", [], (1, -1)),
    ],
)
def test_commands(spark, command, paths, bounds):
    assert one(spark, ex.path_args(F.col("c")), c=command) == paths
    assert tuple(one(spark, ex.line_range(F.col("c")), c=command)) == bounds


def test_segments_and_reads(spark, rows):
    df = spark.createDataFrame([(1, "cat a.py && ls | wc; tail -n 3 b.py || rg x src/", "c.py:7:hit\nc.py:7:hit\nnoise")], "id int, command string, out string")
    assert rows(ex.segments(df, "command"), "seg_no", "segment", "is_last")[1] == (1, "ls | wc", False)
    assert rows(ex.read_regions(df, ["id"], "command", "out")) == [(1, "a.py", 1, -1), (1, "b.py", -3, -1), (1, "c.py", 7, 7)]


def test_tool_calls_and_diffs(spark, rows):
    calls = [(1, "str_replace_editor", '{"command": "view", "path": "/w/a.py", "view_range": [3, 9]}'), (2, "str_replace_editor", '{"command": "view", "path": "b"}'), (3, "str_replace_editor", '{"command": "str_replace", "path": "c"}'), (4, "bash", "{bad"), (5, None, None)]
    df = spark.createDataFrame(calls, "id int, name string, arguments string")
    assert rows(ex.tool_reads(df, ["id"])) == [(1, "/w/a.py", 3, 9), (2, "b", 1, -1)] and rows(ex.tool_edits(df, ["id"])) == [(3, "c")]
    patch = spark.createDataFrame([(1, "diff --git a/x y.py b/x y.py\n--- a/x y.py\n+++ b/z.py\n"), (2, None)], "id int, patch string")
    assert rows(ex.diff_files(patch, ["id"], "patch")) == [(1, "x y.py"), (1, "z.py")]
    assert one(spark, ex.relative_path(F.col("p"), F.lit("/workspace/a")), p="`/workspace/a/./b.py`") == "b.py"
    assert [tuple(r) for r in one(spark, ex.range_list(F.col("t")), t="keep [5-7, 19-13, 0, 4]")] == [(5, 7), (13, 19), (4, 4)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("RELEVANT_FILES:\n- src/a.py:12-20\n* `b.ts`:L3–L4\n3. c.py:9\nd/e.py\n- f.py:9-3\n- http://x:80", [("src/a.py", 12, 20), ("b.ts", 3, 4), ("c.py", 9, 9), ("d/e.py", 1, -1)]),
        ("I looked at (src/a.py:3) and b.py:7-9.", [("src/a.py", 3, 3), ("b.py", 7, 9)]), ("nothing", []), (None, []),
    ],
)
def test_answer_grammar(text, want):
    assert ex.parse_locations(text) == want


def test_small_parsers():
    src = "class A:\n    def f(self):\n        pass\n\ndef f():\n    return 1\n"
    assert ex.entity_lines(src, "A.f") == (2, 3) and ex.entity_lines(src, "f") == (5, 6) and ex.entity_lines(src, "g") is None and ex.entity_lines("def (", "x") is None
    assert ex.first_json_object('so {x} {"a": {"b": 1}} y') == {"a": {"b": 1}} and ex.first_json_object(None) is None
    assert ex.test_list('["a"]') == ["a"] == ex.test_list("['a']") and ex.test_list("a(") == [] == ex.test_list(None)
    assert ex.extract_diff("hi\n```diff\nx\n--- a/f\n+++ b/f\n@@ -1 +1 @@\n-a\n+b\n```\n").startswith("--- a/f")
    assert "@@ -1,2 +1,3 @@" in ex.recount_hunks("--- a/f\n+++ b/f\n@@ -1,9 +1,9 @@\n a\n-b\n+c\n+d")


def test_bm25_by_hand(spark):
    texts = ["a b a", "b c", "c d e", "", "x y z"]
    docs = spark.createDataFrame(list(enumerate(texts)), "chunk_seq int, content string")
    q = spark.createDataFrame([(1, "a a b"), (2, "nothing here")], "query_id int, text string")
    got = {(r.query_id, r["rank"]): (r.chunk_seq, r.score) for r in rt.bm25(docs, q, 3).collect()}
    ws = [t.split() for t in texts]
    n, avg = len(ws), sum(map(len, ws)) / len(ws)
    df = Counter(w for d in ws for w in set(d))
    raw = {w: math.log(n - f + 0.5) - math.log(f + 0.5) for w, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    score = lambda d: sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in "a a b".split() if w in idf)
    assert got[1, 1][0] == 0 and abs(got[1, 1][1] - score(ws[0])) < 1e-9 and abs(got[1, 2][1] - score(ws[1])) < 1e-9 and got[1, 3] == (2, 0.0)
    assert [got[2, r] for r in (1, 2, 3)] == [(0, 0.0), (1, 0.0), (2, 0.0)]


def test_bm25_by_group_and_empty(spark, rows):
    docs = spark.createDataFrame([("r", i, t) for i, t in enumerate(["a b a", "b c", "c d e"])] + [("s", i, t) for i, t in enumerate(["a", "x a", "y"])] + [(None, 9, "a")], "repo string, chunk_seq int, content string")
    q = spark.createDataFrame([("r", 1, "a b"), ("s", 1, "a y"), ("t", 1, "a"), (None, 1, "a"), ("r", 2, " ")], "repo string, query_id int, text string")
    both = rows(rt.bm25(docs, q, 2, ["repo"]), "repo", "query_id", "chunk_seq", "rank")
    alone = [(r, *x) for r in "rs" for x in rows(rt.bm25(docs.filter(f"repo = '{r}'").drop("repo"), q.filter(f"repo = '{r}'").drop("repo"), 2), "query_id", "chunk_seq", "rank")]
    assert both == sorted(alone, key=str) and len(both) == 4
    for d, x in ((docs.limit(0), q), (docs, q.limit(0))):
        assert rt.bm25(d.drop("repo"), x.drop("repo"), 2).count() == 0 and rt.tfidf(d.drop("repo"), x.drop("repo"), ["the"]).count() == 0


def test_chunks(spark, rows):
    f = spark.createDataFrame([("r", "a", "\n".join(map(str, range(25)))), ("r", "b", " \n\n"), ("r", "c", ""), ("r", "d", None), ("r", "e", "x\r\ny\u2028z\n")], "repo string, path string, text string")
    assert rows(rt.chunk_files(f, 10, 2), "path", "start", "end") == [("a", 1, 10), ("a", 17, 25), ("a", 9, 18), ("e", 1, 3)]
    assert rt.chunk_files(f, 10, 2, 2).count() == 2
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            rt.chunk_files(f, size, overlap)


def test_dense_ties_zeros_nulls(spark, rows):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0]), (5, None)], "vec_id bigint, embedding array<double>")
    q = spark.createDataFrame([(9, [3.0, 0.0]), (8, None)], "query_id bigint, embedding array<double>")
    assert rows(rt.dense(v, q, 3), "query_id", "vec_id", "rank") == [(9, 1, 1), (9, 2, 2)]
    assert rows(rt.dense(v, q, 3, positive=False), "vec_id", "rank") == [(1, 1), (2, 2), (3, 3)]


@pytest.mark.parametrize(
    "usage, want",
    [
        ({"prompt_tokens": 100, "completion_tokens": 20, "prompt_tokens_details": {"cached_tokens": 30}, "completion_tokens_details": {"reasoning_tokens": 5}}, (70, 20, 30, 0, 5, True)),
        ({"input_tokens": 10, "output_tokens": 4, "cache_read_input_tokens": 3, "cache_creation_input_tokens": 2}, (10, 4, 3, 2, 0, True)),
        ({"input": 10, "output": 4, "reasoning": 6, "cache": {"read": 1, "write": 2}}, (10, 4, 1, 2, 6, False)),
        ({"promptTokenCount": 9, "candidatesTokenCount": 3, "thoughtsTokenCount": 2, "cachedContentTokenCount": 4, "ok": True}, (5, 3, 4, 0, 2, False)),
        ([], (0, 0, 0, 0, 0, True)),
    ],
)
def test_token_usage(spark, usage, want):
    i, o, r, w, x, inside = want
    df = spark.createDataFrame([(1, json.dumps(usage)), (2, json.dumps({"a": [[{"deep": usage}]], "n": True})), (3, "no json"), (4, None)], "id int, usage string")
    got = {r[0]: tuple(r)[1:] for r in stats.token_usage(df, ["id"], "usage").collect()}
    whole = (i, o, r, w, x, i + o + (0 if inside else x))
    assert got == {1: whole, 2: whole, 3: (0,) * 6, 4: (0,) * 6}


def test_subagents_are_a_slice(spark, rows):
    df = spark.createDataFrame([("m", False, '{"input": 5, "output": 2}'), ("m", True, '{"input": 3, "output": 1, "cache": {"read": 2.9}}'), ("n", False, "{}")], "k string, sub boolean, usage string")
    assert rows(stats.usage_totals(df, ["k"], "usage", "sub"), "k", "input", "total", "cache_read", "sub_input", "sub_total", "sub_cache_read") == [("m", 8, 11, 2, 3, 4, 2), ("n", 0, 0, 0, 0, 0, 0)]


def test_files_and_states(spark, rows):
    reads = spark.createDataFrame([("a", 3), ("a", 4), ("b", None), ("c", 1)], "path string, n_lines int")
    assert rows(stats.file_reading(reads, spark.createDataFrame([("a",), ("a",), ("z",)], "path string"))) == [(3, 1, 2, 100 / 3, 200 / 3, 8 / 3)]
    assert rows(stats.file_reading(reads.limit(0), reads)) == [(0, 0, 0, 0.0, 0.0, 0.0)]
    r = spark.createDataFrame([("i", True, None), ("j", False, ""), ("k", False, "boom"), ("l", True, "late")], "instance_id string, resolved boolean, error string")
    assert rows(stats.resolve_states(r)) == [("i", "resolved"), ("j", "unresolved"), ("k", "error"), ("l", "error"), ("l", "resolved")]
    assert rows(stats.resolve_summary(r)) == [(4, 2, 1, 2, 0.5)] and rows(stats.resolve_summary(r.limit(0))) == [(0, 0, 0, 0, 0.0)]


def test_statistics(spark):
    df = spark.createDataFrame([("g", x) for x in (4, 1, 3, 2)] + [("g", None), ("h", 7)], "g string, v int")
    got = {r.g: (r.n, r["median"], r.p95) for r in stats.distribution(df, ["g"], "v").collect()}
    assert got == {"g": (4, 3, 4), "h": (1, 7, 7)}
    for command, want in (("cat a | sed -i s/a/b/ x", "edit"), ("find . -exec rm {}", "execute"), ("sed -n 1p x", "edit"), ("ls || true", "read"), ("", "other"), ("make && cat x", "execute")):
        assert one(spark, stats.command_class(F.col("c")), c=command) == want


def test_bookkeeping(spark, rows):
    r = spark.createDataFrame([("x", 5, 1, "success", 1), ("x", 5, 1, "error", 2), ("x", 10, 1, None, 3), ("x", 5, 2, "success", 4)], "explorer string, top_k int, instance_id int, outcome string, pos int")
    assert rows(runs.latest_rows(r, ["explorer", "top_k", "instance_id"], ["pos"]), "pos") == [(2,), (3,), (4,)]
    cases = spark.createDataFrame([(1,), (2,), (3,)], "instance_id int")
    assert rows(runs.pending_cases(cases, r, 2, ["x"]), "instance_id") == [(2,), (3,)]
    assert runs.identity({"b": 1, "a": 2}) == runs.identity({"a": 2, "b": 1})


@pytest.mark.parametrize(
    "name, secret",
    [(n, True) for n in ("npm_token", "nvidia_api_key", "netlify_secret", "input_token_secret", "access_key", "session_cookie", "tokens", "API-Key", "auth", "AWS_ACCESS_KEY_ID", "Authorization", "db.password")]
    + [(n, False) for n in ("max_token", "maxTokens", "min_keys", "num_tokens", "total_tokens", "count_keys", "limit_token", "oauth", "tokenizer", "author", "keyboard", "", "model")],
)
def test_secret_names(spark, name, secret):
    assert runs.secret_key(name) is secret and one(spark, runs.secret_name(F.col("n")), n=name) is secret


def test_redaction():
    value = {
        "npm_token": "x", "tokens": 4096, "auth": {"user": "u", "deep": [{"n": "v"}, "w"], "max_tokens": "7"}, "env": {"A": 1, "B": {"c": "d"}}, "headers": {"x": None}, "list": [{"token": "x", "name": "y"}],
        "model": "m", "keys": ["a", 1, None], "environment": "plain", "empty": {},
    }
    h = runs.HIDDEN
    assert runs.redact(value) == {
        "npm_token": h, "tokens": 4096, "auth": {"user": h, "deep": [{"n": h}, h], "max_tokens": h}, "env": {"A": h, "B": h}, "headers": {"x": h}, "list": [{"token": h, "name": "y"}],
        "model": "m", "keys": [h, 1, None], "environment": "plain", "empty": {},
    }
    deep = "x"
    for _ in range(5000):
        deep = [deep]
    assert runs.redact({"secret": deep})["secret"] != deep and value["npm_token"] == "x"


def test_normalisers(spark):
    t = "array<struct<role string, content string, tool_calls array<struct<id string, type string, function struct<name string, arguments string>>>, name string, tool_call_id string>>"
    talk = [("user", "x <issue_description> bug </issue_description>", None, "n", "i"), ("assistant", "a", [("1", "function", ("f", "{}"))], "n", "i"), ("tool", "t", None, "n", "i")]
    df = spark.createDataFrame([("o__r-x-7", True, talk, "d", None), ("o__r-8", False, talk, "d", "e")], f"instance_id string, resolved boolean, trajectory {t}, model_patch string, exit_status string")
    r = nz.from_openhands(df).collect()
    assert len(r) == 1 and (r[0].repo, r[0].issue, r[0].rounds, r[0].traj[0].name, r[0].traj[2].tool_call_id) == ("o/r-x", "bug", 3, None, "i")
    s = spark.createDataFrame([("o__r-1", None, [("system", None, "sys"), ("user", "ISSUE:\nit\nINSTRUCTIONS: x", None), ("ai", "```\nopen a.py 3\n```", None), ("ai", "", None)], "p", None)], "instance_id string, model_name string, trajectory array<struct<role string, text string, system_prompt string>>, generated_patch string, exit_status string")
    r = nz.from_swe_agent(s).first()
    assert (r.model, r.issue, r.rounds, len(r.traj), r.traj[2].content) == ("unknown", "it", 1, 3, "```bash\ncat a.py\n```")
    d = spark.createDataFrame([("u_r_x_pr12", [("user", "<uploaded_files>f</uploaded_files> go")], i) for i in range(2)], "data_source string, messages array<struct<role string, content string>>, pos int")
    assert sorted((r.instance_id, r.repo, r.issue) for r in nz.from_distilled(d, "pos").collect()) == [("u_r_x_pr12", "u/r_x", "go"), ("u_r_x_pr12_t1", "u/r_x", "go")]
    assert one(spark, nz.message_text(F.col("c")), c='["a", 1, "b"]') == "a b" and one(spark, nz.message_text(F.col("c")), c="plain") == "plain"


def test_event_errors_and_key_search(spark, rows):
    from tracewright.sources.readers import event_lines

    text = '{"error": {"name": "A", "data": {"message": "x"}}}\n{"error": {"name": "B", "message": "y"}}\n{"error": {"name": "A", "message": "x"}}\n{"type": "text"}\n{"error": null}'
    raw = spark.createDataFrame([("s", text), ("t", None)], "sid string, value string")
    assert rows(ex.event_errors(event_lines(raw, keys=["sid"]), ["sid"])) == [("s", 0, "A: x"), ("s", 1, "B: y")]
    assert stats.find_key({"a": {"k": 1}, "b": [{"k": 2}]}, "k") == 1 and stats.find_key({"a": {"k": 1}, "k": 3}, "k") == 3 and stats.find_key([], "k") is None
