import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import contexts, entities, patches
from tracewright.operators import extract as ex
from tracewright.operators import normalize as nz


def diff(path, head, old="old", new="new"):
    return f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ {head} @@\n-{old}\n+{new}\n"


def test_hunks(spark, rows):
    two = diff("a.py", "-4,2 +4") + "@@ -9,0 +9,3 @@ def f():\n+x\n" + diff("b c.py", "-1 +1")
    plain = "--- a/z.py\n+++ b/z.py\n@@ -7,3 +7,3 @@\n a\n-b\n+c\n"
    gone = "diff --git a/g.py b/g.py\ndeleted file mode 100644\n--- a/g.py\n+++ /dev/null\n@@ -1,5 +0,0 @@\n-x\n"
    df = spark.createDataFrame([(1, two), (2, plain), (3, gone), (4, None), (5, "no diff @@ -1 +1 @@")], "i int, patch string")
    want = [(1, "a.py", 0, 4, 5), (1, "a.py", 1, 9, 9), (1, "b c.py", 0, 1, 1), (2, "z.py", 0, 7, 9), (3, "g.py", 0, 1, 5)]
    assert rows(patches.hunks(df, ["i"], "patch")) == want
    assert patches.hunks(df.limit(0), ["i"], "patch").count() == 0


def diagnosed(spark, text, regions, status="Submitted", prediction="", **more):
    runs = spark.createDataFrame([("i", status, prediction)], "instance_id string, exit_status string, prediction string")
    texts = spark.createDataFrame([("i", "info.submission", text)], "instance_id string, source string, text string")
    allowed = spark.createDataFrame([("i", *r) for r in regions], "instance_id string, path string, s bigint, e bigint, n_lines bigint")
    return tuple(patches.diagnoses(runs, texts, allowed, **more).first())[1:]


@pytest.mark.parametrize(
    "text, regions, more, want",
    [
        ("", [], {"status": "LimitsExceeded"}, (False, None, None, None, "no_diff_limits_exceeded")), (None, [], {}, (False, None, None, None, "no_diff")),
        ("diff --git a/x b/x\nno hunk at all\n", [], {}, (True, None, None, None, "extraction_failed")),
        (diff("bar.py", "-1 +1"), [("foo.py", 1, 2, 2)], {}, (True, "info.submission", "file_outside_allowed_files", None, "file_outside")),
        (diff("foo.py", "-4 +4"), [("foo.py", 1, 2, 2)], {}, (True, "info.submission", "pass", "file_allowed_but_region_outside", "region_outside")),
        (diff("foo.py", "-3 +3"), [("foo.py", 1, -1, 3)], {}, (True, "info.submission", "pass", "fully_within_allowed_regions", "within_allowed_but_lost")),
        (diff("foo.py", "-20 +20"), [("foo.py", 1, 2, 2)], {"mode": "file_level_allow"}, (True, "info.submission", "pass", "file_level_allow_allows_any_line", "within_allowed_but_lost")),
        (diff("foo.py", "-4 +4"), [("foo.py", 1, 2, 2)], {"mode": "span_padding", "padding": 2}, (True, "info.submission", "pass", "fully_within_allowed_regions", "within_allowed_but_lost")),
        ("Wrote it.\n" + diff("foo.py", "-1 +1"), [("foo.py", 1, 2, 2)], {"prediction": "diff"}, (True, "info.submission", "pass", "fully_within_allowed_regions", None)),
    ],
)
def test_diagnoses(spark, text, regions, more, want):
    assert diagnosed(spark, text, regions, **more) == want


def test_candidates_and_allowed_lines(spark, rows):
    d = diff("foo.py", "-1 +1")
    texts = spark.createDataFrame([("i", "tool.content", f"<output>\n{d}\n</output>"), ("i", "info.submission", d), ("i", "other", d * 2), ("j", "tool.content", "none")], "instance_id string, source string, text string")
    found = patches.candidates(texts)
    assert rows(found, "source", "whole") == [("info.submission", True), ("other", True), ("tool.content", True)]
    assert rows(patches.best_candidate(found)) == [("i", "info.submission", d)]
    r = spark.createDataFrame([("i", "f", 10, 12, 3), ("i", "f", 14, 15, 2)], "instance_id string, path string, s bigint, e bigint, n_lines bigint")
    assert rows(patches.allowed_lines(r), "s", "e") == [(10, 12), (14, 15)] and rows(patches.allowed_lines(r, "span_padding", 2), "s", "e") == [(8, 17)]
    with pytest.raises(ValueError):
        patches.allowed_lines(r, "nothing")


def test_repair_and_text_columns(spark):
    broken = "diff --git a/f b/f  \n--- a/f\n+++ b/f\n@@ -1,9 +1,9 @@\n a\n\n-b\n+c\nbare  \n"
    assert patches.repaired(broken) == "diff --git a/f b/f\n--- a/f\n+++ b/f\n@@ -1,4 +1,4 @@\n a\n \n-b\n+c\n bare\n"
    assert patches.repaired(None) is None and patches.repaired(" ") == " "
    df = spark.createDataFrame([(1, 'x {bad\n{"b": 1, "a": [2]} y'), (2, None), (3, '["t1", 2]'), (4, "```diff\n--- a/f\n+++ b/f\n@@ -1 +1 @@\n-a\n+b\n```")], "i int, t string")
    got = df.select("i", patches.json_object_in(F.col("t")), patches.test_names(F.col("t")), patches.diff_of(F.col("t")), patches.repaired_patch(F.col("t"))).orderBy("i").collect()
    assert got[0][1] == '{"a": [2], "b": 1}' and got[1][1] is None and got[2][2] == ["t1", "2"] and got[1][2] == [] and got[3][3].startswith("--- a/f") and got[1][4] is None


SOURCE = "class A:\n    def f(self):\n        pass\n\n    async def g(self):\n        return 1\n\ndef f():\n    return 2\n"


def test_entities_and_answers(spark, rows):
    files = spark.createDataFrame([("r", "src/a.py", SOURCE), ("r", "src/a.py", SOURCE), ("r", "b.py", "def ("), ("r", "c.ts", SOURCE), ("r", "d.py", None)], "repo string, path string, text string")
    e = entities.entity_table(files)
    assert rows(e, "name", "s", "e") == [("A", 1, 6), ("A.f", 2, 3), ("A.g", 5, 6), ("f", 8, 9), ("g", 5, 6)]

    def answers(*values):
        return spark.createDataFrame([(f"i{n}", "r", v if isinstance(v, (str, type(None))) else json.dumps(v)) for n, v in enumerate(values)], "instance_id string, repo string, answer string")

    listed = answers([{"rel_file_path": "./src/a.py", "start": 3, "end": 0}, {"rel_file_path": ""}, {"rel_file_path": "b.py", "end": 9}], {"no": 1}, "cut [", None)
    assert rows(entities.listed_locations(listed)) == [("i0", 0, "src/a.py", 3, -1), ("i0", 2, "b.py", 1, 9)]
    bugs = answers({"bug_locations": [{"file_path": "src/a.py", "line_range": "[4, 7]"}, {"file_path": "src/a.py", "class_name": "A", "method_name": "g", "line_range": "?"}, {"file_path": "z.py"}, {"file_path": "z.py", "line_range": "x"}]}, {})
    assert rows(entities.bug_locations(bugs, e)) == [("i0", 0, "src/a.py", 4, 7), ("i0", 1, "src/a.py", 5, 6), ("i0", 2, "z.py", 1, -1), ("i0", 3, "z.py", 1, -1)]
    related = answers({"found_related_locs": {"src/a.py": ["A.f", "none"]}, "found_files": ["q.py"]}, {"found_related_locs": {}, "found_files": ["/q.py"]}, [])
    assert rows(entities.related_locations(related, e)) == [("i0", 0, "src/a.py", 2, 3), ("i0", 1, "src/a.py", 1, -1), ("i1", 0, "q.py", 1, -1)]
    found = answers({"found_entities": [["src/a.py:A"], ["src/a.py:x"]], "found_files": ["no"]}, {"found_entities": [], "raw_output_loc": ["`src/a.py: f`\n# c.py:g\nsrc/a.py:f\nnote: two words\n"]}, {"found_entities": [], "found_files": [["m.py"]]})
    assert rows(entities.found_entities(found, e)) == [("i0", 0, "src/a.py", 1, 6), ("i0", 1, "src/a.py", 1, -1), ("i1", 0, "src/a.py", 8, 9), ("i2", 0, "m.py", 1, -1)]


def test_context_records(spark, rows):
    cols = "instance_id string, repo string, path string, s bigint, e bigint"
    core = spark.createDataFrame([("i", "r", "a", 1, 2), ("i", "r", "a", 1, 2), ("j", "r", "a", 1, 1), ("k", "r", "none", 1, 1), ("l", "r", "a", 1, 1)], cols)
    optional = spark.createDataFrame([("i", "r", "a", 3, -1), ("i", "r", "none", 1, 1)], cols)
    issues = spark.createDataFrame([("i", "bug", 1), ("j", " ", 1), ("k", "bug", 1), ("l", "other", 1)], "instance_id string, issue string, extra int")
    files = spark.createDataFrame([("r", "a", ["x", "y", "z"])], "repo string, path string, lines array<string>")
    got = contexts.context_records(core, optional, issues, core.select("instance_id", "path"), files).orderBy("instance_id").collect()
    assert [(r.instance_id, r.issue, [tuple(c) for c in r.core], [tuple(c) for c in r.optional], r.modified_files) for r in got] == [
        ("i", "bug", [("a", 1, 2, "x\ny")], [("a", 3, -1, "z")], ["a"]), ("l", "other", [("a", 1, 1, "x")], [], ["a"]),
    ]


def test_selection_and_explorer_regions(spark, rows):
    t = spark.createDataFrame([(1, "i", "gpt-x", "o/r"), (2, "i", "gpt-y", "o/r"), (3, "j", "gpt-x", "o/q"), (4, "j", None, "o/q"), (5, None, "gpt", None)], "traj_id int, instance_id string, model string, repo string")
    ids = lambda **kw: [r[0] for r in rows(contexts.selected_groups(t, **kw), "traj_id")]
    assert ids() == [1, 2, 3, 4, 5] and ids(model="x$") == [1, 3] and ids(model="gpt", least=2) == [1, 2] and ids(repo="/q", instance="j") == [3, 4] and ids(least=3) == []
    r = spark.createDataFrame([("i", 1, [("a", 1, 2)]), ("i", 2, [("b", 3, 4), ("c", 1, -1)]), ("j", 1, [("a", 1, 1)]), ("j", 5, [])], "instance_id string, pos int, regions array<struct<path:string,s:bigint,e:bigint>>")
    assert rows(contexts.explorer_regions(r)) == [("i", 0, "b", 3, 4), ("i", 1, "c", 1, -1)]


def test_reads_by_step(spark, rows):
    call = "array<struct<id string, type string, function struct<name string, arguments string>>>"
    bash = lambda c: f"I look.\n```bash\n{c}\n```"
    tool = lambda n, a: [("c", "function", (n, json.dumps(a)))]
    talk = [
        ("user", "go", None), ("assistant", bash("cat a.py && grep -n x src/"), None), ("user", "src/b.py:3:x\nsrc/b.py:3:x\nsrc/c.py:9-x", None), ("assistant", bash("grep -rn y lib/z 'k.py' -i"), None),
        ("user", "nothing", None), ("assistant", bash("rg y src/"), None), ("user", "", None), ("assistant", "", tool("execute_bash", {"command": "head -n 5 d.py"})), ("tool", "x", None),
        ("assistant", None, tool("str_replace_editor", {"command": "view", "path": "e.py", "view_range": [2, 4]})), ("assistant", bash("tail -n 3 f.md; grep q g.py"), None),
    ]
    df = spark.createDataFrame([(1, i, r, c, t) for i, (r, c, t) in enumerate(talk)], f"traj_id int, step_idx int, role string, content string, tool_calls {call}")
    assert rows(ex.reads_by_step(df), "step_idx", "path", "s", "e") == [
        (1, "a.py", 1, -1), (1, "src/b.py", 3, 3), (1, "src/c.py", 9, 9), (10, "f.md", -3, -1), (10, "g.py", 1, -1), (3, "k.py", 1, -1), (3, "lib/z", 1, -1), (7, "d.py", 1, 5), (9, "e.py", 2, 4),
    ]
    assert rows(ex.logged_commands(df), "command_no", "command")[:2] == [(0, "cat a.py && grep -n x src/"), (1, "grep -rn y lib/z 'k.py' -i")]
    one = lambda c: spark.createDataFrame([(c,)], "c string").select(ex.logged_paths(F.col("c"))).first()[0]
    assert one("vim 'b/a.PY' a/x.py a/x.py -f/x.py > c/d.log plain.py /path/to/e.py a/dir") == ["a/x.py", "b/a.PY", "c/d.log"] and one("") == [] == one(None)


def test_formats_nobody_called(spark):
    talk = [("user", "<uploaded_files>f</uploaded_files> go"), ("assistant", "a")]
    m = "array<struct<role string, content string>>"
    s = spark.createDataFrame([("o__r-1", 1.0, talk, "p"), ("o__r-2", 0.5, talk, "p")], f"instance_id string, score double, messages {m}, patch string")
    assert [(r.instance_id, r.repo, r.issue, r.answer, r.rounds) for r in nz.from_scaleswe(s).collect()] == [("o__r-1", "o/r", "go", "p", 2)]
    c = spark.createDataFrame([("t1", 1.0, json.dumps([{"role": "user", "content": "fix"}, {"role": "tool", "content": "x", "tool_call_id": "7"}]), "", "", "hub/o.r:v1"), ("t2", -1.0, "[]", "b", "o/r", "i")], "trajectory_id string, reward double, messages string, base_id string, derived_repo string, image string")
    assert [(r.instance_id, r.repo, r.issue, r.traj[1].tool_call_id) for r in nz.from_coderforge(c).collect()] == [("t1", "o.r", "fix", "7")]
    n = spark.createDataFrame([("/x/o__r-9/t.json", {"model": "m", "extra": "e", "submission": "d"}, [("user", "<pr_description> bug </pr_description>")])], f"path string, info map<string,string>, messages {m}")
    r = nz.from_native(n).first()
    assert (r.instance_id, r.repo, r.model, r.issue, r.submission, r.meta) == ("o__r-9", "o/r", "m", "bug", "d", {"extra": "e"})
    a = spark.createDataFrame([('{"k": 1}',), ("[1]",), ("{cut",)], "a string").select(nz.arguments_of(F.col("a")).cast("string"))
    assert [r[0] for r in a.collect()] == ['{"k":1}', "{}", "{}"]
    p = spark.range(1).select(nz.prompt_text(F.lit("bug"), F.array(F.lit("a"), F.lit("b")), F.lit(""))).first()[0]
    assert p == "## Issue\nbug\n\n## Files\na\nb"


def test_extraction_nobody_called(spark, rows):
    from tracewright.operators import runs

    ops = spark.createDataFrame([(1, "sed -i s/a/b/ src/a.py > out/log.txt"), (2, "cat src/a.py"), (3, "vim 'x/b.py'"), (4, None)], "i int, c string")
    assert rows(ex.file_operations(ops, ["i"], "c")) == [(1, "out/log.txt"), (1, "src/a.py"), (3, "x/b.py")]
    roots = spark.createDataFrame([("k", 2, "/workspace/b/x"), ("k", 1, "/workspace/a/y"), ("l", 1, "src/z")], "k string, n int, path string")
    assert rows(ex.repo_root(roots, "k", ["n"])) == [("k", "/workspace/a")]
    m = spark.createDataFrame([(1, 1, "diff --git a/x b/x\nold"), (1, 2, "Done: diff --git a/y b/y\nnew"), (1, 3, "bye"), (2, 1, None)], "traj_id int, step_idx int, content string")
    assert rows(ex.submitted_patch(m)) == [(1, "diff --git a/y b/y\nnew")]
    o = spark.createDataFrame([(0, True, False, False), (127, False, False, False), (1, False, True, False), (1, False, False, False), (0, False, False, False), (1, False, True, True)], "return_code int, timed_out boolean, has_errors boolean, has_answer boolean")
    assert [r[0] for r in o.select(runs.outcome_of()).collect()] == ["timeout", "binary_not_found", "provider_error", "error", "invalid_output", "success"]


def test_new_rows_once_within_the_watermark(spark, rows, tmp_path):
    from tracewright.streaming import events as ev

    data = [(i % 3, f"2024-01-01 00:0{i}:00") for i in range(6)]
    spark.createDataFrame(data, "k int, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, ts timestamp").parquet(str(tmp_path / "in"))
    q = ev.new_rows(stream, ["k"], "ts").writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("fresh"), "k") == [(0,), (1,), (2,)]
