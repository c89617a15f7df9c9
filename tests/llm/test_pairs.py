import pytest

from tracewright.llm.language import language
from tracewright.llm.pairs import copies, defective_replies, diff_defect, lcs, patch_defect, refuses, submission_defect, tokens

ISSUE = "Broken cache: the loader in src/cache.py drops entries when flush() runs twice. It fails on a clean checkout. We saw CacheError at line 12 and nothing else in the log of the nightly build."
DIFF = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +1,2 @@\n def f():\n-    return 1\n+    return 2\n"


def judge(reply, issue=ISSUE):
    return submission_defect(issue, reply, tokens(issue or ""), language(issue) if issue else None)


@pytest.mark.parametrize(
    "reply, defect",
    [
        (None, "empty"), ("", "empty"), ("  \n", "empty"), ("```\n```", "empty"), ("N/A", "empty"), ("<no answer>", "empty"),
        ("Done.", None),
        ("Sorry for the long diff. The guard in src/cache.py was missing.", None),
        ("I can't see the failure without the lock, so the patch adds one.", None),
        ("The cache is unable to hold more than one entry, so flush() now keeps them.", None),
        ("I'm sorry, but I can't help with this change; please ask a maintainer.", "refusal"),
        ("Thanks for the report. I must decline this task. I hope you understand.", "refusal"),
        ("Leider kann ich bei dieser Aufgabe nicht helfen.", "refusal"),
        ("对不起，这项修改我不能处理。", "refusal"),
        (ISSUE, "copied"), ("> " + ISSUE.upper(), "copied"), ("Task: " + "  ".join(ISSUE.split()) + " Please advise.", "copied"),
        ("> Broken cache: the loader in src/cache.py drops entries when flush() runs twice.\n\nThe guard now keeps the lock until the second call is over, so no entry is lost.", None),
        ("The guard now keeps the lock until the sec", "truncated"), ("The guard now keeps the lock until the…", "truncated"), ("It keeps the lock. [cut]", "truncated"),
        ("See below.\n\n```python\ndef f():\n    return", "truncated"),
        ("See below.\n\n```python\nreturn 1\n```", None), ("Fixed.\n\nRELEVANT_FILES:\n- src/cache.py:3-9", None),
        ("Die Änderung in src/cache.py behebt das Problem, ohne die Schnittstelle zu berühren.", "other_language"),
        ("补丁把判断移到 Cache 里面，接口保持不变。", "other_language"),
    ],
)
def test_submissions(reply, defect):
    assert judge(reply) == defect


def test_without_an_issue():
    assert judge("Die Änderung behebt das Problem, ohne die Schnittstelle zu berühren.", None) is None
    assert judge(ISSUE, "") is None


@pytest.mark.parametrize(
    "patch, defect",
    [
        (DIFF, None), (DIFF.rstrip("\n"), None), (DIFF + "\\ No newline at end of file\n", None), (None, "empty"), ("null", "empty"), ("(no changes)", "empty"), ("```diff\n```", "empty"),
        ("diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n", "empty"), (DIFF.replace("return 2", "return 1"), "empty"),
        ("diff --git a/a.py b/b.py\nsimilarity index 100%\nrename from a.py\nrename to b.py\n", None),
        (DIFF[:-14], "truncated"), (DIFF + "diff --git a/y.py b/y.py\n--- a/y", "truncated"), (DIFF + "@@ -7,", "truncated"),
        ("# I am unable to assist with that request.", "refusal"), ("diff --git\nRequest declined.", "refusal"),
        ("+" + ISSUE.replace("\n", "\n+"), "copied"), (ISSUE, "copied"),
    ],
)
def test_patches(patch, defect):
    assert patch_defect(patch, tokens(ISSUE)) == defect


def test_lcs_against_a_table():
    import random

    random.seed(4)
    for _ in range(200):
        a, b = ([random.choice("abc") for _ in range(random.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert lcs(a, b) == table[-1][-1]


def test_long_texts_and_odd_ones():
    long = "word " * 200_000
    assert judge(long) == "truncated" and not copies(tokens(ISSUE), tokens(long)) and not refuses(long)
    assert diff_defect("") == "prose" and judge("\x00\ud800") in ("truncated", None)


def test_rows(spark, rows):
    schema = "traj_id bigint, issue string, submission string, patch string, defect string"
    df = spark.createDataFrame([(1, ISSUE, "Done.", DIFF, "x"), (2, None, None, None, "x"), (2, None, None, None, "x"), (None, ISSUE, "", "", "x"), (3, ISSUE, ISSUE, DIFF, None)], schema)
    assert rows(defective_replies(df)) == [(2, "patch", "empty"), (2, "submission", "empty"), (3, "submission", "copied")]
    assert defective_replies(df.limit(0)).count() == 0
