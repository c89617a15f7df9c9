import random

import pytest

from tracewright.llm.endings import ending
from tracewright.llm.leaks import build_index, edit_distances, leaked_items, matches, words
from tracewright.llm.truncation import cut_documents, cut_share

VOCABULARY = [f"w{i}" for i in range(60)]


def windows(text, n=13):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_equals_brute_force(spark):
    random.seed(7)
    say = lambda n: " ".join(random.choice(VOCABULARY) for _ in range(n))
    items = [(i, say(40)) for i in range(20)] + [(50, "too short"), (51, None), (None, say(20))]
    docs = []
    for d in range(120):
        item = items[d % 20][1].split()
        n, at = random.choice([12, 13, 14, 30]), random.randrange(8)
        part = item[at : at + n]
        look = random.choice([" ".join, lambda w: " ".join(w).upper(), lambda w: "*" + ",\n> ".join(w) + "*", lambda w: "_".join(w)])
        docs.append((d, say(30) + " . " + look(part) + " ; " + say(5), 1))
    docs += [(500, None, 1), (None, items[0][1], 1), docs[0], (501, "", 1), (502, "x " * 300_000, 1)]
    truth = {(d, i) for d, t, _ in docs for i, s in items if None not in (d, t, i, s) and windows(t) & windows(s)}
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int"), spark.createDataFrame(items, "item_id bigint, text string")
    got = [(r.doc_id, r.item_id) for r in leaked_items(df, it).collect()]
    assert set(got) == truth and len(got) == len(truth) > 50
    assert {(r.doc_id, r.item_id) for r in leaked_items(df, it, block_bytes=12_000).collect()} == truth
    assert leaked_items(df.limit(0), it).count() == 0 and leaked_items(df, it.limit(0)).count() == 0


def test_recall_with_edits():
    random.seed(8)
    big = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(random.choice(big) for _ in range(30))) for i in range(150)]
    texts = []
    for _, t in items:
        w = t.split()[:13]
        at = random.randrange(13)
        w[at : at + 1] = random.choice([[], ["zz"], [w[at], "zz"]])
        texts.append("q " * 20 + " ".join(w[:13]) + " q" * 20)
    found = {i for d, i in matches(texts, build_index(items, 13, 2, 0.95)) if d == i}
    assert len(found) >= 0.9 * len(items)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_edit_distances():
    import numpy as np

    r = random.Random(2)
    a, b = (np.array([[r.randrange(4) for _ in range(9)] for _ in range(300)]) for _ in range(2))
    for most in (0, 1, 2, 5, 9):
        told = [min(plain_distance(x, y), most + 1) for x, y in zip(a.tolist(), b.tolist())]
        assert [min(d, most + 1) for d in edit_distances(a, b, most)] == told


@pytest.mark.parametrize("width", [13, 26])
def test_near_windows_of_documents_against_brute_force(spark, width):
    """Recall over real documents with edited passages, counted against all pairs of windows."""
    d = "/root/testdata/sf0.001"
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/eval_items.parquet").limit(40).collect()]
    docs = [r.text for r in spark.read.parquet(f"{d}/documents.parquet").filter("length(text) between 100 and 1500").limit(60).collect()]
    r = random.Random(width)
    data = []
    for n, text in enumerate(docs):
        w = r.choice(items)[1].split()[: width + 6]
        for _ in range(r.choice([1, 2])):
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice([[], ["zz"], [w[at], "zz"]])
        data.append((n, text[:300] + "\n" + " ".join(w) + "\n" + text[300:]))
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    it = spark.createDataFrame(items, "item_id bigint, text string")
    grams = lambda t: [tuple(x) for x in (words(t)[i : i + width] for i in range(len(words(t)) - width + 1))]
    truth = set()
    per_item = {i: set(grams(t)) for i, t in items}
    for n, text in data:
        own = set(grams(text))
        for i, held in per_item.items():
            for g in own:
                counts = set(g)
                if any(len(counts & set(h)) >= width // 2 and sum(x in h for x in g) >= width - 2 and plain_distance(g, h) <= 2 for h in held):
                    truth.add((n, i))
                    break
    got = {(x.doc_id, x.item_id) for x in leaked_items(df, it, width, 2, 0.95).collect()}
    assert got <= truth and len(truth) > 25 and len(got) >= 0.9 * len(truth)


def test_too_few_repetitions_are_told(spark):
    text = " ".join(f"u{i}" for i in range(40))
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    with pytest.warns(UserWarning, match="repetitions reach a recall"):
        leaked_items(df, df.withColumnRenamed("doc_id", "item_id"), 13, 6, 0.99, most_repeats=1)


@pytest.mark.parametrize(
    "text, state",
    [
        ("It works.", "whole"), ("It works!\n", "whole"), ("它可以工作。", "whole"), ('He said "yes."', "whole"), ("It wor", "loose"), ("It works…", "loose"), ("It works [truncated]", "cut"),
        ("It works <cut>", "cut"), ("It works (message shortened)", "cut"), ("So:\n```\nx = 1\n```", "whole"), ("So:\n```python\nx = 1", "cut"), ("So:\n```\nx.", "cut"),
        ("It works.\n\nCheers,\nstale chunk", "whole"), ("Fix it.\n\nReviewed-by: a-b", "whole"), ("Fix.\n\nSee also docs/a/b.py", "whole"), ("Fix.\n\nSee also docs/a/b", "loose"),
        ("FILES:\n- a/b.py:1-9\n- c/d.ts:3-7", "whole"), ("FILES:\n- a/b.py:1-9\n- c/d.ts:30-7", "cut"), ("FILES:\n- a/b.py:1-9\n- c/d.ts:3", "cut"),
        ("ok\nexit status 1", "whole"), ("ok\n== 3 passed, 1 failed in 2.5s ==", "whole"), ("== 3 passed, 1 fai", "loose"), ("2024-01-02 10:00 INFO a.b It works.", "log"), ("2024-01-02 10:00 INFO a.b It wo", "cut"),
        ("see `foo", "cut"), ("and the file src/a/b.py", "cut"), ("broken �", "cut"),
    ],
)
def test_endings(text, state):
    assert ending(text) == state


def test_source_baseline(spark, rows):
    schema = "doc_id bigint, text string, source string, cut int"
    sign = [(i, f"Text number {i} is fine.\n\nI will look again tomorrow...", "a", 1) for i in range(10)]
    copies = [(100 + i, "One story.\n\nIt was cut at the...", "a", 1) for i in range(10)]
    logs = [(200 + i, f"2024-01-02 10:00 INFO x.y Step {i} is over.\nexit status 0", "l", 1) for i in range(5)] + [(210, "2024-01-02 10:00 INFO x.y Step is over.", "l", 1)]
    odd = [(300, None, "a", 1), (301, "  \n", None, 1), (None, "cut he", "a", 1), (302, "ends he", None, 1), (302, "ends he", None, 1), (303, "x" * 2_000_000, "a", 1), (304, "Good.", None, 1)]
    df = spark.createDataFrame(sign + copies + logs + odd, schema)
    assert [r[0] for r in rows(cut_documents(df))] == [*range(100, 110), 210, 302, 303]
    share = {r[0]: r[1:] for r in rows(cut_share(df))}
    assert share["a"] == (21, 11, round(11 / 21, 6)) and share[None] == (2, 1, 0.5) and share["l"] == (6, 1, round(1 / 6, 6))
    assert cut_documents(df.limit(0)).count() == 0
