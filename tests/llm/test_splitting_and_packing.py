import random

import pytest

from tracewright.llm.packing import pack, plan, token_counts
from tracewright.llm.splitting import cut_kinds, pieces, split_oversized


@pytest.mark.parametrize("seed", range(4))
def test_pieces(seed):
    random.seed(seed)
    for _ in range(800):
        size = random.choice([5, 8, 12, 20])
        overlap = random.randrange(size)
        text = "".join(random.choice("ab\n") if random.random() < 0.7 else random.choice("cdéf😀gh") for _ in range(random.randrange(1, 120)))
        found = pieces(text, size, overlap)
        assert found[0][0] == 0 and found[-1][1] == len(text)
        for i, (s, e, a, b, kind) in enumerate(found):
            assert 0 < e - s <= size and a == text[:s].count("\n") + 1 and b == text[: e - 1].count("\n") + 1
            assert kind == "inside" or e == len(text) or text[e - 1] == "\n" or text[e] == "\n"
            if i:
                before = found[i - 1][1]
                assert before - overlap <= s <= before < e
        assert any(f[4] == "inside" for f in found) == (max(map(len, text.split("\n"))) > size)


def test_greedy_equals_one_cut_after_the_other():
    text = "".join("x" * random.Random(i).randrange(60) + "\n" for i in range(400))
    ends = [i + 1 for i, c in enumerate(text) if c == "\n"]
    cuts, start = [], 0
    while not cuts or cuts[-1] < len(text):
        cuts.append(max(e for e in ends if e <= start + 200))
        start = next((e for e in [0, *ends] if cuts[-1] - 30 <= e < cuts[-1]), cuts[-1] - 30)
    assert [p[1] for p in pieces(text, 200, 30)] == cuts


def test_split_rows(spark, rows):
    schema = "chunk_id bigint, content string, piece string"
    data = [(1, "a" * 6000, "x"), (2, "a" * 6001, "x"), (2, "a" * 6001, "x"), (3, "a\n" * 4000, None), (4, None, "x"), (None, "b" * 7000, "x"), (5, "", "x"), (6, "é" * 5999 + "\n" + "b", "x"), (7, "z" * 3_000_000, "x")]
    df = spark.createDataFrame(data, schema)
    assert rows(cut_kinds(df)) == [(2, "inside"), (3, "line"), (6, "line"), (7, "inside")]
    assert split_oversized(df).filter("length(piece) > 6000 or length(piece) <> end_char - start_char").count() == 0
    assert split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, size=10, overlap=10)


def test_plan_loses_nothing():
    random.seed(5)
    for _ in range(200):
        capacity = random.choice([10, 30, 100])
        counts = {s: random.randrange(30) for s in random.sample(range(1, capacity + 1), random.randrange(1, capacity))}
        runs, n = plan(counts, capacity)
        load, placed = {}, set()
        for size, lo, hi, first, each in runs:
            for r in range(lo, hi + 1):
                c = first + (r - lo) // each
                load[c] = load.get(c, 0) + size
                assert (size, r) not in placed
                placed.add((size, r))
        assert len(placed) == sum(counts.values()) and set(load) == set(range(n)) and max(load.values(), default=0) <= capacity


def test_pack_rows(spark):
    random.seed(6)
    data = [(i, random.choice([1, 7, 700, 900, 1500, 2048, 2049, 5000]) if i % 3 else 64, "x") for i in range(500)] + [(900, 0, "x"), (901, None, "x")]
    df = spark.createDataFrame(data, "doc_id bigint, n_tokens bigint, container_id string")
    out = pack(df).collect()
    load, per_doc = {}, {}
    for r in out:
        load[r.container_id] = load.get(r.container_id, 0) + r.n_tokens
        per_doc.setdefault(r.doc_id, []).append((r.piece_no, r.first_token, r.n_tokens))
    assert max(load.values()) <= 2048
    for doc, n, _ in data:
        if n:
            parts = sorted(per_doc[doc])
            assert sum(p[2] for p in parts) == n and (len(parts) == 1 or n > 2048)
            assert [p[1] for p in parts] == [2048 * i for i in range(len(parts))]
        else:
            assert doc not in per_doc
    gaps = []  # first fit, largest first
    for n in sorted((r.n_tokens for r in out), reverse=True):
        at = next((i for i, g in enumerate(gaps) if g >= n), None)
        if at is None:
            gaps.append(2048 - n)
        else:
            gaps[at] -= n
    assert len(load) <= len(gaps)
    assert pack(df.limit(0)).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (1, "Hello world"), (2, " \n"), (3, None), (None, "x"), (4, "<|endoftext|>")], "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(df).collect()}
    assert got[1] == 2 and set(got) == {1, 4} and got[4] > 1
