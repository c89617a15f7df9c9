import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import intervals as iv
from tracewright.operators.metrics import Scoring, at_budgets

I = "k bigint, path string, s bigint, e bigint"  # noqa: E741


def lines(rows):
    return {(k, p, x) for k, p, s, e in rows if s >= 0 for x in range(s, e + 1)}


@pytest.fixture(scope="module")
def sides(spark):
    random.seed(3)
    make = lambda n: [(random.randrange(4), random.choice("ab"), s, s + random.randrange(8)) for s in (random.randrange(1, 40) for _ in range(n))]
    a, b = make(120), make(60)
    return a, b, spark.createDataFrame(a + a[:9], I), spark.createDataFrame(b, I)


def test_algebra_on_line_sets(sides):
    a, b, da, db = sides
    keys = ["k", "path"]
    out = lambda df: [tuple(r) for r in df.select("k", "path", "s", "e").collect()]
    merged = out(iv.merge(da, keys))
    assert lines(merged) == lines(a) and sorted(out(iv.merge(iv.merge(da, keys), keys))) == sorted(merged)
    starts = {(k, p, s) for k, p, s, _ in merged}
    assert not any((k, p, e + 1) in starts for k, p, _, e in merged)
    both, less = out(iv.intersect(da, db, keys)), out(iv.minus(da, db, keys))
    assert lines(both) == lines(a) & lines(b) and lines(less) == lines(a) - lines(b)


def test_tails_and_empty_members(spark, rows):
    schema = "instance_id bigint, traj_id bigint, path string, s bigint, e bigint"
    reads = spark.createDataFrame([(1, 1, "a", 1, 5), (1, 2, "a", 3, 9), (1, 2, "a", -4, -1), (2, 1, "a", -4, -1), (2, 1, "a", 2, 2), (3, 1, "a", 1, 9)], schema)
    members = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1), (3, 2)], "instance_id bigint, traj_id bigint")
    got = rows(iv.intersect_all(reads, ["instance_id"], "traj_id", members))
    assert got == [(1, "a", 3, 5), (2, "a", -4, -1), (2, "a", 2, 2)]
    assert iv.merge(reads.limit(0), ["instance_id", "path"]).count() == 0


def test_concrete_and_resolve(spark, rows):
    df = spark.createDataFrame([(1, None, None), (2, 0, -1), (3, 9, 4), (4, -8, -1)], "id int, a bigint, b bigint")
    s, e = iv.concrete(F.col("a"), F.col("b"))
    assert rows(df.select("id", s, e)) == [(1, 1, iv.EOF), (2, 1, iv.EOF), (3, 9, 9), (4, -8, -1)]
    regions = spark.createDataFrame([(1, "f", 5, -1), (2, "f", -3, -1), (3, "f", 5, 99), (4, "g", 1, -1), (5, "f", 0, 0), (6, "f", 50, -1)], "id int, path string, s bigint, e bigint")
    files = spark.createDataFrame([("f", 10)], "path string, n_lines int")
    assert rows(iv.resolve(regions, files), "id", "rs", "re") == [(1, 5, 10), (2, 8, 10), (3, 5, 99), (4, None, None), (5, None, None), (6, 10, 10)]


def test_scores_by_hand(spark):
    preds = spark.createDataFrame([("c", 0, "x", 1, 4), ("c", 1, "a", 3, 6), ("c", 2, "a", 5, 4), ("c", 3, "z", 1, -1), ("e", 0, "a", 1, 2)], "instance_id string, rank int, path string, s bigint, e bigint")
    core = spark.createDataFrame([("c", "a", 5, 8), ("c", "b", 1, 2), ("d", "a", 1, 1), ("e", "a", 1, 2)], "instance_id string, path string, s bigint, e bigint")
    optional = spark.createDataFrame([("c", "a", 3, 3)], "instance_id string, path string, s bigint, e bigint")
    main = spark.createDataFrame([("c", "a")], "instance_id string, path string")
    files = spark.createDataFrame([("a", 20)], "path string, n_lines int")
    got = {r.instance_id: r for r in Scoring(preds, core, optional, main, files).all_metrics().collect()}
    c, d, e = got["c"], got["d"], got["e"]
    assert (c.precision, c.recall, c.context_efficiency, c.optional_coverage) == (2 / 8, 2 / 6, 3 / 8, 1.0)
    assert (c.hit_file_rate, c.noise_file_rate, c.hit_region_rate, c.noise_region_rate) == (0.5, 2 / 3, 0.5, 0.75)
    assert c.first_useful_hit == 0.75 and abs(c.weighted_core_coverage - (3 * 0.5) / 5) < 1e-12 and c.recall_at_100 == 2 / 6
    assert all(v == 0 for k, v in d.asDict().items() if k != "instance_id")
    assert all(v == (0 if k in ("noise_file_rate", "noise_region_rate", "optional_coverage") else 1) for k, v in e.asDict().items() if k != "instance_id")
    assert at_budgets(preds, [1, 2]).count() == 2 + 3


def test_context_windows(spark, rows):
    m = spark.createDataFrame([(1, i, r, "x" * 30) for i, r in enumerate(["user", "assistant", "tool", "system", "assistant", "tool"])], "traj_id int, step_idx int, role string, content string")
    steps = spark.createDataFrame([(1, 2), (1, 2)], "traj_id int, step_idx int")
    assert rows(iv.context_windows(m, steps, 1, most=5)) == [(1, 1, "assistant", "xxxxx", 0), (1, 2, "tool", "xxxxx", 1)]
    assert iv.last_messages(m, 2).count() == 2
