import random
from collections import defaultdict

from pyspark.sql import functions as F

from tracewright.operators.ordering import running_totals
from tracewright.operators.sweep import read_stretches

SCHEMA = "traj_id bigint, path string, start_line int, end_line int, at string, rank int"


def brute(regions):
    lines = defaultdict(set)
    open_from = {}
    for t, p, s, e in regions:
        s = 1 if not s else s
        if e is None or e == -1:
            open_from[t, p] = min(s, open_from.get((t, p), s))
        else:
            lines[t, p].update(range(s, max(s, e) + 1))
    out = []
    for key in lines.keys() | open_from.keys():
        have, tail = sorted(lines[key]), open_from.get(key)
        if tail:
            have = [x for x in have if x < tail]
        runs = []
        for x in have:
            if runs and x == runs[-1][1] + 1:
                runs[-1][1] = x
            else:
                runs.append([x, x])
        if tail:
            if runs and runs[-1][1] + 1 == tail:
                runs[-1][1] = -1
            else:
                runs.append([tail, -1])
        out += [(*key, "covered", a, b) for a, b in runs]
        out += [(*key, "gap", x[1] + 1, y[0] - 1) for x, y in zip(runs, runs[1:])]
    return sorted(out, key=str)


def test_stretches_equal_line_sets(spark, rows):
    random.seed(1)
    data = []
    for _ in range(600):
        s = random.choice([None, 0, *range(1, 40)])
        e = random.choice([None, -1] + [random.randrange(1, 50)] * 20)
        data.append((random.randrange(3), random.choice("abcd"), s, e))
    df = spark.createDataFrame([(*d, "x", 1) for d in data + data[:50]], SCHEMA)
    assert rows(read_stretches(df)) == brute(data)


def test_stretches_of_odd_rows(spark, rows):
    data = [
        (1, "/repo/src//a.py", 1, 2), (1, "src\\a.py", 3, 4), (1, "./src/x/../a.py", 6, 5), (1, "src/./a.py", -3, -1), (1, None, 1, 2), (1, "", 1, 2),
        (None, "src/a.py", 2, 2), (1, "/etc/a.py", 1, 1), (1, "/repo", 1, 1),
    ]
    df = spark.createDataFrame([(*d, "x", 1) for d in data], SCHEMA)
    assert rows(read_stretches(df)) == sorted(
        [(1, "src/a.py", "covered", 1, 4), (1, "src/a.py", "gap", 5, 5), (1, "src/a.py", "covered", 6, 6), (None, "src/a.py", "covered", 2, 2), (1, "/etc/a.py", "covered", 1, 1)],
        key=str,
    )
    assert read_stretches(df.limit(0)).count() == 0


def test_running_totals_over_a_hot_key(spark):
    random.seed(2)
    data = [(random.choice(["hot"] * 20 + ["b", None, "c"]), i, random.randrange(-3, 4)) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, i int, v int").repartition(7)
    got = {r.i: (r.k, r.n, r.t) for r in running_totals(df, ["k"], ["i"], {"n": F.lit(1), "t": F.col("v")}).collect()}
    seen = defaultdict(lambda: [0, 0])
    for k, i, v in data:
        seen[k][0] += 1
        seen[k][1] += v
        assert got[i] == (k, *seen[k])
    assert running_totals(df.limit(0), ["k"], ["i"], {"n": F.lit(1)}).count() == 0


def test_one_key_over_all_partitions(spark):
    df = spark.range(5000).withColumn("k", F.lit(1))
    assert running_totals(df, ["k"], ["id"], {"n": F.lit(1)}).filter("n <> id + 1").count() == 0
