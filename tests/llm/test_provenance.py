import random

import pytest
from pyspark.sql import functions as F

from tracewright.llm.provenance import CONTAINED, LEAST_LINES, LINE_CHARS, composition, file_classes, foreign_copies

random.seed(9)
NAMES = "cache loader router parser widget token queue socket theme ledger".split()


def code(seed, n=40):
    r = random.Random(seed)
    return "\n".join(f"    {r.choice(NAMES)}_{r.randrange(9999)} = {r.choice(NAMES)}.{r.choice(NAMES)}({r.randrange(9999)}, '{r.choice(NAMES)}')" if i % 4 else f"def {r.choice(NAMES)}_{r.randrange(9999)}(x):" for i in range(n))


MINIFIED = "".join(f"function {random.choice('abc')}(e,o){{return e.{n}?o(e):{i}}}" for i, n in enumerate(NAMES * 20))
BLOB = "DATA = (\n" + "\n".join("    '" + "".join(random.choice("abcXYZ019+/") for _ in range(100)) + "'" for _ in range(30)) + "\n)"
ROWS = "ROWS = [\n" + "\n".join("    [" + ", ".join(f"{random.random() * 99:.4f}" for _ in range(8)) + "]," for _ in range(40)) + "\n]"
TABLE = "\n".join(f"{n.upper()}_{i:03d} = _field({i}, 'x_{n}', {i % 9})" for i, n in enumerate(NAMES * 5))


def test_classes(spark, rows):
    lib = code(1)
    files = {
        ("a", "src/hand.py"): code(2), ("a", "src/build/hand2.py"): code(3), ("a", "src/generator/g.py"): "HEADER = '# DO NOT EDIT, made by our own writer'\n" + code(4),
        ("a", "src/c.py"): "# The caller of this module is generated by x, so keep the names.\n" + code(5), ("a", "docs/generated.md"): "# How the generated files are made\n\ntext " * 30,
        ("a", "src/own.py"): "# Copyright (c) the maintainers of this repository.\n" + code(6),
        ("a", "tests/s.py"): "SAMPLE = '" + "Ab1+" * 40 + "'\n" + code(7, 60), ("a", "src/pad.py"): code(8) + "\n# " + "-" * 4000,
        ("a", "src/head.py"): "# Licensed.\n#\n# Code produced by gen 1.2. Manual changes are lost on the next run.\n" + code(9), ("a", "src/foot.py"): code(10) + "\n# @generated by x",
        ("a", "gen/y.py"): code(11), ("a", "src/z.g.ts"): code(12), ("a", "src/t.py"): TABLE, ("a", "src/m.js"): MINIFIED, ("a", "static/q.min.js"): "x", ("a", "src/b.py"): BLOB, ("a", "src/r.py"): ROWS,
        ("a", "vendor/lib/l.py"): lib, ("b", "src/util/l.py"): lib.replace("cache_", "kache_", 2), ("c", "src/l.py"): "# Vendored from lib, tag v1. Keep in step with upstream.\n" + code(13),
        ("b", "src/hand.py"): code(14), ("b", "src/empty.py"): "", ("b", "src/null.py"): None, ("b", "third_party/null.py"): None,
    }
    data = [(i, repo, path, None if i % 5 == 0 else 1, text, "x") for i, ((repo, path), text) in enumerate(files.items())]
    df = spark.createDataFrame(data + data[:4] + [(99, None, "vendor/x.py", 1, "x", "x"), (98, "a", None, 1, "x", "x")], "chunk_id bigint, repo string, path string, start_line int, content string, file_class string")
    want = {
        ("a", "src/head.py"): "generated", ("a", "src/foot.py"): "generated", ("a", "gen/y.py"): "generated", ("a", "src/z.g.ts"): "generated", ("a", "src/t.py"): "generated",
        ("a", "src/m.js"): "minified", ("a", "static/q.min.js"): "minified", ("a", "src/b.py"): "data_blob", ("a", "src/r.py"): "data_blob",
        ("a", "vendor/lib/l.py"): "vendored", ("b", "src/util/l.py"): "vendored", ("c", "src/l.py"): "vendored", ("b", "third_party/null.py"): "vendored",
    }
    assert rows(file_classes(df)) == sorted([(*k, v) for k, v in want.items()], key=str)
    assert file_classes(df.limit(0)).count() == 0


def test_many_copies_of_one_file(spark):
    lib = code(20)
    data = [(f"r{i}", f"p/{i}.py", 1, lib.replace("\n", f"\n    extra_{i}_value = {i}\n", 1)) for i in range(60)] + [("r0", "own.py", 1, code(21))]
    df = spark.createDataFrame(data, "repo string, path string, start_line int, content string")
    got = {(r.repo, r.path): r.file_class for r in file_classes(df).collect()}
    assert len(got) == 60 and set(got.values()) == {"vendored"}


def test_long_line():
    c = composition("x" * 1_000_000 + "\n" + "[" + "1," * 200_000 + "]")
    assert c["data_chars"] > 300_000


def by_brute_force(files):
    """Files of which one file of another repository holds enough lines, by comparing all pairs."""
    sets = {k: {x.strip() for x in t.split("\n") if len(x.strip()) >= LINE_CHARS} for k, t in files.items() if t}
    found = set()
    for k, own in sets.items():
        if len(own) >= LEAST_LINES and any(o[0] != k[0] and len(own & held) >= CONTAINED * len(own) for o, held in sets.items()):
            found.add(k)
    return found


def copied(spark, files):
    df = spark.createDataFrame([(r, p, 1, t) for (r, p), t in files.items()], "repo string, path string, start_line int, content string")
    ids = df.select("repo", "path", F.xxhash64("repo", "path").alias("file_id"))
    return {(r.repo, r.path) for r in foreign_copies(df).join(ids, "file_id").collect()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    pool = [f"    line_{i} = make_value({i})" for i in range(90)]
    files = {}
    for i in range(120):
        base = r.sample(pool, r.choice([6, 10, 20, 40]))
        own = [f"    own_{i}_{j} = 1" for j in range(r.choice([0, 2, 6, 12]))]
        files[f"r{r.randrange(6)}", f"p{i}.py"] = "\n".join(base + own)
        if i % 4 == 0:  # an edited copy elsewhere
            kept = r.sample(base, int(len(base) * r.choice([0.6, 0.7, 0.8, 1.0])))
            files[f"r{r.randrange(6)}", f"q{i}.py"] = "\n".join(kept + r.sample(pool, r.randrange(4)))
    want = by_brute_force(files)
    assert copied(spark, files) == want and 20 < len(want) < len(files)


def test_fragments_elsewhere_change_nothing(spark):
    lines = [f"    shared_name_{i} = compute_value({i}, 'x')" for i in range(40)]
    files = {("m", "f.py"): "\n".join(lines), ("k", "g.py"): "\n".join(lines)}
    for repo in ("a", "z", "b", "y"):
        for n in range(5):
            files[repo, f"part{n}.py"] = "\n".join(lines[8 * n : 8 * n + 8] + [f"    other_{repo}_{n}_{j} = 2" for j in range(30)])
    assert copied(spark, files) == {("m", "f.py"), ("k", "g.py")} == by_brute_force(files)


def test_a_third_of_all_files_are_alike_but_not_alike_enough(spark):
    r = random.Random(3)
    lines = [f"    common_name_{i} = compute_value({i}, 'x')" for i in range(40)]
    files = {(f"r{i}", "a.py"): "\n".join(r.sample(lines, 33) + [f"    own_{i}_{j} = 3" for j in range(8)]) for i in range(60)}
    assert copied(spark, files) == by_brute_force(files)


def test_files_of_few_lines_and_one_repository(spark):
    few = "\n".join(f"    name_{i} = compute({i})" for i in range(LEAST_LINES - 1))
    own = "\n".join(f"    value_{i} = compute({i})" for i in range(20))
    assert copied(spark, {("a", "x"): few, ("b", "y"): few, ("c", "x"): own, ("c", "y"): own}) == set()
