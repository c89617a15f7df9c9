import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracewright.sources import readers, sinks
from tracewright.streaming import events as ev

ROOT = Path(__file__).resolve().parent.parent


def test_readers_and_sinks(spark, rows, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": 1, "x": "é"}\n\nnot json\n[1]\n{"id": 2}\n', encoding="utf-8")
    with pytest.raises(Exception, match="MALFORMED"):
        readers.json_lines(spark, str(p), "id int, x string").collect()
    good = tmp_path / "good.jsonl"
    good.write_text('{"id": 1, "x": "é"}\n\n  \n{"id": 2}\n', encoding="utf-8")
    assert rows(readers.json_lines(spark, str(good), "id int, x string")) == [(1, "é"), (2, None)]
    with pytest.raises(Exception, match="blank line"):
        readers.json_lines(spark, str(good), "id int, x string", strict=True).collect()
    contexts = tmp_path / "c.jsonl"
    contexts.write_text('{"instance_id": "i", "issue": "old"}\n\n{"instance_id": "i", "issue": "new", "conversation": "talk"}\n{"instance_id": "j"}\n{"issue": "none"}\n')
    assert rows(readers.context_lines(spark, str(contexts))) == [("i", "new", "talk"), ("j", "", "")]
    assert readers.tolerant_json_lines(spark, str(p)).count() == 2
    k = tmp_path / "k.jsonl"
    k.write_text('{"i1": {"score": 1.0}, "i2": {"score": 0.5}}\n')
    assert rows(readers.keyed_json_lines(spark, str(k), "struct<score:double>")) == [("i1", 1.0), ("i2", 0.5)]
    raw = spark.createDataFrame([("﻿{\"a\": 1}\n[{\"a\": 2}, 5, {\"a\": 3}]\nnoise\n  {\"a\": 4}",)], "value string")
    assert [r[0] for r in rows(readers.event_lines(raw).select(F.try_variant_get("event", "$.a", "int")))] == [1, 2, 3, 4]
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, g string")
    sinks.replace_json(df, out)
    sinks.replace_json(spark.read.json(out).filter("id = 1"), out)
    (tmp_path / "out").rename(tmp_path / "out.old")  # a crash between the two renames
    sinks.replace_json(df.filter("id = 1"), out)
    assert not (tmp_path / "out.old").exists()
    sinks.append_json(df.filter("id = 2"), out)
    sinks.record_and_log(spark.createDataFrame([("a", 1, "line\nline"), ("b", 2, None)], "g string, n int, log string"), str(tmp_path / "results"), ["g"], "log")
    assert rows(spark.read.text(str(tmp_path / "results" / "record"))) == [('{"g":"a","n":1}', "a"), ('{"g":"b","n":2}', "b")]
    assert rows(spark.read.text(str(tmp_path / "results" / "log")).filter("value <> ''")) == [("line", "a"), ("line", "a")]
    sinks.single_json(df.limit(1), str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("*.json"))) == 1
    assert [r[0] for r in readers.folder_names(spark, str(tmp_path / "results")).collect()] == ["log", "record"]
    assert readers.folder_names(spark, str(tmp_path / "missing")).count() == 0
    for name, text in (("m1/a.json", '{"info": {"model": "x"},\n "n": 1}'), ("m1/deep/b.json", "{broken"), ("m2/c.txt", "{}")):
        f = tmp_path / "tree" / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    tree = readers.json_tree(spark, str(tmp_path / "tree"), "info struct<model string>, n int")
    assert [(r.info.model, r.n, r.file_path.endswith("m1/a.json")) for r in tree.collect()] == [("x", 1, True)]
    df.write.parquet(str(tmp_path / "pq"))
    (tmp_path / "pq" / "broken.parquet").write_bytes(b"no parquet at all")
    assert rows(readers.parquet_parts(spark, str(tmp_path / "pq"))) == [(1, "a"), (2, "b")]
    assert rows(spark.read.json(out), "id") == [(1,), (2,)]
    sinks.partitioned_json(df, str(tmp_path / "parts"), ["g"])
    assert (tmp_path / "parts" / "g=a").is_dir()
    assert rows(sinks.clashing_targets(spark.createDataFrame([("x",), ("x",), ("y",)], "path string"))) == [("x", 2)]


def test_source_tree(spark, rows, tmp_path):
    for name in ("src/a.py", "src/Build/b.py", "node_modules/c.py", "d.MD", "e.bin", "z/f.d.ets"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x\xff" if name == "d.MD" else b"x")
    assert rows(readers.source_tree(spark, str(tmp_path))) == [("d.MD", "x�"), ("src/a.py", "x"), ("z/f.d.ets", "x")]
    assert rows(readers.source_tree(spark, str(tmp_path), "py", ()), "path") == [("node_modules/c.py",), ("src/Build/b.py",), ("src/a.py",)]


def test_stream_equals_table(spark, rows, tmp_path):
    data = [(i, f"2024-01-01 {i % 5:02d}:{i % 60:02d}:00", i % 3, "view" if i % 2 else "click", float(i)) for i in range(100)]
    df = spark.createDataFrame(data, "event_id bigint, ts string, user_id bigint, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ev.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("counts")) == rows(ev.windowed_counts(df))
    assert ev.sliding_counts(df).count() > 0 and ev.user_sessions(df).agg(F.sum("n")).first()[0] == 100


def test_entry_without_the_subpackage(tmp_path):
    """The rest imports, and registers its queries, where the subpackage is deleted."""
    import shutil

    shutil.copytree(ROOT / "tracewright", tmp_path / "tracewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'p3_found' in q, 'p1_found' in q, set(e.oracle_sql()) - set(q))"
    told = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    n, core, llm, rest = told.stdout.split(maxsplit=3)
    assert int(n) > 80 and core == "True" and llm == "False" and rest.strip() == "set()", told.stderr


def test_entry_runs(spark):
    import __spark_entry__ as entry

    began = time.time()
    assert entry.entry(spark).count() > 0 and time.time() - began < 120
