from tracewright.operators import normalize as nz
from tracewright.plans import formats, retrieval


def test_chunk_documents_has_no_limit(spark, rows, tmp_path):
    texts = [(i, "issues", "\n".join(f"line {n}" for n in range(9000))) for i in range(3)] + [(9, "wiki", "one line")]
    spark.createDataFrame(texts, "doc_id bigint, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = rows(retrieval.chunk_documents(spark, str(tmp_path)), "repo", "chunk_seq", "path", "end")
    assert len(got) == len(set(got)) == 3 * 1125 + 1 and {s for r, s, _, _ in got if r == "issues"} == set(range(3375))
    assert max((s, p, e) for r, s, p, e in got if r == "issues") == (3374, "00000002", 9000)


def test_run_numbering_numbers_all_runs(spark, rows, tmp_path):
    runs = [(t, "hot" if t % 3 else "cold") for t in range(30)]
    df = spark.createDataFrame(runs + runs[:5], "traj_id bigint, instance_id string")
    df.write.parquet(str(tmp_path / "trajectories.parquet"))
    want = sorted((t, i, [x for x, j in runs if j == i].index(t)) for t, i in runs)
    assert sorted(rows(formats.run_numbering(spark, str(tmp_path)), "traj_id", "instance_id", "run")) == want
    capped = nz.number_runs(df.distinct(), ["instance_id"], ["traj_id"], 3)
    assert sorted(rows(capped, "traj_id", "instance_id", "run")) == [x for x in want if x[2] < 3]
