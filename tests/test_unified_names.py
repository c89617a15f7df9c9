import json

from tracewright.plans import problems, registry

RAW = "rec_id bigint, feed string, file_name string, line_no int, raw_line string"


def test_renamed_fields_have_one_name(spark, tmp_path):
    line = lambda i, **more: {"id": f"r{i}", **more}
    files = [
        ("1", [line(i, cost=i + 0.5, usd=f"u{i}", price=None) for i in range(6)]),
        ("2", [line(i, price=i + 0.5) for i in range(3, 9)] + ["cut"]),
        ("3", [line(i, usd=str(i + 0.5), new=i, cost=f"c{i}") for i in range(6, 12)]),
    ]
    data = [(f"f{k}", name, n, x if isinstance(x, str) else json.dumps(x)) for k in (1, 2) for name, lines in files for n, x in enumerate(lines)]
    data = [(i, *x) for i, x in enumerate(data)]
    spark.createDataFrame(data + data[:4], RAW).write.parquet(str(tmp_path / "raw_records.parquet"))
    assert "p5_table" in registry.queries()
    got = {r.rec_id: r.fields for r in problems.p5_table(spark, str(tmp_path)).collect()}
    assert len(got) == len(data)
    for i, _, file, n, raw in data:
        if raw == "cut":
            assert got[i] is None
            continue
        # The usd of file 3 is the cost of file 1, whose own usd is another field and stays, as is the cost of file 3.
        want = json.loads(raw)
        cost = {"1": "cost", "2": "price", "3": "usd"}[file]
        assert got[i]["cost"].as_json == str(want[cost]) and got[i]["cost"].kind == ("string" if file == "3" else "number")
        assert set(got[i]) == {"1": {"id", "cost", "usd", "price"}, "2": {"id", "cost"}, "3": {"id", "cost", "new", "cost (cost)"}}[file]
