from datetime import datetime

import pytest

from tracewright.operators import normalize as nz
from tracewright.plans import formats, intervals, logs

CALL = "struct<id string, type string, function struct<name string, arguments string>>"
MESSAGES = f"msg_id bigint, traj_id bigint, instance_id string, step_idx int, role string, content string, name string, tool_calls array<{CALL}>, tool_call_id string, sent_at timestamp_ntz"
TALK = [(" Human", "go", [], None), ("ai", "x", ["a"], None), (None, "out", [], "a"), ("model", "y", ["b"], None), ("Observation", "result", [], "b"), ("Assistant", "done", [], None)]


@pytest.fixture
def folder(spark, tmp_path):
    """Trajectory 1 has all steps, from 1; 2 lacks two of them; 3 has none and is longer. Some rows come again."""
    rows = []
    for t, talk, step in ((1, TALK, lambda i: i + 1), (2, TALK, lambda i: None if i in (1, 2) else i), (3, TALK[:-1] + [("developer", "", [], None)] * 5 + TALK[-1:], lambda i: None)):
        for i, (role, content, calls, answers) in enumerate(talk):
            rows.append((100 * t + i, t, "o__r-1", step(i), role, content, None, [(c, "function", (f"f{c}", "{}")) for c in calls], answers, datetime(2024, 1, 1, 0, i)))
    spark.createDataFrame(rows[::-1] + rows[::3], MESSAGES).write.parquet(str(tmp_path / "messages.parquet"))
    t = [(i, "o__r-1", "p", "ok") for i in (1, 2, 3)]
    spark.createDataFrame(t, "traj_id bigint, instance_id string, submission string, exit_status string").write.parquet(str(tmp_path / "trajectories.parquet"))
    return str(tmp_path)


def test_messages_without_step_are_kept_in_order(spark, rows, folder):
    assert rows(formats.unified_openhands(spark, folder), "n", "rounds") == [(3, 23)]
    want = {(t, k, f"f{c}", n) for t in (1, 2, 3) for k, c, n in ((1, "a", 3), (2, "b", 6))}
    assert set(rows(formats.action_views(spark, folder), "traj_id", "step_no", "name", "n")) == want
    assert rows(formats.chat_round_trip(spark, folder), "traj_id", "n", "same") == [(1, 4, True), (2, 4, True), (3, 4, True)]
    near = rows(intervals.context_window_k(spark, folder), "traj_id", "step_idx", "role", "n", "is_read")
    assert [r[1:] for r in near if r[0] == 2] == [(0, "user", 2, 0), (1, "assistant", 1, 1), (2, "tool", 3, 0), (3, "assistant", 1, 1), (4, "tool", 6, 0)]
    assert [r[1] for r in near if r[0] == 1] == [1, 2, 3, 4, 5]
    last = rows(intervals.last_context(spark, folder))
    assert sorted(s for t, s in last if t == 3) == list(range(3, 11)) and len(last) == 6 + 6 + 8
    after = {(t, s): n for t, s, n in rows(logs.next_contents(spark, folder), "traj_id", "step_idx", "n")}
    assert len(after) == 23 and [after[2, s] for s in range(6)] == [1, 3, 1, 6, 4, None] and after[3, 4] == 0


def test_action_views_cover_the_whole_output(spark, rows, tmp_path):
    talk = [("user", "go", None, None), ("assistant", "", [("a", "function", ("f", "{}"))], None), ("tool", "x" * 3000, None, "a")]
    data = [(i, 7, "i", i, role, content, None, calls, answers, datetime(2024, 1, 1, 0, i)) for i, (role, content, calls, answers) in enumerate(talk)]
    spark.createDataFrame(data, MESSAGES).write.parquet(str(tmp_path / "messages.parquet"))
    assert rows(formats.action_views(spark, str(tmp_path)), "traj_id", "step_no", "name", "n") == [(7, 1, "f", 3000)]
    m = spark.createDataFrame(data, MESSAGES)
    assert [len(nz.action_view(m, *most).first()["output"]) for most in ((), (10,), (None,))] == [2000, 10, 3000]
