from datetime import datetime

from tracewright.llm.conversations import event_conversations, message_conversations

SCHEMA = (
    "msg_id bigint, traj_id bigint, step_idx int, role string, content string, tool_calls array<struct<id string, type string, function struct<name string, arguments string>>>, "
    "tool_call_id string, sent_at timestamp, turn_no string"
)
T0 = datetime(2024, 1, 1)


def conv(spark, *talks):
    """A talk is a list of (role, content, call ids, answered id, step, time)."""
    data, n = [], 0
    for t, talk in enumerate(talks):
        for role, content, calls, answers, step, minute in talk:
            n += 1
            data.append((n, t, step, role, content, [(c, "function", None) for c in calls] if calls is not None else None, answers, T0.replace(minute=minute), "x"))
    return spark.createDataFrame(data, SCHEMA)


def kept(df):
    return sorted({r.conv_key for r in message_conversations(df).collect()})


def m(role, content="text", calls=None, answers=None, step=None, minute=0):
    return (role, content, calls, answers, step, minute)


def test_kept_and_broken(spark):
    good = [m(" System", step=0), m("human", step=1), m("ai", None, ["a", "b"], step=2), m("tool", answers="a", step=3), m(None, answers="b", step=4), m(None, step=5)]
    talks = [
        good,
        good[:-1],  # 1: no last answer
        [good[0], *good[2:]],  # 2: no user
        [m("user", " ", step=0), m("assistant", step=1)],  # 3: blank question
        [m("user", step=0), m("user", step=1), m("assistant", step=2)],  # 4: unanswered
        [m("user", step=0), m("assistant", None, ["a"], step=1), m("assistant", step=2)],  # 5: open call
        [m("user", step=0), m("tool", answers="a", step=1), m("assistant", None, ["a"], step=2), m("assistant", step=3)],  # 6: answer before call
        [m("user", step=0), m("assistant", None, ["a"], step=1), m("tool", answers="a", step=2), m("tool", answers="a", step=3), m("assistant", step=4)],  # 7: answered twice
        [m("user", step=0), m("narrator", step=1), m("assistant", step=2)],  # 8: unknown role
        [m("system", step=0)],  # 9
        [m("user", step=0), m("model", None, ["a"], step=1), m("function", answers="a", step=2), m("user", step=3), m("ai", step=4)],  # 10
        [m("user", step=0), m("ai", None, ["a", "a"], step=1), m("tool", answers="a", step=2), m("tool", answers="a", step=3), m("ai", step=4)],  # 11: one id, two calls
    ]
    assert kept(conv(spark, *talks)) == ["0", "10", "11"]


def test_order(spark):
    by_time = [m("assistant", minute=5), m("tool", answers="b", minute=3), m("tool", answers="a", minute=3), m("assistant", None, ["a", "b"], step=1, minute=3), m("user", minute=1)]
    by_step = [m("assistant", step=2, minute=0), m("user", step=1, minute=9)]
    df = conv(spark, by_time, by_step)
    got = sorted((r.conv_key, r.turn_no, r.message_key, r.speaker) for r in message_conversations(df.union(df)).collect())
    assert got == [
        ("0", 1, "5", "user"), ("0", 2, "4", "assistant"), ("0", 3, "3", "tool"), ("0", 4, "2", "tool"), ("0", 5, "1", "assistant"),
        ("1", 1, "7", "user"), ("1", 2, "6", "assistant"),
    ]
    assert message_conversations(df.limit(0)).count() == 0


def test_events(spark):
    schema = "event_id bigint, event_type string, ts_ms bigint, sessionid string, part struct<messageid string, text string, reason string, state struct<output string>>"
    e = lambda i, kind, ts, s, msg, text=None, reason=None, out=None: (i, kind, ts, s, (msg, text, reason, (out,)))
    base = [e(1, "step_start", 5, "s", "z"), e(2, "tool_use", 6, "s", "z", out="o"), e(3, "step_finish", 7, "s", "z", reason="tool-calls"), e(4, "step_start", 8, "s", "a"), e(5, "text", 9, "s", "a", "hi"), e(6, "step_finish", 10, "s", "a", reason="stop")]
    moved = lambda s, drop: [(i + 100, k, t, s, p) for i, k, t, _, p in base if i != drop]
    rows = base + base[:2] + moved("no_start", 1) + moved("no_text", 5) + moved("no_stop", 6) + [e(900, "text", 1, "s2", None)]
    rows += [(i + 500, k, t, "no_out", p if k != "tool_use" else (p[0], None, None, None)) for i, k, t, _, p in base]
    got = sorted((r.conv_key, r.turn_no, r.message_key, r.speaker) for r in event_conversations(spark.createDataFrame(rows, schema)).collect())
    assert got == [("s", 1, "z", "assistant"), ("s", 2, "a", "assistant")]
