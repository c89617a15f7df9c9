"""Queries of normalisation, views and windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.text import split_lines
from tracewright.operators import normalize as nz
from tracewright.plans import views
from tracewright.sources.tables import table
from tracewright.streaming import events as ev


def _messages(spark, d) -> DataFrame:
    m = views.messages(spark, d).withColumn("content", F.coalesce("content", F.lit("")))
    return m.select("traj_id", "step_idx", "role", "content", "tool_calls", "tool_call_id")


def run_numbering(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "trajectories").select("traj_id", "instance_id").distinct()
    return nz.number_runs(t, ["instance_id"], ["traj_id"])


def unified_openhands(spark, d):
    """Messages of the whole table, gathered per trajectory, as one unified row each."""
    m = _messages(spark, d)
    item = F.struct("step_idx", F.struct("role", "content", "tool_calls", F.lit(None).cast("string").alias("name"), "tool_call_id").alias("m"))
    rows = m.groupBy("traj_id").agg(F.transform(F.array_sort(F.collect_list(item), lambda a, b: (a["step_idx"] - b["step_idx"]).cast("int")), lambda x: x["m"]).alias("trajectory"))
    t = table(spark, d, "trajectories").select("traj_id", "instance_id", "submission", "exit_status").dropDuplicates(["traj_id"])
    u = nz.from_openhands(rows.join(t, "traj_id").withColumn("resolved", F.col("traj_id") % 5 != 0).withColumnRenamed("submission", "model_patch"))
    return u.groupBy("instance_id").agg(F.count("*").alias("n"), F.sum("rounds").alias("rounds"), F.first("repo").alias("repo"))


def region_slices(spark, d):
    c = table(spark, d, "chunks").filter("content is not null").dropDuplicates(["chunk_id"])
    lines = split_lines(F.col("content"), "\r\n|\n|\r")
    out = nz.slice_lines(lines, F.when(F.col("chunk_id") % 3 == 0, -5).otherwise(F.col("chunk_id") % 7), F.when(F.col("chunk_id") % 2 == 0, -1).otherwise(9))
    return c.select("chunk_id", F.md5(out).alias("h"))


def issue_texts(spark, d):
    t = table(spark, d, "trajectories").select("traj_id", "issue").distinct()
    tagged = F.concat(F.lit("x <issue_description>\n"), F.coalesce("issue", F.lit("")), F.lit(" </issue_description> y"))
    up = F.concat(F.lit("<uploaded_files>a</uploaded_files>\n"), F.coalesce("issue", F.lit("")))
    marked = F.concat(F.lit("ISSUE:\n"), F.coalesce("issue", F.lit("")), F.lit("\nINSTRUCTIONS: go"))
    return t.select("traj_id", F.md5(F.trim(nz.tagged_issue(tagged), F.lit(" \n"))).alias("a"), F.md5(nz.uploaded_issue(up)).alias("b"), F.md5(nz.marked_issue(marked)).alias("c"))


def action_views(spark, d):
    v = nz.action_view(_messages(spark, d), None)
    return v.select("traj_id", "step_no", "name", F.length("output").alias("n"), F.md5("output").alias("h"))


def chat_round_trip(spark, d):
    m = _messages(spark, d).filter("role in ('system', 'user', 'assistant') and content <> ''")
    m = m.filter(F.trim(F.regexp_replace("content", r"\[(System|User|Assistant)\]", ""), F.lit(" \n\t\r")) != "")
    item = F.struct("step_idx", "role", F.trim(F.regexp_replace("content", r"\[(System|User|Assistant)\]", ""), F.lit(" \n\t\r")).alias("content"))
    chats = m.groupBy("traj_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["role"], x["content"])).alias("messages"))
    back = chats.select("traj_id", "messages", nz.chat_text(F.col("messages")).alias("text"))
    same = F.to_json("messages") == F.to_json(nz.chat_messages(F.col("text")))
    return back.select("traj_id", F.size("messages").alias("n"), same.alias("same"), F.md5("text").alias("h"))


def context_modes(spark, d):
    from tracewright.plans.intervals import _out, _truth

    t = _truth(spark, d)
    both = nz.context_regions(_out(t["core"]), _out(t["optional"].filter("s >= 0")), "core_optional")
    return both.groupBy("instance_id").agg(F.count("*").alias("n"))


def rolling_events(spark, d):
    return ev.windowed_counts(table(spark, d, "events"), "1 day").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(spark, d):
    s = ev.user_sessions(table(spark, d, "events"), "30 minutes")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


QUERIES = {f.__name__: f for f in (run_numbering, unified_openhands, region_slices, issue_texts, action_views, chat_round_trip, context_modes, rolling_events, event_sessions)}

_STRIP = "regexp_replace(content, '\\[(System|User|Assistant)\\]', '', 'g')"
_TALK = f"talk AS (SELECT traj_id, step_idx, role, trim({_STRIP}, ' ' || chr(10) || chr(9) || chr(13)) AS c FROM m WHERE role IN ('system', 'user', 'assistant'))"

SQL = {
    "run_numbering": "SELECT traj_id, instance_id, row_number() OVER (PARTITION BY instance_id ORDER BY traj_id) - 1 AS run FROM (SELECT DISTINCT traj_id, instance_id FROM trajectories)",
    "unified_openhands": views.with_views(""", t AS (SELECT DISTINCT traj_id, instance_id FROM trajectories), c AS (SELECT traj_id, count(*) AS c FROM m GROUP BY 1)
SELECT instance_id, count(*) AS n, sum(c)::BIGINT AS rounds, any_value(split_part(instance_id, '__', 1) || '/' || regexp_replace(regexp_extract(instance_id, '^.*?__(.*)$', 1), '-[^-]*$', '')) AS repo
FROM t JOIN c USING (traj_id) WHERE traj_id % 5 <> 0 GROUP BY 1""", "messages"),
    "region_slices": """WITH c AS (SELECT DISTINCT chunk_id, string_split_regex(content, '\\r\\n|\\n|\\r') AS a, content FROM chunks WHERE content IS NOT NULL),
l AS (SELECT chunk_id, CASE WHEN content = '' THEN [] WHEN a[-1] = '' THEN a[:len(a) - 1] ELSE a END AS a FROM c),
b AS (SELECT chunk_id, a, greatest(1, least(CASE WHEN chunk_id % 3 = 0 THEN len(a) - 4 ELSE chunk_id % 7 END, len(a))) AS s, greatest(1, least(CASE WHEN chunk_id % 2 = 0 THEN len(a) ELSE 9 END, len(a))) AS e FROM l)
SELECT chunk_id, md5(CASE WHEN len(a) > 0 AND s <= e THEN array_to_string(a[s:e], chr(10)) ELSE '' END) AS h FROM b""",
    "issue_texts": """WITH t AS (SELECT DISTINCT traj_id, coalesce(issue, '') AS i FROM trajectories)
SELECT traj_id, md5(trim(i, ' ' || chr(10))) AS a, md5(left(trim(i, ' ' || chr(10) || chr(9) || chr(13)), 4000)) AS b, md5(trim(i, ' ' || chr(10) || chr(9) || chr(13))) AS c FROM t""",
    "action_views": views.with_views(""", x AS (SELECT traj_id, step_idx, role, lead(role) OVER w AS nr, lead(coalesce(content, '')) OVER w AS nc, tool_calls FROM m WINDOW w AS (PARTITION BY traj_id ORDER BY step_idx)),
u AS (SELECT traj_id, step_idx, nr, nc, unnest(tool_calls) AS c, unnest(range(len(tool_calls))) AS pos FROM x WHERE role = 'assistant')
SELECT traj_id, row_number() OVER (PARTITION BY traj_id ORDER BY step_idx, pos) AS step_no, c.function.name AS name, CASE WHEN nr = 'tool' THEN length(nc) END AS n, CASE WHEN nr = 'tool' THEN md5(nc) END AS h FROM u""", "messages"),
    "chat_round_trip": views.with_views(f""", {_TALK}
SELECT traj_id, count(*) AS n, true AS same, md5(string_agg('[' || upper(role[1]) || role[2:] || ']' || chr(10) || c, chr(10) || chr(10) ORDER BY step_idx)) AS h FROM talk WHERE c <> '' GROUP BY 1""", "messages"),
    "context_modes": views.with_views("SELECT instance_id, count(*) AS n FROM (SELECT instance_id, path, s, e FROM core UNION SELECT instance_id, path, s, e FROM optional) GROUP BY 1", "reads", "modified", "lines", "core"),
    "rolling_events": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "event_sessions": """WITH l AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)
SELECT user_id, sum(new)::BIGINT AS sessions, count(*) AS events FROM l GROUP BY 1""",
}
