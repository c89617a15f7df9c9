"""Queries of extraction, bookkeeping and statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import extract as ex
from tracewright.operators import runs, stats
from tracewright.plans import views
from tracewright.plans.views import with_views
from tracewright.sources.tables import table

_COMMAND = """CASE l_linenumber WHEN 1 THEN concat('cat src/f', l_partkey % 20, '.py') WHEN 2 THEN concat('head -n ', cast(l_quantity as int), ' src/f', l_partkey % 20, '.py && echo done')
 WHEN 3 THEN concat('tail -n ', cast(l_quantity as int), ' src/f', l_partkey % 20, '.py | wc -l') WHEN 4 THEN concat('sed -n ''', cast(l_quantity as int), ',', cast(l_quantity as int) + 10, 'p'' src/f', l_partkey % 20, '.py')
 WHEN 5 THEN concat('cat -n f', l_partkey % 20, '.py; python run.py') WHEN 6 THEN concat('grep -rn x src/f', l_partkey % 20, '.py || sed -i s/a/b/ src/g.py') ELSE concat('nl a/f', l_partkey % 20, '.py && head -n5 b.md; make test') END"""


def _commands(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_COMMAND} AS command", "cast(floor(l_extendedprice) as bigint) % 997 as tokens")


def command_segments(spark: SparkSession, d: str) -> DataFrame:
    return ex.segments(_commands(spark, d).select("l_orderkey", "l_linenumber", "command"), "command").drop("command")


def bash_read_regions(spark, d):
    return ex.read_regions(_commands(spark, d), ["l_orderkey", "l_linenumber"], "command")


def command_classes(spark, d):
    c = _commands(spark, d)
    return c.groupBy(stats.command_class(F.col("command")).alias("class")).agg(F.count("*").alias("n"))


def token_contribution(spark, d):
    return stats.token_contribution(_commands(spark, d), "l_orderkey", ["l_linenumber", "tokens"], "tokens", "command")


def _tool_messages(spark, d):
    return table(spark, d, "messages").filter("content is not null and msg_id is not null")


def grep_output_lines(spark, d):
    return ex.grep_lines(_tool_messages(spark, d), ["msg_id"], "content")


def diff_files(spark, d):
    return ex.diff_files(table(spark, d, "trajectories"), ["traj_id"], "patch")


def next_contents(spark, d):
    m = views.messages(spark, d).select("traj_id", "step_idx", "content")
    return ex.with_next_content(m).select("traj_id", "step_idx", F.length("next_content").alias("n"), F.md5("next_content").alias("h"))


def path_normalize(spark, d):
    paths = table(spark, d, "context_regions").filter("path is not null").select("path").distinct()
    raw = paths.select("path", F.concat(F.lit("/workspace/x__y/"), "path", F.lit("`")).alias("p"))
    return raw.select("path", ex.relative_path(F.col("p"), F.lit("/none")).alias("norm"), ex.relative_path(F.concat(F.lit("/repo/./"), "path"), F.lit("/repo")).alias("norm2"))


def path_predicates(spark, d):
    paths = table(spark, d, "context_regions").filter("path is not null").select("path").distinct()
    return paths.select("path", ex.likely_path(F.col("path")).alias("likely"), ex.temp_file(F.col("path")).alias("temp"), ex.plausible_path(F.col("path")).alias("plausible"))


def answer_texts(spark, d):
    return ex.event_answers(table(spark, d, "opencode_events"))


def answer_locations(spark, d):
    return ex.answer_locations(answer_texts(spark, d), "sessionid", "answer")


def refine_ranges(spark, d):
    text = F.concat(F.lit("keep ["), F.expr("cast(l_quantity as int)"), F.lit("-"), F.col("l_linenumber"), F.lit(", 0, "), F.expr("l_partkey % 50"), F.lit("]"))
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(ex.range_list(text)).alias("r"))
    return r.select("l_orderkey", "l_linenumber", "r.s", "r.e")


def pytest_log(spark, d):
    line = F.expr("concat(case when l_returnflag = 'A' then 'FAILED' else 'PASSED' end, ' tests/t', l_suppkey % 7, '.py::test_', l_partkey % 5)")
    logs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("x")))), lambda s: s["x"]), "\n").alias("log"))
    return ex.pytest_statuses(logs, ["l_orderkey"], "log")


def _results(spark, d) -> DataFrame:
    return table(spark, d, "orders").selectExpr(
        "o_orderpriority as explorer", "cast(case when o_orderkey % 3 = 0 then 10 else 5 end as int) as top_k", "o_custkey as instance_id",
        "case o_orderstatus when 'F' then 'success' when 'O' then 'timeout' end as outcome", "o_orderkey as pos", "o_totalprice as m", "o_orderkey % 7 as tokens",
    )


def latest_row(spark, d):
    return runs.latest_rows(_results(spark, d), ["explorer", "top_k", "instance_id"], ["pos"]).select("explorer", "top_k", "instance_id", "outcome", "pos")


def resume_reconcile(spark, d):
    cases = table(spark, d, "customer").select(F.col("c_custkey").alias("instance_id"))
    return runs.pending_cases(cases, _results(spark, d), 2, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


def outcome_summary(spark, d):
    return runs.outcome_summary(_results(spark, d), 5000)


def run_averages(spark, d):
    return runs.run_averages(_results(spark, d).withColumn("m", F.when(F.col("outcome").isNotNull(), F.col("m"))), ["m"])


def usage_once(spark, d):
    return runs.usage_once(_results(spark, d), "tokens")


def manifest_diff(spark, d):
    s = table(spark, d, "nation").selectExpr("n_name as explorer", "explode(map('model', n_name, 'seed', string(n_regionkey), 'model_source', 'a', 'k', nullif(string(n_nationkey % 3), '0'))) as (field, value)")
    t = table(spark, d, "nation").selectExpr("n_name as explorer", "explode(map('model', n_name, 'seed', string(n_nationkey % 5), 'model_source', 'b', 'k', '1')) as (field, value)")
    return runs.manifest_diff(s, t)


def issue_map_first(spark, d):
    return runs.first_non_empty(table(spark, d, "trajectories").select("instance_id", "issue", "traj_id").distinct(), ["instance_id"], "issue", ["traj_id"])


def length_histogram(spark, d):
    r = views.reads(spark, d)
    n = F.when(F.col("e") == -1, 0).otherwise(F.greatest(F.lit(0), F.col("e") - F.col("s") + 1))
    return r.groupBy(stats.length_class(n).alias("bucket")).agg(F.count("*").alias("n"))


def region_count_of_counts(spark, d):
    return stats.count_of_counts(views.reads(spark, d), ["instance_id"])


def org_lines(spark, d):
    t = table(spark, d, "context_regions").filter("instance_id is not null and end_line >= start_line and start_line > 0").dropDuplicates(["region_id"])
    org = F.split_part("instance_id", F.lit("__"), F.lit(1))
    return t.groupBy(org.alias("org")).agg(F.countDistinct("instance_id").alias("instances"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("approx_lines"))


def instance_keys(spark, d):
    i = table(spark, d, "trajectories").select("instance_id").filter("instance_id is not null").distinct()
    rest = F.regexp_extract("instance_id", "^.*?__(.*)$", 1)
    return i.select("instance_id", F.split_part("instance_id", F.lit("__"), F.lit(1)).alias("org"), F.regexp_replace(rest, "-[^-]*$", "").alias("name"))


def upper_median_stats(spark, d):
    return stats.distribution(table(spark, d, "trajectories").select("traj_id", "model", "rounds").distinct().fillna({"model": "none"}), ["model"], "rounds")


def rounds_histogram(spark, d):
    return stats.histogram(table(spark, d, "trajectories").select("traj_id", "rounds").distinct().withColumn("g", F.lit(0)), ["g"], "rounds")


def group_compare(spark, d):
    return stats.compare_groups(table(spark, d, "events"), "event_type", "view", ["value"])


def mode_analysis(spark, d):
    r = table(spark, d, "lineitem").selectExpr("l_orderkey as instance_id", "case l_linenumber when 1 then 'core_optional' when 2 then 'core_only' else 'no_context' end as mode", "l_returnflag <> 'A' as resolved").filter("true")
    one = r.groupBy("instance_id", "mode").agg(F.min("resolved").alias("resolved"))
    return stats.mode_analysis(one)


def route_source(spark, d):
    c = table(spark, d, "customer")
    pick = lambda cond: c.filter(cond).select(F.col("c_custkey").alias("instance_id"))
    ids = c.select(F.col("c_custkey").alias("instance_id"))
    return stats.route_source(ids, [("verified", pick("c_nationkey < 5")), ("swe_bench", pick("c_nationkey < 12")), ("nebius", pick("c_acctbal > 5000"))])


def resolve_verdict(spark, d):
    wanted = table(spark, d, "orders").selectExpr("o_orderkey as l_orderkey").join(pytest_log(spark, d), "l_orderkey", "left").selectExpr("l_orderkey as instance_id", "test")
    statuses = pytest_log(spark, d).selectExpr("l_orderkey as instance_id", "test", "status")
    return stats.verdicts(wanted, statuses)


def cost_model(spark, d):
    return stats.cost(table(spark, d, "eval_items").select(F.length("text").alias("chars")), "chars")


def session_usage(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("tw_session")
    return spark.sql("select o_custkey % 3 = 0 as sub, sum(o_orderkey % 100) as input, sum(o_orderkey % 10) as output, count(*) as n from tw_session group by o_custkey % 3 = 0")


def usage_extract(spark, d):
    e = table(spark, d, "events").selectExpr("event_type", """case event_type
      when 'view' then concat('{"usage": {"prompt_tokens": ', event_id, ', "completion_tokens": 7, "prompt_tokens_details": {"cached_tokens": ', event_id % 5, '}, "completion_tokens_details": {"reasoning_tokens": 2}}}')
      when 'click' then concat('{"input_tokens": ', event_id, ', "output_tokens": 3, "cache_read_input_tokens": 4, "cache_creation_input_tokens": 1}')
      when 'purchase' then concat('{"tokens": {"input": ', event_id, ', "output": 5, "reasoning": 6, "cache": {"read": 2, "write": 3}}}')
      when 'signup' then concat('{"usageMetadata": {"promptTokenCount": ', event_id, ', "candidatesTokenCount": 8, "thoughtsTokenCount": 9, "cachedContentTokenCount": 1}}')
      else 'no json' end as usage""")  # fmt: skip
    return stats.usage_totals(e, ["event_type"], "usage")


def grouping_sets_summary(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))


QUERIES = {
    f.__name__: f
    for f in (
        command_segments, bash_read_regions, command_classes, token_contribution, grep_output_lines, diff_files, next_contents, path_normalize, path_predicates,
        answer_texts, answer_locations, refine_ranges, pytest_log, latest_row, resume_reconcile, outcome_summary, run_averages, usage_once, manifest_diff, issue_map_first,
        length_histogram, region_count_of_counts, org_lines, instance_keys, upper_median_stats, rounds_histogram, group_compare, mode_analysis, route_source,
        resolve_verdict, cost_model, session_usage, usage_extract, grouping_sets_summary,
    )
}

_CMD = f"cmd AS (SELECT l_orderkey, l_linenumber, {_COMMAND} AS command, floor(l_extendedprice)::BIGINT % 997 AS tokens FROM lineitem)".replace("cast(l_quantity as int)", "l_quantity::INT")
_SEG = "seg AS (SELECT l_orderkey, l_linenumber, unnest(p) AS segment, unnest(range(len(p))) AS seg_no, unnest(range(len(p))) = len(p) - 1 AS is_last FROM (SELECT *, list_filter(list_transform(string_split_regex(command, '&&|\\|\\||;'), lambda x: trim(x)), lambda x: x <> '') AS p FROM cmd))"
_IN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_ONE = f"""CASE WHEN split_part(x, ' ', 1) IN {_IN(stats.EDIT_COMMANDS)} OR (contains(x, 'sed') AND contains(x, '-i')) THEN 1 WHEN split_part(x, ' ', 1) = 'find' AND contains(x, '-exec') THEN 2
 WHEN split_part(x, ' ', 1) IN {_IN(stats.READ_COMMANDS)} THEN 3 WHEN split_part(x, ' ', 1) IN {_IN(stats.EXECUTE_COMMANDS)} THEN 2 ELSE 4 END"""
_CLASS = f"list_extract(['edit', 'execute', 'read', 'other'], list_min(list_transform(list_filter(list_transform(string_split_regex(command, '&&|\\|'), lambda y: lower(trim(y))), lambda y: y <> ''), lambda x: {_ONE})))"
_RES = """res AS (SELECT o_orderpriority AS explorer, CASE WHEN o_orderkey % 3 = 0 THEN 10 ELSE 5 END AS top_k, o_custkey AS instance_id,
  CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'timeout' END AS outcome, o_orderkey AS pos, o_totalprice AS m, o_orderkey % 7 AS tokens FROM orders)"""
_TESTS = "tst AS (SELECT l_orderkey, 'tests/t' || (l_suppkey % 7) || '.py::test_' || (l_partkey % 5) AS test, arg_max(CASE WHEN l_returnflag = 'A' THEN 'FAILED' ELSE 'PASSED' END, (l_linenumber, l_partkey, l_suppkey)) AS status FROM lineitem GROUP BY 1, 2)"
_PATHS = "pp AS (SELECT DISTINCT path FROM context_regions WHERE path IS NOT NULL)"
_SUFFIX = "(?i)(" + "|".join("\\" + x for x in ex.PATH_SUFFIXES) + ")$"

SQL = {
    "command_segments": f"WITH {_CMD}, {_SEG} SELECT l_orderkey, l_linenumber, seg_no, segment, is_last FROM seg",
    "bash_read_regions": f"""WITH {_CMD}, {_SEG}, w AS (SELECT *, string_split_regex(segment, '\\s+') AS ws FROM seg WHERE split_part(segment, ' ', 1) IN ('cat', 'head', 'tail', 'nl', 'less', 'more') OR segment LIKE 'sed -n %'),
x AS (SELECT l_orderkey, l_linenumber, segment, ws, unnest(range(2, len(ws) + 1)) AS i FROM w)
SELECT l_orderkey, l_linenumber, trim(ws[i], '''') AS path,
  CASE WHEN ws[1] = 'tail' THEN -ws[3]::BIGINT WHEN ws[1] = 'sed' THEN regexp_extract(segment, '''(\\d+),(\\d+)p', 1)::BIGINT ELSE 1 END AS s,
  CASE WHEN ws[1] = 'head' THEN regexp_extract(segment, '-n ?(\\d+)', 1)::BIGINT WHEN ws[1] = 'sed' THEN regexp_extract(segment, '''(\\d+),(\\d+)p', 2)::BIGINT ELSE -1 END AS e
FROM x WHERE ws[i - 1] <> '-n' AND NOT starts_with(ws[i], '-') AND regexp_matches(ws[i], '/|\\.(py|md)$')
UNION ALL SELECT l_orderkey, l_linenumber, regexp_extract(segment, 'src/\\S+', 0), 1, -1 FROM seg WHERE starts_with(segment, 'grep ')""",
    "command_classes": f"WITH {_CMD} SELECT {_CLASS} AS class, count(*) AS n FROM cmd GROUP BY 1",
    "token_contribution": f"""WITH {_CMD}, c AS (SELECT {_CLASS} AS class, tokens, tokens * (count(*) OVER (PARTITION BY l_orderkey) - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, tokens) + 1) AS carried FROM cmd),
s AS (SELECT class, count(*) AS n_commands, sum(tokens)::BIGINT AS tokens, sum(carried)::BIGINT AS carried FROM c GROUP BY 1)
SELECT *, tokens / sum(tokens) OVER () AS token_share, carried / sum(carried) OVER () AS carried_share FROM s""",
    "grep_output_lines": """WITH l AS (SELECT msg_id, unnest(string_split_regex(content, '\\r?\\n')) AS l FROM messages WHERE content IS NOT NULL AND msg_id IS NOT NULL)
SELECT DISTINCT msg_id, regexp_extract(l, '^([^:]+):(\\d+)[:\\-]', 1) AS path, regexp_extract(l, '^([^:]+):(\\d+)[:\\-]', 2)::BIGINT AS line FROM l WHERE regexp_matches(l, '^([^:]+):(\\d+)[:\\-]')""",
    "diff_files": """WITH p AS (SELECT traj_id, unnest(string_split(patch, chr(10))) AS l FROM trajectories WHERE patch IS NOT NULL)
SELECT DISTINCT traj_id, regexp_extract(l, '^diff --git a/(.+?) b/', 1) AS path FROM p WHERE regexp_matches(l, '^diff --git a/.+? b/')
UNION SELECT DISTINCT traj_id, regexp_extract(l, '^\\+\\+\\+ b/(.+)$', 1) FROM p WHERE regexp_matches(l, '^\\+\\+\\+ b/.+$')""",
    "next_contents": with_views("SELECT traj_id, step_idx, length(lead(content) OVER w) AS n, md5(lead(content) OVER w) AS h FROM m WINDOW w AS (PARTITION BY traj_id ORDER BY step_idx)", "messages"),
    "path_normalize": f"""WITH {_PATHS} SELECT path, rtrim(path, '")''`,') AS norm,
  regexp_replace(ltrim(regexp_replace(regexp_replace('/./' || rtrim(path, '")''`,'), '^/+', ''), '^\\./', '', ''), ''), '^$', '') AS norm2 FROM pp""",
    "path_predicates": f"""WITH {_PATHS}, n AS (SELECT path, regexp_extract(path, '([^/]*)$', 1) AS name, split_part(path, '/', 1) AS first FROM pp)
SELECT path, contains(path, '/') OR regexp_matches(trim(path, '''"'), '{_SUFFIX}') AS likely, regexp_matches(name, '^({"|".join(ex.TEMP_PREFIXES)})') AS temp,
  path <> '' AND NOT contains(path, 'http') AND NOT regexp_matches(path, '[")''`\\]\\[,<>?*|&^%$#@!~\\\\{{}};]') AND NOT regexp_matches(first, '^(reproduce|tmp|temp|debug_|test_reproduce)')
  AND NOT regexp_matches(name, '^(reproduce|tmp|temp|debug_|test_reproduce)') AS plausible FROM n""",
    "answer_texts": """WITH t AS (SELECT DISTINCT event_id, sessionid, ts_ms, part.text AS text FROM opencode_events WHERE event_type = 'text' AND part.text IS NOT NULL),
m AS (SELECT sessionid, max(CASE WHEN contains(text, 'RELEVANT_FILES') THEN (ts_ms, event_id) END) AS mark, max((ts_ms, event_id)) AS last FROM t GROUP BY 1)
SELECT sessionid, string_agg(text, chr(10) ORDER BY ts_ms, event_id) AS answer FROM t JOIN m USING (sessionid) WHERE (ts_ms, event_id) >= coalesce(mark, last) GROUP BY 1""",
    "refine_ranges": """WITH q AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS q, l_partkey % 50 AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, least(q, l_linenumber)::BIGINT AS s, greatest(q, l_linenumber)::BIGINT AS e FROM q WHERE least(q, l_linenumber) > 0 UNION ALL SELECT l_orderkey, l_linenumber, p, p FROM q WHERE p > 0""",
    "pytest_log": f"WITH {_TESTS} SELECT l_orderkey, test, status FROM tst",
    "latest_row": f"WITH {_RES} SELECT explorer, top_k, instance_id, outcome, pos FROM res QUALIFY row_number() OVER (PARTITION BY explorer, top_k, instance_id ORDER BY pos DESC) = 1",
    "resume_reconcile": f"""WITH {_RES}, f AS (SELECT explorer, instance_id FROM res GROUP BY 1, 2 HAVING count(DISTINCT top_k) = 2 AND bool_or(outcome = 'success' OR outcome IS NULL))
SELECT explorer, c_custkey AS instance_id FROM customer, (SELECT DISTINCT explorer FROM res) e WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.explorer = e.explorer AND f.instance_id = c_custkey)""",
    "outcome_summary": f"WITH {_RES} SELECT explorer, top_k, " + ", ".join(f"count(*) FILTER (WHERE coalesce(outcome, 'unrecorded') = '{o}') AS n_{o}" for o in (*runs.OUTCOMES, "unrecorded")) + ", count(*) AS attempted, greatest(5000 - count(*), 0) AS not_attempted, count(*) FILTER (WHERE outcome = 'success') / 5000.0::DOUBLE AS completion FROM res GROUP BY 1, 2",
    "run_averages": f"WITH {_RES} SELECT explorer, top_k, avg(CASE WHEN outcome IS NOT NULL THEN m ELSE 0 END) AS m FROM res GROUP BY 1, 2",
    "usage_once": f"WITH {_RES} SELECT explorer, sum(tokens)::BIGINT AS tokens, count(*) FILTER (WHERE tokens > 0) AS cases FROM res WHERE top_k = (SELECT min(top_k) FROM res r WHERE r.explorer = res.explorer) GROUP BY 1",
    "manifest_diff": """SELECT n_name AS explorer, 'seed' AS field, n_regionkey::VARCHAR AS old_value, (n_nationkey % 5)::VARCHAR AS new_value FROM nation WHERE n_regionkey <> n_nationkey % 5
UNION ALL SELECT n_name, 'k', (n_nationkey % 3)::VARCHAR, '1' FROM nation WHERE n_nationkey % 3 = 2""",
    "issue_map_first": "SELECT instance_id, arg_min(issue, traj_id) AS issue FROM trajectories WHERE trim(issue) <> '' GROUP BY 1",
    "length_histogram": with_views("SELECT CASE WHEN n <= 0 THEN '0' " + " ".join(f"WHEN n <= {b} THEN '≤{b}'" for b in stats.LENGTH_BOUNDS) + " ELSE '>1000' END AS bucket, count(*) AS n FROM (SELECT CASE WHEN e = -1 THEN 0 ELSE greatest(0, e - s + 1) END AS n FROM reads) GROUP BY 1", "reads"),
    "region_count_of_counts": with_views("SELECT size, count(*) AS groups FROM (SELECT instance_id, count(*) AS size FROM reads GROUP BY 1) GROUP BY 1", "reads"),
    "org_lines": "SELECT split_part(instance_id, '__', 1) AS org, count(DISTINCT instance_id) AS instances, sum(end_line - start_line + 1)::BIGINT AS approx_lines FROM (SELECT DISTINCT region_id, instance_id, start_line, end_line FROM context_regions) WHERE instance_id IS NOT NULL AND end_line >= start_line AND start_line > 0 GROUP BY 1",
    "instance_keys": "SELECT DISTINCT instance_id, split_part(instance_id, '__', 1) AS org, regexp_replace(regexp_extract(instance_id, '^.*?__(.*)$', 1), '-[^-]*$', '') AS name FROM trajectories WHERE instance_id IS NOT NULL",
    "upper_median_stats": """WITH t AS (SELECT DISTINCT traj_id, coalesce(model, 'none') AS model, rounds FROM trajectories), l AS (SELECT model, list_sort(list(rounds)) AS r, count(rounds) AS n, avg(rounds) AS mean, min(rounds) AS lo, max(rounds) AS hi FROM t WHERE rounds IS NOT NULL GROUP BY 1)
SELECT model, n, mean, lo AS min, hi AS max, r[(n // 2) + 1] AS median, r[least(floor(n * 0.95)::BIGINT, n - 1) + 1] AS p95 FROM l""",
    "rounds_histogram": """WITH t AS (SELECT DISTINCT traj_id, rounds FROM trajectories WHERE rounds IS NOT NULL), m AS (SELECT min(rounds) AS lo, max(rounds) AS hi FROM t)
SELECT 0 AS g, least(floor((rounds - lo)::DOUBLE / (hi - lo) * 20), 19)::INT AS bin, count(*) AS count FROM t, m GROUP BY 2""",
    "group_compare": "WITH m AS (SELECT event_type, avg(value) AS mean FROM events GROUP BY 1) SELECT event_type, 'value' AS stat, mean, (mean - b) / b * 100 AS diff_pct FROM m, (SELECT mean AS b FROM m WHERE event_type = 'view') x",
    "mode_analysis": """WITH r AS (SELECT l_orderkey AS i, CASE l_linenumber WHEN 1 THEN 'core_optional' WHEN 2 THEN 'core_only' ELSE 'no_context' END AS mode, bool_and(l_returnflag <> 'A') AS ok FROM lineitem GROUP BY 1, 2),
b AS (SELECT i, ok AS bok FROM r WHERE mode = 'core_optional'),
p AS (SELECT mode, count(*) AS n, count(*) FILTER (WHERE ok) AS resolved FROM r GROUP BY 1), v AS (SELECT resolved::DOUBLE / n AS base FROM p WHERE mode = 'core_optional'),
m AS (SELECT mode, count(*) FILTER (WHERE bok AND NOT ok) AS degraded, count(*) FILTER (WHERE ok AND NOT bok) AS improved, count(*) FILTER (WHERE NOT ok AND NOT bok) AS both_fail FROM r JOIN b USING (i) GROUP BY 1)
SELECT mode, n, resolved, resolved::DOUBLE / n AS pass_rate, resolved::DOUBLE / n / base AS sufficiency, degraded, improved, both_fail FROM p JOIN m USING (mode), v""",
    "route_source": "SELECT c_custkey AS instance_id, CASE WHEN c_nationkey < 5 THEN 'verified' WHEN c_nationkey < 12 THEN 'swe_bench' WHEN c_acctbal > 5000 THEN 'nebius' ELSE 'unknown' END AS source FROM customer",
    "resolve_verdict": f"WITH {_TESTS} SELECT o_orderkey AS instance_id, coalesce(bool_and(status = 'PASSED'), true) AS resolved FROM orders LEFT JOIN tst ON o_orderkey = l_orderkey GROUP BY 1",
    "cost_model": "SELECT count(*) AS calls, sum(length(text)) / 2.5::DOUBLE AS input_tokens, count(*) * 50 / 2.5::DOUBLE AS output_tokens, sum(length(text)) / 2.5::DOUBLE * 3 / 1e6 + count(*) * 20 * 15 / 1e6 AS price FROM eval_items",
    "session_usage": "SELECT o_custkey % 3 = 0 AS sub, sum(o_orderkey % 100)::BIGINT AS input, sum(o_orderkey % 10)::BIGINT AS output, count(*) AS n FROM orders GROUP BY 1",
    "usage_extract": """SELECT event_type, sum(i)::BIGINT AS input, sum(o)::BIGINT AS output, sum(r)::BIGINT AS cache_read, sum(w)::BIGINT AS cache_write, sum(x)::BIGINT AS reasoning, sum(i + o + CASE WHEN event_type IN ('purchase', 'signup') THEN x ELSE 0 END)::BIGINT AS total FROM (
SELECT event_type, CASE event_type WHEN 'view' THEN greatest(0, event_id - event_id % 5) WHEN 'signup' THEN greatest(0, event_id - 1) WHEN 'click' THEN event_id WHEN 'purchase' THEN event_id ELSE 0 END AS i,
 CASE event_type WHEN 'view' THEN 7 WHEN 'click' THEN 3 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 8 ELSE 0 END AS o, CASE event_type WHEN 'view' THEN event_id % 5 WHEN 'click' THEN 4 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS r,
 CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 3 ELSE 0 END AS w, CASE event_type WHEN 'view' THEN 2 WHEN 'purchase' THEN 6 WHEN 'signup' THEN 9 ELSE 0 END AS x FROM events) GROUP BY 1""",
    "grouping_sets_summary": "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus) AS g FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
}
