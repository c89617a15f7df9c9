"""Queries of the interval algebra and of the metrics, with their SQL.

The SQL lists lines one by one and regroups them, so it shares nothing with the sweep it checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import intervals as iv
from tracewright.operators.metrics import Scoring, at_budgets
from tracewright.plans import views
from tracewright.plans.views import with_views


def _concrete(spark, d) -> DataFrame:
    s, e = iv.concrete(F.col("s"), F.col("e"))
    return views.reads(spark, d).withColumns({"s": s, "e": e})


def _out(df: DataFrame) -> DataFrame:
    return df.withColumn("e", F.when(F.col("s") < 0, F.col("e")).otherwise(iv.report_end(F.col("e"))))


def _members(spark, d) -> DataFrame:
    return views.reads(spark, d).select("instance_id", "traj_id").distinct()


def _truth(spark, d) -> dict[str, DataFrame]:
    return iv.ground_truth(_concrete(spark, d), _members(spark, d), views.modified(spark, d))


def _scoring(spark, d, scope="all") -> Scoring:
    t = _truth(spark, d)
    return Scoring(views.preds(spark, d), _out(t["core"]), _out(t["optional"]), t["main"], views.file_lines(spark, d), scope=scope)


def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    return _out(iv.merge(_concrete(spark, d).filter("s >= 0"), ["instance_id", "traj_id", "path"]))


def interval_intersect_all(spark, d):
    return _out(_truth(spark, d)["core"])


def interval_pair_intersect(spark, d):
    r = _concrete(spark, d)
    return _out(iv.intersect(r.filter("traj_id = 0"), r.filter("traj_id = 1"), ["instance_id", "path"]))


def model_union(spark, d):
    return _out(iv.merge(_concrete(spark, d).filter("s >= 0"), ["instance_id", "model", "path"]))


def interval_minus(spark, d):
    return _out(_truth(spark, d)["optional"].filter("s >= 0"))


def modified_core(spark, d):
    return _truth(spark, d)["modified_core"]


def main_files(spark, d):
    return _truth(spark, d)["main"]


def ground_truth_summary(spark, d):
    t = _truth(spark, d)
    n = lambda df, name: df.groupBy("instance_id").agg(F.count("*").alias(name))
    out = _members(spark, d).select("instance_id").distinct()
    for df, name in ((t["core"], "n_core"), (t["optional"].filter("s >= 0"), "n_optional"), (t["modified_core"], "n_modified_core"), (t["main"], "n_main")):
        out = out.join(n(df, name), "instance_id", "left")
    return out.fillna(0)


def region_lists(spark, d):
    """Sorted regions per instance and path as one text."""
    core = _out(_truth(spark, d)["core"])
    item = F.array_sort(F.collect_list(F.struct("s", "e")))
    return core.groupBy("instance_id", "path").agg(F.array_join(F.transform(item, lambda x: F.concat_ws("-", x["s"], x["e"])), ",").alias("regions"))


def eof_resolution(spark, d):
    return iv.resolve(views.preds(spark, d), views.file_lines(spark, d)).select("instance_id", "rank", "path", "rs", "re")


def eof_after_algebra(spark, d):
    return iv.resolve_eof(_out(_truth(spark, d)["core"]), views.file_lines(spark, d)).select("instance_id", "path", "s", "e")


def coarse_clamp(spark, d):
    return iv.clamp_coarse(views.reads(spark, d), ["instance_id", "path"], views.file_lines(spark, d)).distinct()


def refine_clip(spark, d):
    refined = views.preds(spark, d).select("instance_id", "path", "s", "e").filter("e >= s")
    coarse = _out(_truth(spark, d)["core"])
    return iv.clip_refined(refined, coarse, ["instance_id", "path"], views.file_lines(spark, d))


def read_provenance(spark, d):
    r = views.reads(spark, d).withColumn("step_idx", (F.col("s") % 10))
    p = iv.provenance(r, ["traj_id", "step_idx", "s", "e"])
    text = F.transform("reads", lambda x: F.concat_ws(":", x["traj_id"], x["step_idx"], x["s"], x["e"]))
    return p.select("instance_id", "path", F.array_join(text, ",").alias("reads"))


def lines_to_ranges(spark, d):
    lines = views.preds(spark, d).select("instance_id", "path", F.col("s").alias("line")).distinct()
    return iv.runs_of_lines(lines, ["instance_id", "path"], "line")


def snippet_spans(spark, d):
    core = _out(_truth(spark, d)["core"])
    return iv.snippet_spans(core, ["instance_id", "path"], views.file_lines(spark, d), margin=3, whole=60)


def apply_replies(spark, d):
    core = _out(_truth(spark, d)["core"])
    replies = views.preds(spark, d).filter("e >= s").select("instance_id", "path", "s", "e")
    return iv.apply_replies(core, replies, ["instance_id", "path"])


def context_window_k(spark, d):
    m = views.messages(spark, d)
    steps = m.filter("size(tool_calls) > 0").select("traj_id", "step_idx")
    w = iv.context_windows(m, steps, 1, most=2**31 - 1)  # whole contents
    return w.select("traj_id", "step_idx", "role", F.length("content").alias("n"), F.md5("content").alias("h"), "is_read").distinct()


def last_context(spark, d):
    m = views.messages(spark, d).select("traj_id", "step_idx").distinct()
    return iv.last_messages(m, 8)


def metric_prf(spark, d):
    return _scoring(spark, d).prf()


def metric_efficiency(spark, d):
    return _scoring(spark, d).line_metrics().select("instance_id", "context_efficiency", "optional_coverage")


def metric_files(spark, d):
    return _scoring(spark, d).file_metrics()


def metric_regions(spark, d):
    return _scoring(spark, d).region_metrics()


def metric_wcc(spark, d):
    return _scoring(spark, d).weighted_core_coverage()


def metric_ndcg(spark, d):
    return _scoring(spark, d).ndcg()


def metric_recall_budgets(spark, d):
    return _scoring(spark, d).recall_at()


def metric_first_hit(spark, d):
    return _scoring(spark, d).first_useful_hit()


def metric_prf_gt_lengths(spark, d):
    return _scoring(spark, d, scope="gt").prf()


def metric_all(spark, d):
    return _scoring(spark, d).all_metrics()


def context_mass(spark, d):
    return _scoring(spark, d).context_mass()


def top_k_budgets(spark, d):
    return at_budgets(views.preds(spark, d), [1, 3, 5, 10]).groupBy("instance_id", "top_k").agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


QUERIES = {
    f.__name__: f
    for f in (
        interval_merge, interval_intersect_all, interval_pair_intersect, model_union, interval_minus, modified_core, main_files, ground_truth_summary,
        region_lists, eof_resolution, eof_after_algebra, coarse_clamp, refine_clip, read_provenance, lines_to_ranges, snippet_spans, apply_replies,
        context_window_k, last_context, metric_prf, metric_efficiency, metric_files, metric_regions, metric_wcc, metric_ndcg, metric_recall_budgets,
        metric_first_hit, metric_prf_gt_lengths, metric_all, context_mass, top_k_budgets,
    )
}

_ISLANDS = """SELECT {k}, min(line) AS s, CASE WHEN max(line) = 200 THEN -1 ELSE max(line) END AS e
FROM (SELECT *, line - row_number() OVER (PARTITION BY {k} ORDER BY line) AS g FROM {t}) GROUP BY {k}, g"""
_TRUTH = ("reads", "modified", "lines", "core")
_SCORE = ("reads", "modified", "file_lines", "preds", "lines", "core", "resolved")
_RATIO = "CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END"


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN {b} > 0 THEN ({a})::DOUBLE / {b} ELSE 0 END)"


def _n(t: str, name: str) -> str:
    return f"LEFT JOIN (SELECT instance_id, count(*) AS {name} FROM {t} GROUP BY 1) USING (instance_id)"


_P, _C = "coalesce(np, 0)", "coalesce(nc, 0)"
_PRECISION, _RECALL = _ratio("coalesce(npc, 0)", _P), _ratio("coalesce(npc, 0)", _C)
_PRF = f"""SELECT instance_id, {_PRECISION} AS precision, {_RECALL} AS recall, {_ratio(f'2 * {_PRECISION} * {_RECALL}', f'({_PRECISION} + {_RECALL})')} AS f1
FROM cases {_n('PL', 'np')} {_n('KL', 'nc')} {_n('(PL SEMI JOIN KL USING (instance_id, path, line))', 'npc')}"""
_EFF = f"""SELECT instance_id, {_ratio('coalesce(nu, 0)', _P)} AS context_efficiency, {_ratio('coalesce(npo, 0)', 'coalesce(no, 0)')} AS optional_coverage
FROM cases {_n('PL', 'np')} {_n('ZL', 'no')} {_n('(PL SEMI JOIN ZL USING (instance_id, path, line))', 'npo')}
{_n('(PL SEMI JOIN (SELECT * FROM KL UNION SELECT * FROM ZL) u USING (instance_id, path, line))', 'nu')}"""
_FILES = f"""SELECT instance_id, {_ratio('coalesce(hit, 0)', _C)} AS hit_file_rate, {_ratio('coalesce(noise, 0)', _P)} AS noise_file_rate
FROM cases {_n('(SELECT DISTINCT instance_id, path FROM preds)', 'np')} {_n('(SELECT DISTINCT instance_id, path FROM core)', 'nc')}
{_n('(SELECT DISTINCT instance_id, path FROM preds SEMI JOIN core USING (instance_id, path))', 'hit')}
{_n('(SELECT DISTINCT instance_id, path FROM preds ANTI JOIN (SELECT instance_id, path FROM core UNION SELECT instance_id, path FROM optional UNION SELECT instance_id, path FROM reads WHERE s < 0) u USING (instance_id, path))', 'noise')}"""
_REGIONS = f"""SELECT instance_id, {_ratio('coalesce(h, 0)', 'n')} AS hit_region_rate, {_ratio('coalesce(z, 0)', _P)} AS noise_region_rate
FROM cases {_n('core', 'n')} {_n('preds', 'np')}
{_n("(SELECT * FROM R a WHERE side = 'c' AND EXISTS (SELECT 1 FROM R b WHERE b.side = 'p' AND a.instance_id = b.instance_id AND a.path = b.path AND a.rs <= b.re AND b.rs <= a.re))", 'h')}
{_n("(SELECT * FROM R a WHERE side = 'p' AND NOT EXISTS (SELECT 1 FROM R b WHERE b.side IN ('c', 'o') AND a.instance_id = b.instance_id AND a.path = b.path AND a.rs <= b.re AND b.rs <= a.re))", 'z')}"""
_WCC = """, one AS (SELECT instance_id, path, rs, re, row_number() OVER () AS id FROM R WHERE side = 'c' AND rs <= re),
cov AS (SELECT id, count(*) AS n FROM one JOIN PL USING (instance_id, path) WHERE line BETWEEN rs AND re GROUP BY id),
w AS (SELECT one.*, coalesce(n, 0)::DOUBLE / (re - rs + 1) AS share, CASE WHEN MF.path IS NOT NULL THEN 3.0 ELSE 2.0 END AS w
      FROM one LEFT JOIN cov USING (id) LEFT JOIN MF USING (instance_id, path))
SELECT instance_id, coalesce(sum(w * share) / sum(w), 0) AS weighted_core_coverage FROM cases LEFT JOIN w USING (instance_id) GROUP BY 1"""
_NDCG_BASE = """, g AS (SELECT p.instance_id, p.rank, count(k.line) * any_value(CASE WHEN MF.path IS NOT NULL THEN 1.5 ELSE 1.0 END) AS gain
    FROM RL p JOIN KL k USING (instance_id, path, line) LEFT JOIN MF USING (instance_id, path) WHERE side = 'p' GROUP BY 1, 2),
b AS (SELECT r.instance_id, r.rank, coalesce(re - rs + 1, 0) AS lines, coalesce(gain, 0) AS gain FROM R r LEFT JOIN g USING (instance_id, rank) WHERE side = 'p'),
o AS (SELECT *, row_number() OVER (PARTITION BY instance_id ORDER BY rank) - 1 AS i0,
        row_number() OVER (PARTITION BY instance_id ORDER BY gain::DOUBLE / greatest(lines, 1) DESC, rank) - 1 AS i1 FROM b),
c AS (SELECT *, sum(lines) OVER (PARTITION BY instance_id ORDER BY i0) AS c0, sum(lines) OVER (PARTITION BY instance_id ORDER BY i1) AS c1 FROM o),
t AS (SELECT c.*, k,
        max(CASE WHEN c0 > k AND i0 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY instance_id, k ORDER BY i0) AS x0,
        max(CASE WHEN c1 > k AND i1 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY instance_id, k ORDER BY i1) AS x1
      FROM c, (VALUES (100), (300), (500)) v(k)),
s AS (SELECT instance_id, k, sum(CASE WHEN x0 = 0 THEN gain / log2(i0 + 2) ELSE 0 END) AS d, sum(CASE WHEN x1 = 0 THEN gain / log2(i1 + 2) ELSE 0 END) AS i FROM t GROUP BY 1, 2)"""
_NDCG = "SELECT instance_id, " + ", ".join(f"coalesce(max(CASE WHEN k = {k} THEN CASE WHEN i > 0 THEN least(d / i, 1.0) ELSE 0 END END), 0) AS ndcg_at_{k}" for k in (100, 300, 500)) + " FROM cases LEFT JOIN s USING (instance_id) GROUP BY 1"
_RECALL_BASE = """, z AS (SELECT instance_id, path, line, row_number() OVER (PARTITION BY instance_id ORDER BY rank, line) AS pos FROM RL WHERE side = 'p'),
h AS (SELECT instance_id, k, count(DISTINCT (path, line)) AS hit FROM z SEMI JOIN KL USING (instance_id, path, line), (VALUES (100), (300), (500)) v(k) WHERE pos <= k GROUP BY 1, 2),
kn AS (SELECT instance_id, count(*) AS nc FROM KL GROUP BY 1)"""
_RECALLS = "SELECT instance_id, " + ", ".join(f"coalesce(max(CASE WHEN k = {k} THEN hit END), 0)::DOUBLE / greatest(coalesce(max(nc), 0), 1) AS recall_at_{k}" for k in (100, 300, 500)) + " FROM cases LEFT JOIN h USING (instance_id) LEFT JOIN kn USING (instance_id) GROUP BY 1"
_FIRST = """SELECT instance_id, coalesce(1 - min(rank)::DOUBLE / any_value(n), 0) AS first_useful_hit
FROM cases LEFT JOIN (SELECT * FROM RL SEMI JOIN KL USING (instance_id, path, line) WHERE side = 'p') x USING (instance_id)
LEFT JOIN (SELECT instance_id, count(*) AS n FROM preds GROUP BY 1) USING (instance_id) GROUP BY 1"""

SQL = {
    "interval_merge": with_views(_ISLANDS.format(k="instance_id, traj_id, path", t="(SELECT DISTINCT instance_id, traj_id, path, line FROM L)"), "reads", "modified", "lines"),
    "interval_intersect_all": with_views("SELECT instance_id, path, s, e FROM core", *_TRUTH),
    "interval_pair_intersect": with_views(_ISLANDS.format(k="instance_id, path", t="(SELECT instance_id, path, line FROM L WHERE traj_id = 0 INTERSECT SELECT instance_id, path, line FROM L WHERE traj_id = 1)"), "reads", "modified", "lines"),
    "model_union": with_views(_ISLANDS.format(k="instance_id, model, path", t="(SELECT DISTINCT instance_id, model, path, line FROM L)"), "reads", "modified", "lines"),
    "interval_minus": with_views("SELECT instance_id, model, path, s, e FROM optional", *_TRUTH),
    "modified_core": with_views("SELECT instance_id, path FROM MC", "reads", "modified", "lines"),
    "main_files": with_views("SELECT instance_id, path FROM MF", "reads", "modified", "lines"),
    "ground_truth_summary": with_views(f"SELECT instance_id, coalesce(n_core, 0) AS n_core, coalesce(n_optional, 0) AS n_optional, coalesce(n_modified_core, 0) AS n_modified_core, coalesce(n_main, 0) AS n_main FROM nt {_n('core', 'n_core')} {_n('optional', 'n_optional')} {_n('MC', 'n_modified_core')} {_n('MF', 'n_main')}", *_TRUTH),
    "region_lists": with_views("SELECT instance_id, path, string_agg(s || '-' || e, ',' ORDER BY s, e) AS regions FROM core GROUP BY 1, 2", *_TRUTH),
    "eof_resolution": with_views("SELECT instance_id, rank, path, rs, re FROM R WHERE side = 'p'", *_SCORE),
    "eof_after_algebra": with_views("SELECT instance_id, path, s, CASE WHEN e = -1 THEN coalesce(n_lines, e) ELSE e END AS e FROM core LEFT JOIN file_lines USING (path)", "reads", "modified", "file_lines", "lines", "core"),
    "coarse_clamp": with_views("""
, f AS (SELECT instance_id, path, n_lines, greatest(s, 1) AS s, CASE WHEN e < 0 OR e > n_lines THEN n_lines ELSE e END AS e FROM reads JOIN file_lines USING (path)),
x AS (SELECT DISTINCT instance_id, path, unnest(generate_series(least(s, e), greatest(s, e))) AS line FROM f WHERE s <= n_lines)
SELECT instance_id, path, min(line) AS s, max(line) AS e FROM (SELECT *, line - row_number() OVER (PARTITION BY instance_id, path ORDER BY line) AS g FROM x) GROUP BY instance_id, path, g
UNION SELECT instance_id, path, s, e FROM reads ANTI JOIN file_lines USING (path)""", "reads", "file_lines"),
    "refine_clip": with_views("""
, x AS (SELECT DISTINCT instance_id, path, unnest(generate_series(greatest(s, 1), least(e, n_lines))) AS line FROM preds JOIN file_lines USING (path) WHERE e >= s AND s <= n_lines),
k AS (SELECT instance_id, path, min(line) AS s, max(line) AS e FROM (SELECT *, line - row_number() OVER (PARTITION BY instance_id, path ORDER BY line) AS g FROM x) GROUP BY instance_id, path, g)
SELECT * FROM k UNION ALL SELECT instance_id, path, s, e FROM core ANTI JOIN k USING (instance_id, path)""", "reads", "modified", "file_lines", "preds", "lines", "core"),
    "read_provenance": with_views("SELECT instance_id, path, string_agg(traj_id || ':' || (s % 10) || ':' || s || ':' || e, ',' ORDER BY traj_id, s % 10, s, e) AS reads FROM reads GROUP BY 1, 2", "reads"),
    "lines_to_ranges": with_views("SELECT instance_id, path, min(line) AS s, max(line) AS e FROM (SELECT *, line - row_number() OVER (PARTITION BY instance_id, path ORDER BY line) AS g FROM (SELECT DISTINCT instance_id, path, s AS line FROM preds)) GROUP BY instance_id, path, g", "preds"),
    "snippet_spans": with_views("""
, j AS (SELECT instance_id, path, n_lines, s, CASE WHEN e = -1 THEN n_lines ELSE e END AS e FROM core JOIN file_lines USING (path)),
x AS (SELECT DISTINCT instance_id, path, unnest(generate_series(greatest(1, s - 3), least(n_lines, e + 3))) AS line FROM j WHERE n_lines > 60)
SELECT DISTINCT instance_id, path, 1 AS s, n_lines AS e FROM j WHERE n_lines <= 60
UNION ALL SELECT instance_id, path, min(line), max(line) FROM (SELECT *, line - row_number() OVER (PARTITION BY instance_id, path ORDER BY line) AS g FROM x) GROUP BY instance_id, path, g""", "reads", "modified", "file_lines", "lines", "core"),
    "apply_replies": with_views("""
, x AS (SELECT DISTINCT instance_id, path, unnest(generate_series(s, e)) AS line FROM preds WHERE e >= s)
SELECT instance_id, path, min(line) AS s, max(line) AS e FROM (SELECT *, line - row_number() OVER (PARTITION BY instance_id, path ORDER BY line) AS g FROM x) GROUP BY instance_id, path, g
UNION ALL SELECT instance_id, path, s, e FROM core ANTI JOIN x USING (instance_id, path)""", "reads", "modified", "preds", "lines", "core"),
    "context_window_k": with_views(
        """, s AS (SELECT DISTINCT traj_id, step_idx FROM m WHERE len(tool_calls) > 0)
SELECT DISTINCT m.traj_id, m.step_idx, role, length(content) AS n, md5(content) AS h,
       (EXISTS (SELECT 1 FROM s WHERE s.traj_id = m.traj_id AND s.step_idx = m.step_idx))::INT AS is_read
FROM m WHERE role IN ('user', 'assistant', 'tool') AND EXISTS (SELECT 1 FROM s WHERE s.traj_id = m.traj_id AND abs(s.step_idx - m.step_idx) <= 1)
""",
        "messages",
    ),
    "last_context": with_views(", d AS (SELECT DISTINCT traj_id, step_idx FROM m) SELECT traj_id, step_idx FROM d QUALIFY row_number() OVER (PARTITION BY traj_id ORDER BY step_idx DESC) <= 8", "messages"),
    "metric_prf": with_views(_PRF, *_SCORE),
    "metric_efficiency": with_views(_EFF, *_SCORE),
    "metric_files": with_views(_FILES, *_SCORE),
    "metric_regions": with_views(_REGIONS, *_SCORE),
    "metric_wcc": with_views(_WCC, *_SCORE),
    "metric_ndcg": with_views(_NDCG_BASE + _NDCG, *_SCORE),
    "metric_recall_budgets": with_views(_RECALL_BASE + _RECALLS, *_SCORE),
    "metric_first_hit": with_views(_FIRST, *_SCORE),
    "metric_prf_gt_lengths": with_views(_PRF, *_SCORE).replace(
        "LEFT JOIN file_lines USING (path))", "LEFT JOIN (SELECT * FROM file_lines SEMI JOIN (SELECT path FROM core UNION SELECT path FROM optional UNION SELECT path FROM reads WHERE s < 0) u USING (path)) USING (path))"
    ),
    "context_mass": with_views(f"""SELECT instance_id, count(*) AS kept_regions, count(DISTINCT path) AS unique_files, coalesce(sum(greatest(0, re - rs + 1)), 0)::BIGINT AS total_lines,
count(*) FILTER (WHERE e = -1)::DOUBLE / count(*) AS whole_file_share, coalesce(avg(greatest(0, re - rs + 1)), 0) AS avg_lines,
count(DISTINCT CASE WHEN MF.path IS NOT NULL THEN R.path END)::DOUBLE / count(DISTINCT R.path) AS main_share
FROM R LEFT JOIN MF USING (instance_id, path) WHERE side = 'p' GROUP BY 1""", *_SCORE),
    "top_k_budgets": with_views("SELECT instance_id, k AS top_k, count(*) AS n, count(DISTINCT path) AS files FROM preds, (VALUES (1), (3), (5), (10)) v(k) WHERE rank < k GROUP BY 1, 2", "preds"),
}
SQL["metric_all"] = with_views(
    f"{_NDCG_BASE[0:0]}, m1 AS ({_PRF}), m2 AS ({_EFF}), m3 AS ({_FILES}), m4 AS ({_REGIONS}), m5 AS (WITH {_WCC[1:]}), m6 AS (WITH {_NDCG_BASE[1:]} {_NDCG}), m7 AS (WITH {_RECALL_BASE[1:]} {_RECALLS}), m8 AS ({_FIRST}) "
    "SELECT * FROM m1 JOIN m2 USING (instance_id) JOIN m3 USING (instance_id) JOIN m4 USING (instance_id) JOIN m5 USING (instance_id) JOIN m6 USING (instance_id) JOIN m7 USING (instance_id) JOIN m8 USING (instance_id)",
    *_SCORE,
)
