"""Queries of reads by step, patches, entities, contexts and file-level ranking, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.text import split_lines
from tracewright.operators import contexts, entities, patches, runs, stats
from tracewright.operators import extract as ex
from tracewright.operators import retrieval as rt
from tracewright.plans.logs import _COMMAND
from tracewright.sources.tables import table

_CALL = "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
_TALK = f"""SELECT l_orderkey AS traj_id, 2 * l_linenumber AS step_idx, {_COMMAND} AS command, l_linenumber, l_partkey,
  CASE WHEN l_linenumber IN (2, 6) THEN concat('src/g', l_partkey % 9, '.py:', l_partkey % 90 + 1, ':hit') ELSE 'ok' END AS output FROM"""


def _talk(spark: SparkSession, d: str) -> DataFrame:
    """A talk per order: an assistant that runs one command per line of the order, as a bash block or, in line 4, by a tool, and the output after each; in line 5 it views a file too."""
    one = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_quantity")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")
    one.createOrReplaceTempView("tw_lines")
    said = spark.sql(f"{_TALK} tw_lines")
    call = lambda name, arguments: F.array(F.struct(F.lit("c").alias("id"), F.lit("function").alias("type"), F.struct(F.lit(name).alias("name"), arguments.alias("arguments")).alias("function"))).cast(_CALL)
    shell = call("execute_bash", F.to_json(F.struct("command")))
    view = call("str_replace_editor", F.concat(F.lit('{"command": "view", "path": "/w/v.py", "view_range": ['), "l_linenumber", F.lit(", "), F.expr("l_partkey % 50 + 10"), F.lit("]}")))
    asks = said.select(
        "traj_id", "step_idx", F.lit("assistant").alias("role"), F.when(F.col("l_linenumber") != 4, F.concat(F.lit("Look.\n```bash\n"), "command", F.lit("\n```"))).alias("content"),
        F.when(F.col("l_linenumber") == 4, shell).when(F.col("l_linenumber") == 5, view).alias("tool_calls"), F.col("l_partkey").alias("tokens"),
    )
    answers = said.select("traj_id", (F.col("step_idx") + 1).alias("step_idx"), F.lit("user").alias("role"), F.col("output").alias("content"), F.lit(None).cast(_CALL).alias("tool_calls"), F.lit(None).cast("bigint").alias("tokens"))
    return asks.unionByName(answers)


def reads_by_step(spark, d):
    return ex.reads_by_step(_talk(spark, d))


def logged_commands(spark, d):
    return ex.logged_commands(_talk(spark, d), tokens="tokens")


def logged_paths(spark, d):
    c = ex.logged_commands(_talk(spark, d))
    return c.select("traj_id", "command_no", F.explode(ex.logged_paths(F.col("command"))).alias("path"))


def edited_files(spark, d):
    return ex.file_operations(ex.segments(ex.logged_commands(_talk(spark, d)), "command"), ["traj_id"], "segment")


def file_reading(spark, d):
    """Reads of regions, edits by patches, over all files of all trajectories."""
    r = table(spark, d, "context_regions").filter("path is not null").dropDuplicates(["region_id"])
    lines = F.when(F.col("end_line") >= F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    return stats.file_reading(r.select("path", lines.alias("n_lines")), ex.diff_files(table(spark, d, "trajectories"), ["traj_id"], "patch"))


def _outcomes(spark, d):
    t = table(spark, d, "trajectories").select("traj_id", "exit_status", "patch").dropDuplicates(["traj_id"])
    status = F.lower(F.trim("exit_status"))
    return t.select(F.col("traj_id").alias("instance_id"), F.coalesce(status == "submitted", F.lit(False)).alias("resolved"), F.when(F.col("patch").isNull(), "no patch").alias("error"))


def resolve_states(spark, d):
    return stats.resolve_states(_outcomes(spark, d))


def resolve_summary(spark, d):
    return stats.resolve_summary(_outcomes(spark, d))


def process_outcomes(spark, d):
    p = table(spark, d, "orders").selectExpr("o_orderkey", "cast(case when o_orderkey % 7 = 0 then 127 else o_orderkey % 3 end as int) as return_code", "o_orderkey % 11 = 0 as timed_out", "o_orderkey % 5 = 0 as has_errors", "o_orderkey % 2 = 0 as has_answer")
    return p.groupBy(runs.outcome_of().alias("outcome")).agg(F.count("*").alias("n"))


def secret_names(spark, d):
    names = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("concat(element_at(array('max', 'npm', 'input', 'author', 'api', 'limit', ''), cast(p_partkey % 7 as int) + 1), '_', element_at(array('token', 'Key', 'tokenizer', 'auth', 'cookies', 'name'), cast(p_size % 6 as int) + 1))").alias("name"))
    return names.select("id", "name", runs.secret_name(F.col("name")).alias("secret"))


def dense_files(spark, d):
    """Whole files by cosine, whatever its sign: every hundredth vector asks all others."""
    e = table(spark, d, "embeddings")
    return rt.dense_files(e, e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank", "s", "e")


def patch_hunks(spark, d):
    return patches.hunks(table(spark, d, "trajectories").dropDuplicates(["traj_id"]), ["traj_id"], "patch")


def _patch_runs(spark, d):
    t = table(spark, d, "trajectories").dropDuplicates(["traj_id"])
    key = F.col("traj_id").alias("instance_id")
    texts = t.select(key, F.lit("info.submission").alias("source"), F.col("patch").alias("text")).unionByName(t.select(key, F.lit("tool.content").alias("source"), F.col("submission").alias("text")))
    regions = table(spark, d, "context_regions").filter("path is not null and start_line > 0 and end_line >= start_line").select(
        F.col("traj_id").alias("instance_id"), "path", F.col("start_line").cast("bigint").alias("s"), F.col("end_line").cast("bigint").alias("e"), F.lit(0).cast("bigint").alias("n_lines")
    )
    return t.select(key, "exit_status", F.lit("").alias("prediction")), texts, regions


def patch_diagnoses(spark, d):
    return patches.diagnoses(*_patch_runs(spark, d))


def patch_repairs(spark, d):
    t = table(spark, d, "trajectories").dropDuplicates(["traj_id"])
    return t.select("traj_id", F.md5(patches.repaired_patch(F.col("patch"))).alias("repaired"), F.md5(patches.diff_of(F.col("submission"))).alias("found"))


def entity_lines(spark, d):
    """Functions and classes of all chunks that can be parsed alone, each chunk a file of its own."""
    c = table(spark, d, "chunks").select(F.concat_ws("#", "repo", "chunk_id").alias("repo"), "path", F.col("content").alias("text"))
    return entities.entity_table(c)


def answer_entities(spark, d):
    """Answers that name each file of a part by a list, with and without bounds."""
    p = table(spark, d, "part").selectExpr("p_partkey as instance_id", "concat('[{\"rel_file_path\": \"./src/f', p_partkey % 9, '.py\", \"start\": ', p_size, '}, {\"rel_file_path\": \"\"}, {\"rel_file_path\": \"g.py\", \"start\": 0, \"end\": ', p_size + 3, '}]') as answer")
    return entities.listed_locations(p)


def context_records(spark, d):
    """Contexts of all trajectories as instances: regions from line 1 on as core, others as optional, contents from the first chunk of a file."""
    r = table(spark, d, "context_regions").filter("path is not null and start_line > 0 and end_line >= start_line and traj_id is not null")
    t = table(spark, d, "trajectories").select("traj_id", "repo", "issue").dropDuplicates(["traj_id"])
    own = r.select("traj_id", "path", F.col("start_line").cast("bigint").alias("s"), F.col("end_line").cast("bigint").alias("e")).join(t.select("traj_id", "repo"), "traj_id").withColumnRenamed("traj_id", "instance_id")
    files = (
        table(spark, d, "chunks").filter("content is not null and start_line = 1")
        .groupBy("repo", "path").agg(F.min("content").alias("content")).select("repo", "path", split_lines(F.col("content"), "\n").alias("lines"))
    )
    changed = ex.diff_files(table(spark, d, "trajectories"), ["traj_id"], "patch").withColumnRenamed("traj_id", "instance_id")
    c = contexts.context_records(own.filter("s <= 20"), own.filter("s > 20"), t.select(F.col("traj_id").alias("instance_id"), "issue"), changed, files)
    text = lambda a: F.md5(F.concat_ws("|", F.transform(a, lambda x: F.concat_ws(":", x["path"], x["s"], x["e"], x["content"]))))
    return c.select("instance_id", "repo", F.size("core").alias("n_core"), F.size("optional").alias("n_optional"), text("core").alias("core"), text("optional").alias("optional"), F.array_join("modified_files", ",").alias("modified_files"))


def explorer_regions(spark, d):
    r = table(spark, d, "context_regions").filter("instance_id is not null and path is not null").dropDuplicates(["region_id"])
    rows = r.select("instance_id", F.col("region_id").alias("pos"), F.array(F.struct("path", F.col("start_line").alias("s"), F.col("end_line").alias("e"))).alias("regions"))
    return contexts.explorer_regions(rows)


def selected_trajectories(spark, d):
    t = table(spark, d, "trajectories").select("traj_id", "instance_id", "model", "repo").distinct()
    return contexts.selected_groups(t, model="a", repo="[a-m]/", least=3)


QUERIES = {
    f.__name__: f
    for f in (
        reads_by_step, logged_commands, logged_paths, edited_files, file_reading, resolve_states, resolve_summary, process_outcomes, secret_names, dense_files, patch_hunks, patch_diagnoses, patch_repairs,
        entity_lines, answer_entities, context_records, explorer_regions, selected_trajectories,
    )
}

_LINES = "lines AS (SELECT l_orderkey, l_linenumber, min(struct_pack(p := l_partkey, q := l_quantity)) AS x FROM lineitem GROUP BY 1, 2), one AS (SELECT l_orderkey, l_linenumber, x.p AS l_partkey, x.q AS l_quantity FROM lines)"
_SAID = f"{_LINES}, said AS ({_TALK} one)".replace("cast(l_quantity as int)", "l_quantity::INT")
_NO = "row_number() OVER (PARTITION BY traj_id ORDER BY step_idx) - 1"
_ONE_T = "t AS (SELECT DISTINCT ON (traj_id) * FROM trajectories)"
_NUMBERED = f"c AS (SELECT traj_id, {_NO} AS command_no, command, l_partkey AS tokens FROM said WHERE l_linenumber <> 4)"

SQL = {
    "reads_by_step": f"""WITH {_SAID},
n AS (SELECT *, CASE WHEN output <> 'ok' THEN split_part(output, ':', 1) END AS hit_path, CASE WHEN output <> 'ok' THEN split_part(output, ':', 2)::BIGINT END AS hit FROM said)
SELECT traj_id, step_idx, 'src/f' || (l_partkey % 20) || '.py' AS path, 1 AS s, -1 AS e FROM n WHERE l_linenumber = 1
UNION ALL SELECT traj_id, step_idx, 'src/f' || (l_partkey % 20) || '.py', 1, regexp_extract(command, '-n (\\d+)', 1)::BIGINT FROM n WHERE l_linenumber = 2
UNION ALL SELECT traj_id, step_idx, 'src/f' || (l_partkey % 20) || '.py', -regexp_extract(command, '-n (\\d+)', 1)::BIGINT, -1 FROM n WHERE l_linenumber = 3
UNION ALL SELECT traj_id, step_idx, 'src/f' || (l_partkey % 20) || '.py', regexp_extract(command, '''(\\d+),(\\d+)p', 1)::BIGINT, regexp_extract(command, '''(\\d+),(\\d+)p', 2)::BIGINT FROM n WHERE l_linenumber = 4
UNION ALL SELECT traj_id, step_idx, '/w/v.py', l_linenumber, l_partkey % 50 + 10 FROM n WHERE l_linenumber = 5
UNION ALL SELECT traj_id, step_idx, 'src/f' || (l_partkey % 20) || '.py', 1, -1 FROM n WHERE l_linenumber = 6
UNION ALL SELECT traj_id, step_idx, 'a/f' || (l_partkey % 20) || '.py', 1, -1 FROM n WHERE l_linenumber >= 7
UNION ALL SELECT traj_id, step_idx, 'b.md', 1, 5 FROM n WHERE l_linenumber >= 7""",
    "logged_commands": f"WITH {_SAID}, {_NUMBERED} SELECT traj_id, command_no, command, tokens FROM c",
    "logged_paths": f"""WITH {_SAID}, {_NUMBERED}, w AS (SELECT traj_id, command_no, unnest(string_split_regex(command, '\\s+')) AS w FROM c)
SELECT DISTINCT traj_id, command_no, trim(w, '''"') AS path FROM w WHERE contains(w, '/') AND regexp_matches(trim(w, '''"'), '\\.(py|md)$')""",
    "edited_files": f"WITH {_SAID} SELECT DISTINCT traj_id, regexp_extract(command, 'sed -i \\S+ (\\S+)', 1) AS path FROM said WHERE l_linenumber = 6",
    "file_reading": """WITH r AS (SELECT DISTINCT region_id, path, CASE WHEN end_line >= start_line THEN end_line - start_line + 1 END AS n FROM context_regions WHERE path IS NOT NULL),
p AS (SELECT path, coalesce(sum(n), 0) AS n FROM r GROUP BY 1), l AS (SELECT unnest(string_split(patch, chr(10))) AS l FROM trajectories WHERE patch IS NOT NULL),
e AS (SELECT DISTINCT regexp_extract(l, '^diff --git a/(.+?) b/', 1) AS path FROM l WHERE regexp_matches(l, '^diff --git a/.+? b/') UNION SELECT regexp_extract(l, '^\\+\\+\\+ b/(.+)$', 1) FROM l WHERE regexp_matches(l, '^\\+\\+\\+ b/.+$')),
m AS (SELECT p.n, e.path IS NOT NULL AS edited FROM p LEFT JOIN e USING (path))
SELECT count(*) AS n_read, count(*) FILTER (WHERE edited) AS n_edited, count(*) FILTER (WHERE NOT edited) AS n_read_only, 100.0::DOUBLE * count(*) FILTER (WHERE edited) / count(*) AS edit_pct,
  100.0::DOUBLE * count(*) FILTER (WHERE NOT edited) / count(*) AS read_only_pct, avg(n) AS mean_lines FROM m""",
    "resolve_states": f"""WITH {_ONE_T}, o AS (SELECT traj_id, coalesce(lower(trim(exit_status)) = 'submitted', false) AS r, patch IS NULL AS f FROM t)
SELECT traj_id AS instance_id, 'resolved' AS state FROM o WHERE r UNION ALL SELECT traj_id, 'error' FROM o WHERE f UNION ALL SELECT traj_id, 'unresolved' FROM o WHERE NOT r AND NOT f""",
    "resolve_summary": f"""WITH {_ONE_T}, o AS (SELECT coalesce(lower(trim(exit_status)) = 'submitted', false) AS r, patch IS NULL AS f FROM t)
SELECT count(*) AS total, count(*) FILTER (WHERE r) AS resolved, count(*) FILTER (WHERE NOT r AND NOT f) AS unresolved, count(*) FILTER (WHERE f) AS errors, count(*) FILTER (WHERE r)::DOUBLE / count(*) AS resolve_rate FROM o""",
    "process_outcomes": """WITH p AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 127 ELSE o_orderkey % 3 END AS rc, o_orderkey % 11 = 0 AS late, o_orderkey % 5 = 0 AS err, o_orderkey % 2 = 0 AS ans FROM orders)
SELECT CASE WHEN late THEN 'timeout' WHEN rc = 127 THEN 'binary_not_found' WHEN ans THEN 'success' WHEN err THEN 'provider_error' WHEN rc <> 0 THEN 'error' ELSE 'invalid_output' END AS outcome, count(*) AS n FROM p GROUP BY 1""",
    "secret_names": """WITH n AS (SELECT p_partkey AS id, ['max', 'npm', 'input', 'author', 'api', 'limit', ''][(p_partkey % 7)::INT + 1] || '_' || ['token', 'Key', 'tokenizer', 'auth', 'cookies', 'name'][(p_size % 6)::INT + 1] AS name FROM part)
SELECT id, name, (split_part(name, '_', 1) NOT IN ('max', 'limit') AND split_part(name, '_', 2) IN ('token', 'Key', 'cookies')) OR name = '_auth' AS secret FROM n""",
    "dense_files": """WITH x AS (SELECT q.vec_id AS query_id, v.vec_id,
  list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))) AS c FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, round(c, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS rank, 1 AS s, -1 AS e FROM x QUALIFY rank <= 5""",
    "patch_hunks": f"""WITH {_ONE_T}, l AS (SELECT traj_id, unnest(a) AS l, unnest(range(len(a))) AS i FROM (SELECT traj_id, string_split(patch, chr(10)) AS a FROM t WHERE patch IS NOT NULL)),
h AS (SELECT *, count(*) FILTER (WHERE starts_with(l, 'diff --git ')) OVER (PARTITION BY traj_id ORDER BY i) AS part FROM l),
f AS (SELECT traj_id, part, arg_min(regexp_extract(l, '^\\+\\+\\+ b/([^\\t]+)', 1), i) FILTER (WHERE regexp_matches(l, '^\\+\\+\\+ b/[^\\t]+')) AS new_path, arg_min(regexp_extract(l, '^--- a/([^\\t]+)', 1), i) FILTER (WHERE regexp_matches(l, '^--- a/[^\\t]+')) AS old_path,
  arg_min(regexp_extract(l, '^diff --git a/(\\S+)', 1), i) FILTER (WHERE starts_with(l, 'diff --git ')) AS head_path FROM h GROUP BY 1, 2),
n AS (SELECT traj_id, part, regexp_extract(l, '^@@ -(\\d+)', 1)::BIGINT AS s, coalesce(nullif(regexp_extract(l, '^@@ -\\d+,(\\d+)', 1), '')::BIGINT, 1) AS n, row_number() OVER (PARTITION BY traj_id, part ORDER BY i) - 1 AS hunk_no
  FROM h WHERE regexp_matches(l, '^@@ -\\d+(,\\d+)? \\+\\d+(,\\d+)? @@'))
SELECT traj_id, coalesce(new_path, old_path, head_path, '') AS path, hunk_no, s, greatest(s, s + n - 1) AS e FROM n JOIN f USING (traj_id, part)""",
    "answer_entities": """SELECT p_partkey AS instance_id, 0 AS pos, 'src/f' || (p_partkey % 9) || '.py' AS path, p_size::BIGINT AS s, -1 AS e FROM part UNION ALL SELECT p_partkey, 2, 'g.py', 1, p_size + 3 FROM part""",
    "context_records": f"""WITH {_ONE_T}, f AS (SELECT repo, path, min(content) AS content FROM chunks WHERE content IS NOT NULL AND start_line = 1 GROUP BY 1, 2),
l AS (SELECT repo, path, CASE WHEN content = '' THEN [] WHEN content[-1] = chr(10) THEN string_split(content, chr(10))[:-2] ELSE string_split(content, chr(10)) END AS a FROM f),
r AS (SELECT DISTINCT c.traj_id, t.repo, c.path, start_line AS s, end_line AS e FROM context_regions c JOIN t USING (traj_id) WHERE c.path IS NOT NULL AND start_line > 0 AND end_line >= start_line),
x AS (SELECT r.*, array_to_string(a[least(s, len(a)):least(e, len(a))], chr(10)) AS body FROM r JOIN l USING (repo, path) WHERE len(a) > 0),
y AS (SELECT *, path || ':' || s || ':' || e || ':' || body AS line FROM x WHERE body <> ''),
g AS (SELECT traj_id, repo, count(*) FILTER (WHERE s <= 20) AS n_core, count(*) FILTER (WHERE s > 20) AS n_optional, md5(coalesce(string_agg(line, '|' ORDER BY path COLLATE "C", s, e) FILTER (WHERE s <= 20), '')) AS core,
  md5(coalesce(string_agg(line, '|' ORDER BY path COLLATE "C", s, e) FILTER (WHERE s > 20), '')) AS optional FROM y GROUP BY 1, 2),
p AS (SELECT traj_id, unnest(string_split(patch, chr(10))) AS l FROM trajectories WHERE patch IS NOT NULL),
e AS (SELECT DISTINCT traj_id, regexp_extract(l, '^diff --git a/(.+?) b/', 1) AS path FROM p WHERE regexp_matches(l, '^diff --git a/.+? b/') UNION SELECT traj_id, regexp_extract(l, '^\\+\\+\\+ b/(.+)$', 1) FROM p WHERE regexp_matches(l, '^\\+\\+\\+ b/.+$')),
m AS (SELECT traj_id, string_agg(path, ',' ORDER BY path) AS modified_files FROM e GROUP BY 1)
SELECT g.traj_id AS instance_id, g.repo, n_core::INT AS n_core, n_optional::INT AS n_optional, core, optional, coalesce(modified_files, '') AS modified_files FROM g JOIN t USING (traj_id) LEFT JOIN m USING (traj_id) WHERE n_core > 0 AND trim(coalesce(issue, '')) <> ''""".replace(' COLLATE "C"', ""),
    "explorer_regions": "SELECT instance_id, 0 AS rank, path, start_line AS s, end_line AS e FROM (SELECT DISTINCT ON (region_id) * FROM context_regions WHERE instance_id IS NOT NULL AND path IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY instance_id ORDER BY region_id DESC) = 1",
    "selected_trajectories": """WITH k AS (SELECT DISTINCT traj_id, instance_id, model, repo FROM trajectories WHERE contains(coalesce(model, ''), 'a') AND regexp_matches(coalesce(repo, ''), '[a-m]/'))
SELECT * FROM k WHERE instance_id IN (SELECT instance_id FROM k GROUP BY 1 HAVING count(*) >= 3)""",
}
