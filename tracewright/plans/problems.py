"""Queries of the general data problems (3, 5, 6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.operators import drift, nesting, sweep
from tracewright.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.read_stretches(table(spark, sf_dir, "context_regions"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.file_changes(table(spark, sf_dir, "raw_records"))


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.unified_table(table(spark, sf_dir, "raw_records"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nesting.nested_nodes(table(spark, sf_dir, "opencode_events"), table(spark, sf_dir, "messages"), values=False)


def p6_token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nesting.token_totals(table(spark, sf_dir, "opencode_events"))


QUERIES = {f.__name__: f for f in (p3_found, p5_found, p5_table, p6_found, p6_token_totals)}

SQL = {
    "p3_found": """
WITH r AS (
  SELECT traj_id, replace(path, '\\', '/') AS p,
         CASE WHEN start_line IS NULL OR start_line = 0 THEN 1 ELSE start_line END::BIGINT AS s, end_line
  FROM context_regions WHERE path IS NOT NULL AND (start_line IS NULL OR start_line >= 0)),
r2 AS (
  SELECT traj_id, s,
         CASE WHEN end_line IS NULL OR end_line = -1 THEN 2147483647 ELSE greatest(s, end_line) END AS e,
         array_to_string(list_reduce(list_prepend([], list_transform(string_split(CASE WHEN p LIKE '/repo/%' THEN p[7:] ELSE p END, '/'), lambda x: [x])),
           lambda a, x: CASE WHEN x[1] IN ('', '.') THEN a WHEN x[1] = '..' THEN a[:len(a) - 1] ELSE list_concat(a, x) END), '/') AS path
  FROM r),
o AS (
  SELECT *, max(e) OVER (PARTITION BY traj_id, path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM (SELECT DISTINCT traj_id, path, s, e FROM r2 WHERE path <> '')),
i AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY traj_id, path ORDER BY s, e) AS island FROM o),
c AS (SELECT traj_id, path, island, min(s) AS a, max(e) AS b FROM i GROUP BY ALL),
n AS (SELECT *, lead(a) OVER (PARTITION BY traj_id, path ORDER BY a) AS nxt FROM c)
SELECT traj_id, path, 'covered' AS kind, a::INT AS first_line, (CASE WHEN b = 2147483647 THEN -1 ELSE b END)::INT AS last_line FROM c
UNION ALL
SELECT traj_id, path, 'gap', (b + 1)::INT, (nxt - 1)::INT FROM n WHERE nxt IS NOT NULL
""",
    "p5_found": """
WITH r AS (SELECT DISTINCT feed, file_name, CASE WHEN json_valid(raw_line) AND json_type(raw_line) = 'OBJECT' THEN raw_line ELSE '{}' END AS line FROM raw_records WHERE feed IS NOT NULL AND file_name IS NOT NULL),
f AS (SELECT feed, file_name, row_number() OVER (PARTITION BY feed ORDER BY file_name) AS n FROM (SELECT DISTINCT feed, file_name FROM r)),
v0 AS (SELECT feed, n, json_extract_string(line, '$.id') AS rec_key, e.key AS field, e.value AS value, json_type(e.value) AS t, json_extract_string(e.value, '$') AS s
       FROM r JOIN f USING (feed, file_name), json_each(r.line) e),
v AS (SELECT feed, n, rec_key, field, CASE t WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'VARCHAR' THEN 'string' ELSE 'number' END AS kind,
        CASE WHEN t = 'VARCHAR' THEN CASE WHEN regexp_matches(s, '^\\s*[\\[{]') AND json_valid(s) THEN json(s)::VARCHAR ELSE s END ELSE json(value)::VARCHAR END AS h FROM v0 WHERE t <> 'NULL'),
k AS (SELECT feed, n, field, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kind FROM v GROUP BY ALL),
b AS (SELECT coalesce(w.feed, o.feed) AS feed, coalesce(w.n, o.n + 1) AS n, coalesce(w.field, o.field) AS field, w.kind AS new_kind, o.kind AS old_kind
      FROM k w FULL JOIN k o ON w.feed = o.feed AND w.n = o.n + 1 AND w.field = o.field),
b2 AS (SELECT b.* FROM b JOIN f USING (feed, n) WHERE n > 1 AND new_kind IS DISTINCT FROM old_kind),
was AS (SELECT DISTINCT v.feed, b2.n, v.rec_key, v.field AS old_field, h FROM v JOIN b2 ON b2.feed = v.feed AND b2.n = v.n + 1 AND b2.field = v.field AND new_kind IS NULL),
now AS (SELECT DISTINCT v.feed, b2.n, v.rec_key, v.field AS new_field, h FROM v JOIN b2 ON b2.feed = v.feed AND b2.n = v.n AND b2.field = v.field AND old_kind IS NULL),
seen AS (SELECT feed, n, old_field, new_field, count(*) AS seen FROM (SELECT DISTINCT feed, n, rec_key, old_field FROM was) JOIN (SELECT DISTINCT feed, n, rec_key, new_field FROM now) USING (feed, n, rec_key) GROUP BY ALL),
same AS (SELECT feed, n, old_field, new_field, count(DISTINCT rec_key) AS same FROM was JOIN now USING (feed, n, rec_key, h) GROUP BY ALL),
common AS (SELECT feed, n, old_field, new_field, count(*) AS common FROM (SELECT DISTINCT feed, n, old_field, h FROM was) JOIN (SELECT DISTINCT feed, n, new_field, h FROM now) USING (feed, n, h) GROUP BY ALL),
j AS (
  SELECT feed, n, old_field, new_field, coalesce(seen, 0) AS seen, coalesce(same, 0) AS same, coalesce(common, 0) / (no + nn - coalesce(common, 0))::DOUBLE AS alike
  FROM seen FULL JOIN same USING (feed, n, old_field, new_field) FULL JOIN common USING (feed, n, old_field, new_field)
  JOIN (SELECT feed, n, old_field, count(DISTINCT h) AS no FROM was GROUP BY ALL) USING (feed, n, old_field) JOIN (SELECT feed, n, new_field, count(DISTINCT h) AS nn FROM now GROUP BY ALL) USING (feed, n, new_field)),
q AS (
  SELECT * FROM j WHERE CASE WHEN seen >= 2 THEN same >= 0.6 * seen ELSE alike >= 0.5 END
  QUALIFY row_number() OVER (PARTITION BY feed, n, old_field ORDER BY same DESC, alike DESC, old_field, new_field) = 1 AND row_number() OVER (PARTITION BY feed, n, new_field ORDER BY same DESC, alike DESC, old_field, new_field) = 1),
c AS (
  SELECT feed, n, 'added' AS change_kind, field AS field_name, '' AS new_value FROM b2 WHERE old_kind IS NULL AND (feed, n, field) NOT IN (SELECT (feed, n, new_field) FROM q)
  UNION ALL SELECT feed, n, 'removed', field, '' FROM b2 WHERE new_kind IS NULL AND (feed, n, field) NOT IN (SELECT (feed, n, old_field) FROM q)
  UNION ALL SELECT feed, n, 'renamed', old_field, new_field FROM q
  UNION ALL SELECT feed, n, 'retyped', field, new_kind FROM b2 WHERE new_kind IS NOT NULL AND old_kind IS NOT NULL
  UNION ALL SELECT q.feed, q.n, 'retyped', q.new_field, w.kind FROM q JOIN k w ON w.feed = q.feed AND w.n = q.n AND w.field = q.new_field JOIN k o ON o.feed = q.feed AND o.n = q.n - 1 AND o.field = q.old_field WHERE w.kind <> o.kind)
SELECT file_name, change_kind, field_name, new_value FROM c JOIN f USING (feed, n)
""",
    "p6_found": """
WITH RECURSIVE c AS (
  SELECT DISTINCT msg_id, unnest(tool_calls) AS call, unnest(range(len(tool_calls))) AS pos FROM messages WHERE msg_id IS NOT NULL),
o AS (SELECT DISTINCT event_id, part.state.output AS o FROM opencode_events WHERE event_id IS NOT NULL AND part.state.output IS NOT NULL),
t AS (
  SELECT 'event' AS k, event_id AS id, '' AS p, CASE WHEN regexp_matches(o, '(?s)<task_result>.*?</task_result>') THEN regexp_extract(o, '(?s)<task_result>(.*?)</task_result>', 1) ELSE o END AS t FROM o
  UNION ALL SELECT 'message', msg_id, pos::VARCHAR, call.function.arguments FROM c WHERE call IS NOT NULL),
j AS (SELECT k, id, p, CASE WHEN json_valid(t) AND json_type(t) = 'VARCHAR' THEN json_extract_string(t, '$') ELSE t END AS t FROM t WHERE regexp_matches(t, '^\\s*[\\[{"]')),
r AS (SELECT k, id, p, t::JSON AS v FROM j WHERE json_valid(t) AND (json_type(t) = 'OBJECT' OR (json_type(t) = 'ARRAY' AND k = 'event'))),
w AS (
  SELECT k, id, p AS parent, p AS path, CASE WHEN json_type(v) = 'ARRAY' THEN 'items' END AS in_list, false AS node, NULL::VARCHAR AS node_kind, p AS above, v FROM r
  UNION ALL
  SELECT k, id, above, CASE WHEN new.step IS NULL THEN path WHEN path = '' THEN new.step ELSE path || '.' || new.step END, new.in_list, new.node, new.node_kind,
         CASE WHEN new.node THEN CASE WHEN path = '' THEN new.step ELSE path || '.' || new.step END ELSE above END, x
  FROM (SELECT w.k, w.id, w.above, w.path, e.value AS x,
          CASE WHEN w.in_list IS NOT NULL AND json_type(e.value) = 'OBJECT' THEN {'step': e.key, 'in_list': NULL::VARCHAR, 'node': true, 'node_kind': w.in_list}
               WHEN w.in_list IS NOT NULL AND json_type(e.value) = 'ARRAY' THEN {'step': e.key, 'in_list': w.in_list, 'node': false, 'node_kind': NULL}
               WHEN w.in_list IS NULL AND e.key IN ('subtasks', 'files', 'hits', 'edits', 'hunks') AND json_type(e.value) = 'OBJECT' THEN {'step': '0', 'in_list': NULL, 'node': true, 'node_kind': e.key}
               WHEN w.in_list IS NULL AND e.key IN ('subtasks', 'files', 'hits', 'edits', 'hunks') AND json_type(e.value) = 'ARRAY' THEN {'step': NULL, 'in_list': e.key, 'node': false, 'node_kind': NULL}
               WHEN w.in_list IS NULL AND e.key NOT IN ('subtasks', 'files', 'hits', 'edits', 'hunks') AND json_type(e.value) = 'OBJECT' THEN {'step': NULL, 'in_list': NULL, 'node': false, 'node_kind': NULL} END AS new
        FROM w, json_each(w.v) e) WHERE new IS NOT NULL)
SELECT DISTINCT k AS record_kind, id AS record_id, parent AS parent_path, path AS node_path, node_kind FROM w WHERE node
UNION SELECT DISTINCT 'message', msg_id, '', pos::VARCHAR, 'tool_calls' FROM c WHERE call IS NOT NULL
""",
    "p6_token_totals": """
SELECT sessionid, count(*) AS n_steps, sum(coalesce(g, i + o + r + w + c))::BIGINT AS total, sum(i)::BIGINT AS input, sum(o)::BIGINT AS output,
       sum(r)::BIGINT AS reasoning, sum(w)::BIGINT AS cache_write, sum(c)::BIGINT AS cache_read
FROM (SELECT DISTINCT event_id, sessionid, part.tokens.total AS g, coalesce(part.tokens.input, 0) AS i, coalesce(part.tokens.output, 0) AS o,
             coalesce(part.tokens.reasoning, 0) AS r, coalesce(part.tokens.cache.write, 0) AS w, coalesce(part.tokens.cache.read, 0) AS c
      FROM opencode_events WHERE part.tokens IS NOT NULL)
GROUP BY sessionid
""",
}
