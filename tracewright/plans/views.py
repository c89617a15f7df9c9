"""Views in the shape of the operators' inputs, derived from the given tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import turns
from tracewright.sources.tables import table


def reads(spark: SparkSession, d: str) -> DataFrame:
    """(instance_id, traj_id, model, path, s, e): explicit ranges, reads to the end (e = -1), and tails (s < 0)."""
    tail = "l_linenumber = 6 and l_returnflag = 'A'"
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey div 100 as instance_id",
        "l_suppkey % 3 as traj_id",
        "concat('m', (l_suppkey % 3) % 2) as model",
        "concat('f', l_partkey % 20, '.py') as path",
        f"case when {tail} then -(1 + cast(l_quantity as bigint) % 8) else cast(l_quantity as bigint) end as s",
        f"case when l_linenumber = 7 or ({tail}) then -1 else cast(l_quantity as bigint) + 2 * l_linenumber end as e",
    )


def modified(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").filter("l_linenumber <= 2").selectExpr(
        "l_orderkey div 100 as instance_id", "l_suppkey % 3 as traj_id", "concat('f', l_partkey % 20, '.py') as path"
    ).distinct()


def file_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of f0 to f17; f18 and f19 have none."""
    return (
        table(spark, d, "part").filter("p_partkey % 20 < 18")
        .groupBy(F.expr("concat('f', p_partkey % 20, '.py')").alias("path")).agg((F.max("p_size") + 20).alias("n_lines"))
    )


def preds(spark: SparkSession, d: str) -> DataFrame:
    """(instance_id, rank from 0, path, s, e): some to the end, some inverted, some of files nobody labelled."""
    from pyspark.sql import Window

    e = table(spark, d, "events")
    order = Window.partitionBy("instance_id").orderBy("ts", "event_id")
    s = F.when(F.col("event_type") == "error", 1).otherwise(1 + F.floor("value") % 60)
    end = F.when(F.col("event_type") == "error", -1).when(F.col("event_id") % 97 == 0, s - 1).otherwise(s + 2 * F.length("event_type"))
    return e.withColumn("instance_id", F.expr("event_id div 66")).select(
        "instance_id", (F.row_number().over(order) - 1).alias("rank"), F.expr("concat('f', user_id % 25, '.py')").alias("path"),
        s.cast("bigint").alias("s"), end.cast("bigint").alias("e"),
    )


def messages(spark: SparkSession, d: str) -> DataFrame:
    """All messages, once each, with their speaker as role and their place in the conversation as step_idx."""
    return turns.numbered_messages(table(spark, d, "messages"))


#: The order of a conversation and its speakers: see the rules of conversations in the description of the tables.
_MESSAGES = """m0 AS (SELECT DISTINCT ON (msg_id) msg_id, traj_id, step_idx, sent_at, content, tool_calls, tool_call_id, role, lower(trim(role, ' ' || chr(9) || chr(10) || chr(13))) AS r,
      list_transform(list_filter(coalesce(tool_calls, []), lambda c: c IS NOT NULL), lambda c: c.id) AS ids FROM messages WHERE traj_id IS NOT NULL AND msg_id IS NOT NULL),
    m1 AS (SELECT *, CASE WHEN r IN ('system', 'developer') THEN 'system' WHEN r IN ('user', 'human') THEN 'user' WHEN r IN ('assistant', 'ai', 'model') THEN 'assistant'
        WHEN r IN ('tool', 'function', 'observation') THEN 'tool' WHEN coalesce(r, '') <> '' THEN NULL WHEN tool_call_id IS NOT NULL THEN 'tool' ELSE 'assistant' END AS speaker,
      count(step_idx) OVER c = count(*) OVER c AS stepped, count(DISTINCT step_idx) OVER c = count(*) OVER c AS own FROM m0 WINDOW c AS (PARTITION BY traj_id)),
    m2 AS (SELECT DISTINCT ON (traj_id, id) traj_id, id AS tool_call_id, sent_at AS asked_at, msg_id AS asker, pos
      FROM (SELECT traj_id, msg_id, sent_at, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM m1) WHERE id IS NOT NULL ORDER BY traj_id, id, asked_at NULLS FIRST, asker, pos),
    m3 AS (SELECT m1.*, coalesce(asked_at = sent_at, false) AND speaker = 'tool' AS same, asker, pos FROM m1 LEFT JOIN m2 USING (traj_id, tool_call_id)),
    m AS (SELECT traj_id, msg_id, coalesce(speaker, lower(trim(role, ' '))) AS role, content, tool_calls, tool_call_id,
      (CASE WHEN own THEN step_idx ELSE row_number() OVER (PARTITION BY traj_id ORDER BY CASE WHEN stepped THEN step_idx END NULLS FIRST, coalesce(sent_at, '9999-12-31'),
        CASE WHEN same THEN 3 WHEN speaker = 'tool' THEN 0 WHEN speaker = 'system' THEN 1 WHEN speaker = 'user' THEN 2 WHEN len(ids) > 0 THEN 3 ELSE 4 END,
        CASE WHEN same THEN asker ELSE msg_id END, CASE WHEN speaker = 'tool' THEN coalesce(pos, 0) + 1 ELSE 0 END, msg_id) - 1 END)::INT AS step_idx FROM m3)"""

#: Common table expressions, to be put before a statement by :func:`with_views`. L lists the lines of
#: a read one by one, up to 200 for reads to the end: all given ends are below that.
SQL_VIEWS = {
    "messages": _MESSAGES,
    "reads": """reads AS (SELECT l_orderkey // 100 AS instance_id, l_suppkey % 3 AS traj_id, 'm' || ((l_suppkey % 3) % 2) AS model,
      'f' || (l_partkey % 20) || '.py' AS path,
      CASE WHEN l_linenumber = 6 AND l_returnflag = 'A' THEN -(1 + l_quantity::BIGINT % 8) ELSE l_quantity::BIGINT END AS s,
      CASE WHEN l_linenumber = 7 OR (l_linenumber = 6 AND l_returnflag = 'A') THEN -1 ELSE l_quantity::BIGINT + 2 * l_linenumber END AS e
      FROM lineitem)""",
    "modified": """modified AS (SELECT DISTINCT l_orderkey // 100 AS instance_id, l_suppkey % 3 AS traj_id, 'f' || (l_partkey % 20) || '.py' AS path
      FROM lineitem WHERE l_linenumber <= 2)""",
    "file_lines": """file_lines AS (SELECT 'f' || (p_partkey % 20) || '.py' AS path, max(p_size) + 20 AS n_lines FROM part WHERE p_partkey % 20 < 18 GROUP BY 1)""",
    "preds": """preds0 AS (SELECT event_id // 66 AS instance_id, row_number() OVER (PARTITION BY event_id // 66 ORDER BY ts, event_id) - 1 AS rank,
      'f' || (user_id % 25) || '.py' AS path, event_type, event_id,
      CASE WHEN event_type = 'error' THEN 1 ELSE 1 + floor(value)::BIGINT % 60 END AS s FROM events),
    preds AS (SELECT instance_id, rank, path, s, CASE WHEN event_type = 'error' THEN -1 WHEN event_id % 97 = 0 THEN s - 1
      ELSE s + 2 * length(event_type) END AS e FROM preds0)""",
    "lines": """L AS (SELECT DISTINCT instance_id, traj_id, model, path, unnest(generate_series(s, CASE WHEN e = -1 THEN 200 ELSE e END)) AS line
      FROM reads WHERE s >= 0),
    nt AS (SELECT instance_id, count(DISTINCT traj_id) AS n FROM reads GROUP BY 1),
    CL AS (SELECT instance_id, path, line FROM L JOIN nt USING (instance_id) GROUP BY instance_id, path, line, n HAVING count(DISTINCT traj_id) = n),
    OL AS (SELECT DISTINCT instance_id, model, path, line FROM L ANTI JOIN CL USING (instance_id, path, line)),
    MC AS (SELECT instance_id, path FROM modified JOIN nt USING (instance_id) GROUP BY instance_id, path, n HAVING count(DISTINCT traj_id) = n),
    MF AS (SELECT DISTINCT instance_id, path FROM MC SEMI JOIN CL USING (instance_id, path))""",
    "core": """core AS (SELECT instance_id, path, min(line) AS s, CASE WHEN max(line) = 200 THEN -1 ELSE max(line) END AS e
      FROM (SELECT *, line - row_number() OVER (PARTITION BY instance_id, path ORDER BY line) AS g FROM CL) GROUP BY instance_id, path, g),
    optional AS (SELECT instance_id, model, path, min(line) AS s, CASE WHEN max(line) = 200 THEN -1 ELSE max(line) END AS e
      FROM (SELECT *, line - row_number() OVER (PARTITION BY instance_id, model, path ORDER BY line) AS g FROM OL) GROUP BY instance_id, model, path, g)""",
    "resolved": """
    R AS (SELECT x.*, CASE WHEN x.e = -1 OR x.s < 0 THEN CASE WHEN n_lines >= 1 THEN greatest(1, least(CASE WHEN x.s < 0 THEN n_lines + x.s + 1 ELSE x.s END, n_lines)) END
                 WHEN x.e >= 1 THEN greatest(1, x.s) END AS rs,
               CASE WHEN x.e = -1 OR x.s < 0 THEN CASE WHEN n_lines >= 1 THEN greatest(1, least(CASE WHEN x.e = -1 THEN n_lines ELSE x.e END, n_lines)) END
                 WHEN x.e >= 1 THEN x.e END AS re
      FROM (SELECT 'p' AS side, instance_id, rank, path, s, e FROM preds UNION ALL SELECT 'c', instance_id, NULL, path, s, e FROM core
            UNION ALL SELECT 'o', instance_id, NULL, path, s, e FROM optional
            UNION ALL SELECT 'o', instance_id, NULL, path, s, e FROM reads WHERE s < 0) x LEFT JOIN file_lines USING (path)),
    RL AS (SELECT side, instance_id, rank, path, unnest(generate_series(rs, re)) AS line FROM R WHERE rs <= re),
    PL AS (SELECT DISTINCT instance_id, path, line FROM RL WHERE side = 'p'),
    KL AS (SELECT DISTINCT instance_id, path, line FROM RL WHERE side = 'c'),
    ZL AS (SELECT DISTINCT instance_id, path, line FROM RL WHERE side = 'o'),
    cases AS (SELECT DISTINCT instance_id FROM core)""",
}


def with_views(statement: str, *names: str) -> str:
    return "WITH " + ",\n".join(SQL_VIEWS[n] for n in names) + "\n" + statement
