"""Queries of chunking and ranking, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import retrieval as rt
from tracewright.plans import views
from tracewright.plans.views import with_views
from tracewright.sources.tables import table

#: Common English words without meaning of their own; a parameter of the operator.
STOP_WORDS = (
    "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we "
    "there can an your which their if will each about how up out them then she many some so these would other into has more two him see "
    "than been its who did do does only over such after because before while until since says both once"
).split()


def _files(spark, d) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select(
        F.col("source").alias("repo"), F.format_string("%08d", "doc_id").alias("path"), "text"
    )


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("chunk_seq"), F.col("text").alias("content"))


def _asked(spark, d) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "text")


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    c = rt.chunk_files(_files(spark, d), 10, 2, None)
    return c.select("repo", "path", "chunk_seq", "start", "end", F.length("content").alias("n"))


def bm25_topk(spark, d):
    return rt.bm25(_docs(spark, d), _asked(spark, d)).select("query_id", "chunk_seq", F.round("score", 6).alias("score"), "rank")


def tfidf_topk(spark, d):
    return rt.tfidf(_docs(spark, d), _asked(spark, d), STOP_WORDS).select("query_id", "chunk_seq", F.round("score", 6).alias("score"), "rank")


def _dense(spark, d, k, positive=True):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return rt.dense(e, q, k, positive)


def dense_topk(spark, d):
    return _dense(spark, d, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def dense_topk_unfiltered(spark, d):
    return _dense(spark, d, 10, False).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


def two_stage_rerank(spark, d):
    """Second-stage replies: every second query reverses its first ten candidates, with ids out of range and repeats among them."""
    base = _dense(spark, d, 50)
    q = table(spark, d, "embeddings").filter("vec_id % 200 = 0").select(F.col("vec_id").alias("query_id"))
    replies = q.select("query_id", F.posexplode(F.array(*[F.lit(x) for x in (99, 10, 9, 9, 8, 7, 0, 6, 5, 4, 3, 2, 1)])).alias("pos", "id"))
    return rt.rerank(base, replies, 5).select("query_id", "vec_id", "final_rank")


def simple_rule(spark, d):
    return rt.simple_rule(table(spark, d, "chunks"))


def _core(spark, d):
    from tracewright.plans.intervals import interval_intersect_all

    return interval_intersect_all(spark, d)


def oracle_regions(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("instance_id").orderBy("path", "s")
    return _core(spark, d).withColumn("rank", F.row_number().over(order) - 1)


def random_regions(spark, d):
    return rt.random_regions(_core(spark, d), 10).select("path", "s", "e")


def flatten_results(spark, d):
    p = views.preds(spark, d).withColumn("result_no", F.expr("rank div 4"))
    item = F.struct("rank", "path", "s", "e")
    lists = p.groupBy("instance_id", "result_no").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["path"], x["s"], x["e"])).alias("regions"))
    return rt.flatten_results(lists)


def truncate_context(spark, d):
    p = views.preds(spark, d).filter("e = -1 or e >= s").select("instance_id", F.col("rank").alias("pos"), "path", "s", "e")
    return rt.truncate_context(p, views.modified(spark, d).filter("path < 'f12'"), 400)


QUERIES = {
    f.__name__: f
    for f in (chunk_documents, bm25_topk, tfidf_topk, dense_topk, dense_topk_unfiltered, two_stage_rerank, simple_rule, oracle_regions, random_regions, flatten_results, truncate_context)
}

_DENSE = """SELECT q.vec_id AS query_id, v.vec_id,
  list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))) AS s
  FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0"""
_RULES = " ".join(f"WHEN name LIKE '%{p.replace('_', chr(92) + '_')}%' ESCAPE '{chr(92)}' THEN {i}" for i, p in enumerate(rt.PRIORITY_NAMES))
_TRUTH = ("reads", "modified", "lines", "core")

SQL = {
    "chunk_documents": """
WITH l AS (SELECT source AS repo, printf('%08d', doc_id) AS path, string_split_regex(text, '\\r\\n|[\\n\\x0b\\x0c\\r\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]') AS a FROM documents WHERE text IS NOT NULL AND text <> ''),
f AS (SELECT repo, path, CASE WHEN a[-1] = '' THEN a[:len(a) - 1] ELSE a END AS a FROM l),
w AS (SELECT repo, path, a, unnest(range(0, len(a), 8)) AS i FROM f WHERE len(a) > 0),
c AS (SELECT repo, path, i + 1 AS start, least(i + 10, len(a)) AS "end", array_to_string(a[i + 1:i + 10], chr(10)) AS content FROM w WHERE i = 0 OR i - 8 + 10 < len(a))
SELECT * FROM (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path, start) - 1 AS chunk_seq, start, "end", length(content) AS n FROM c WHERE regexp_matches(content, '[^\\s\\x{a0}\\x{3000}]'))
""",
    "bm25_topk": """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(text, '[\\s\\x{a0}\\x{3000}\\x{85}\\x{1c}-\\x{1f}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
n AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM d),
tf AS (SELECT doc_id, dl, w, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS w FROM d) GROUP BY ALL),
df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
i AS (SELECT w, avgdl, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, n),
m AS (SELECT avg(raw) AS mean FROM i),
q AS (SELECT item_id, w, count(*) AS times FROM (SELECT item_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS w FROM eval_items) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(times * (CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
      FROM q JOIN tf USING (w) JOIN i USING (w), m GROUP BY ALL),
f AS (SELECT * FROM s UNION ALL SELECT item_id, doc_id, 0 FROM (SELECT DISTINCT item_id FROM eval_items), (SELECT doc_id FROM d ORDER BY doc_id LIMIT 5) x
      WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.item_id = eval_items.item_id AND s.doc_id = x.doc_id))
SELECT item_id AS query_id, doc_id AS chunk_seq, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f QUALIFY rank <= 5
""".replace("(SELECT DISTINCT item_id FROM eval_items)", "(SELECT DISTINCT item_id FROM eval_items) eval_items"),
    "tfidf_topk": """
WITH d AS (SELECT doc_id AS k, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+'), lambda x: regexp_full_match(x, '[a-z_][a-z0-9_]+')) AS ws FROM documents WHERE text IS NOT NULL),
q AS (SELECT item_id AS k, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+'), lambda x: regexp_full_match(x, '[a-z_][a-z0-9_]+')) AS ws FROM eval_items),
c AS (SELECT k, w, count(*) AS c FROM (SELECT k, unnest(ws) AS w FROM d) WHERE w NOT IN (SELECT unnest([{stop}])) GROUP BY ALL),
cq AS (SELECT k, w, count(*) AS c FROM (SELECT k, unnest(ws) AS w FROM q) GROUP BY ALL),
f AS (SELECT w, ln((1 + (SELECT count(*) FROM d)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY w ORDER BY sum(c) DESC, w LIMIT 10000),
x AS (SELECT k, w, (1 + ln(c)) * idf AS x FROM c JOIN f USING (w)), y AS (SELECT k, w, (1 + ln(c)) * idf AS y FROM cq JOIN f USING (w)),
xn AS (SELECT k, sqrt(sum(x * x)) AS n FROM x GROUP BY 1), yn AS (SELECT k, sqrt(sum(y * y)) AS n FROM y GROUP BY 1),
s AS (SELECT y.k AS query_id, x.k AS chunk_seq, sum(x * y) / any_value(xn.n * yn.n) AS score FROM x JOIN y USING (w) JOIN xn ON xn.k = x.k JOIN yn ON yn.k = y.k GROUP BY 1, 2)
SELECT query_id, chunk_seq, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_seq) AS rank FROM s WHERE score > 0 QUALIFY rank <= 5
""".replace("{stop}", ", ".join(f"'{w}'" for w in STOP_WORDS)),
    "dense_topk": f"WITH x AS ({_DENSE}) SELECT query_id, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM x WHERE s > 0 QUALIFY rank <= 5",
    "dense_topk_unfiltered": f"WITH x AS ({_DENSE}) SELECT query_id, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM x QUALIFY rank <= 10",
    "two_stage_rerank": f"""WITH x AS ({_DENSE}), b AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM x WHERE s > 0 QUALIFY rank <= 50)
SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN query_id % 200 = 0 THEN 11 - rank ELSE rank END) AS final_rank FROM b WHERE query_id % 200 <> 0 OR rank <= 10 QUALIFY final_rank <= 5""",
    "simple_rule": f"""WITH f AS (SELECT DISTINCT repo, path, regexp_extract(path, '([^/]*)$', 1) AS name FROM chunks)
SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY CASE {_RULES} ELSE {len(rt.PRIORITY_NAMES)} END, name, path) AS rank, 1 AS s, 100 AS e FROM f QUALIFY rank <= 5""",
    "oracle_regions": with_views("SELECT instance_id, path, s, e, row_number() OVER (PARTITION BY instance_id ORDER BY path, s) - 1 AS rank FROM core", *_TRUTH),
    "random_regions": with_views("SELECT path, s, e FROM (SELECT DISTINCT path, s, e FROM core) ORDER BY md5(path || '|' || s || '|' || e || '|42'), path, s, e LIMIT 10", *_TRUTH),
    "flatten_results": with_views("SELECT instance_id, rank, path, s, e FROM preds", "preds"),
    "truncate_context": with_views("""
, r AS (SELECT p.*, (path < 'f12' AND (instance_id, path) IN (SELECT instance_id, path FROM modified)) AS m, CASE WHEN e = -1 THEN 0 ELSE e - s + 1 END AS n FROM preds p WHERE e = -1 OR e >= s),
t AS (SELECT *, sum(n) OVER (PARTITION BY instance_id) AS a, sum(CASE WHEN m THEN n ELSE 0 END) OVER (PARTITION BY instance_id) AS b, sum(m::INT) OVER (PARTITION BY instance_id ORDER BY rank) AS mp FROM r)
SELECT instance_id, rank AS pos, path, s, e FROM t WHERE CASE WHEN a <= 400 THEN true WHEN greatest(0, 400 - b) = 0 THEN m AND mp <= 320 WHEN m OR a - b <= greatest(0, 400 - b) THEN true ELSE n * (400 - b)::DOUBLE / (a - b) >= 10 END""", "modified", "preds"),
}
