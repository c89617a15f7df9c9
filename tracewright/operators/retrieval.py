"""Chunking and ranking of source text: lexical, weighted, dense, two-stage and rule-based."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import identifiers, split_lines, word_counts, words
from tracewright.operators.ordering import running_totals
from tracewright.session import cut_lineage, small

#: Names that come first for the rule-based ranking, in this order.
PRIORITY_NAMES = ("__init__.py", "setup.py", "main.py", "__main__.py", "config.py", "constants.py", "settings.py")
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Texts that are multiplied with a block at once.
TEXT_BLOCK = 256
#: Query vectors that go to the executors at once.
QUERY_BLOCK = 1024


def chunk_files(files: DataFrame, size: int = 80, overlap: int = 20, max_chunks: int | None = None, repo: str = "repo") -> DataFrame:
    """Windows of ``size`` lines that share ``overlap`` lines, until one reaches the end of its file; blank windows are left out.

    Result: repo, path, chunk_seq (from 0, by path and start), start, end, content. The first
    ``max_chunks`` windows of a repository are kept, in path order; None keeps all. A path counts
    once per repository; null and empty texts have no windows.

    Windows are counted per file first. The numbers come from running totals over those counts, so
    a hot repository's texts never meet in one task, and files past the limit are not cut at all.
    """
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap at least 0 and below it")
    step = size - overlap
    n = F.size("lines")
    lined = files.select(repo, "path", split_lines(F.col("text")).alias("lines")).filter("size(lines) > 0").dropDuplicates([repo, "path"])
    starts = F.filter(F.sequence(F.lit(0), n - 1, F.lit(step)), lambda i: (i == 0) | (i - step + size < n))
    window = lambda i: F.struct((i + 1).alias("start"), F.least(i + size, n).alias("end"), F.array_join(F.slice("lines", i + 1, size), "\n").alias("content"))
    cut = lined.select(repo, "path", F.filter(F.transform(starts, window), lambda w: w["content"].rlike(r"(?U)\S")).alias("windows"))
    counted = running_totals(cut.select(repo, "path", F.size("windows").alias("own")), [repo], ["path"], {"upto": F.col("own")})
    first = counted.select(repo, "path", (F.col("upto") - F.col("own")).alias("first"))
    if max_chunks is not None:
        first = first.filter(F.col("first") < max_chunks)
    numbered = (
        cut.join(first, [repo, "path"])
        .select(repo, "path", "first", F.posexplode("windows").alias("pos", "w"))
        .select(repo, "path", "w.start", "w.end", "w.content", (F.col("first") + F.col("pos")).alias("chunk_seq"))
    )
    return numbered if max_chunks is None else numbered.filter(F.col("chunk_seq") < max_chunks)


def top_k(scored: DataFrame, query: str | Sequence[str], k: int, ties: Sequence[str | Column] = ("chunk_seq",)) -> DataFrame:
    # Scores that differ only by the order of their sums are ties.
    order = Window.partitionBy(*([query] if isinstance(query, str) else query)).orderBy(F.desc(F.round("score", 9)), *ties)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


@dataclass
class LexicalBlock:
    """Asked words of some queries of one group: their columns, the weights of each query, and what the values of a text need."""

    ids: np.ndarray
    columns: dict[str, int]
    weights: np.ndarray  # query x column
    mean_length: float = 0.0


def _blocks(pdf: pd.DataFrame, group: list[str]) -> dict[tuple, LexicalBlock]:
    found = {}
    for key, part in pdf.groupby(group, sort=False) if group else [((), pdf)] if len(pdf) else []:
        ids, at = np.unique(part["query_id"].to_numpy(np.int64), return_inverse=True)
        columns: dict[str, int] = {}
        place = [columns.setdefault(w, len(columns)) for w in part["w"]]
        weights = np.zeros((len(ids), len(columns)))
        weights[at, place] = part["weight"]
        found[key if isinstance(key, tuple) else (key,)] = LexicalBlock(ids, columns, weights, float(part["mean_length"].iloc[0]))
    return found


def _best(score: np.ndarray, keys: np.ndarray, best_s: np.ndarray, best_k: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` of each query among those so far and new ones; scores that agree in nine digits go by key."""
    s = np.hstack([best_s, score])
    ids = np.hstack([best_k, np.broadcast_to(keys, score.shape)])
    order = np.lexsort((ids, -np.round(s, 9)), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(ids, order, 1)


def _scored(texts: DataFrame, weights: DataFrame, group: list[str], k: int, values: Callable[[Counter, int, LexicalBlock], Iterator[tuple[int, float]]], positive: bool) -> DataFrame:
    """Best ``k`` texts (group, chunk_seq, ws) of every query of ``weights`` (group, query_id, w, weight, mean_length).

    The queries, a stated set, go to the executors in blocks. Each task multiplies the counts of asked words
    of its texts with a block and hands on its own best per query: what is shuffled follows queries and
    tasks, never the pairs of queries and texts that share a word.
    """
    spark = texts.sparkSession
    weights = cut_lineage(weights)
    n = weights.select(*group, "query_id").distinct().count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    kinds = dict(texts.dtypes)
    result = None
    for block in range(blocks):
        part = weights if blocks == 1 else weights.filter(F.pmod(F.xxhash64(*group, "query_id"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast(_blocks(part.toPandas(), group))  # at most about a block of queries

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            best: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                owners = list(zip(*[batch[g] for g in group])) if group else [()] * len(batch)
                keys, ws = batch["chunk_seq"].to_numpy(np.int64), batch["ws"]
                rows: dict[tuple, list[int]] = {}
                for i, owner in enumerate(owners):
                    rows.setdefault(owner, []).append(i)
                for owner, own in rows.items():
                    asked = shared.value.get(owner)
                    if asked is None:
                        continue
                    for first in range(0, len(own), TEXT_BLOCK):
                        some = own[first : first + TEXT_BLOCK]
                        p = np.zeros((len(asked.columns), len(some)))
                        for j, i in enumerate(some):
                            for at, x in values(Counter(ws.iloc[i]), len(ws.iloc[i]), asked):
                                p[at, j] = x
                        so_far = best.get(owner) or (np.empty((len(asked.ids), 0)), np.empty((len(asked.ids), 0), np.int64))
                        best[owner] = _best(asked.weights @ p, keys[some], *so_far, k)
            for owner, (s, ids) in best.items():
                out = pd.DataFrame({"query_id": np.repeat(shared.value[owner].ids, s.shape[1]), "chunk_seq": ids.ravel(), "score": s.ravel()})
                for g, value in zip(group, owner):
                    out[g] = value
                yield out[[*group, "query_id", "chunk_seq", "score"]]

        schema = ", ".join([f"{g} {kinds[g]}" for g in group] + ["query_id bigint", "chunk_seq bigint", "score double"])
        found = texts.select(*group, "chunk_seq", "ws").mapInPandas(run, schema)
        result = found if result is None else result.unionByName(found)
    return top_k(result.filter("score > 0") if positive else result, [*group, "query_id"], k)


def bm25(chunks: DataFrame, queries: DataFrame, k: int = 5, group: Sequence[str] = (), k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """Okapi BM25 over blank-separated words with case: query_id, chunk_seq, score, rank.

    chunks: group columns, chunk_seq, content; queries: group columns, query_id, text. Inverse
    document frequencies below 0 become epsilon times the mean one. Words that a query repeats
    count each time. Scores of 0 and below are kept: a query that meets fewer than k chunks is
    filled up by chunk_seq. Queries without words, null
    groups and groups without chunks have no result.

    Texts are read twice: for document frequencies, which are combined before the shuffle, and
    to score all queries of a block at once (:func:`_scored`), so a word that every text and
    every query holds costs no more than a rare one.
    """
    group = list(group)
    held = chunks.select(*group, "chunk_seq", words(F.col("content")).alias("ws"))
    # One more entry per text, a null, carries its length: number and mean length of texts come from the same pass.
    entry = F.explode(F.array_append(F.array_distinct("ws"), F.lit(None).cast("string"))).alias("w")
    counted = cut_lineage(held.select(*group, F.size("ws").alias("n_words"), entry).groupBy(*group, "w").agg(F.count("*").alias("df"), F.sum("n_words").alias("n_words")))
    one = [*group, F.lit(0).alias("__one")]
    on = [*group, "__one"]
    stats = small(counted.filter("w is null").select(*one, F.col("df").alias("n"), (F.col("n_words") / F.col("df")).alias("mean_length")))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    per_word = counted.filter("w is not null").select(*one, "w", "df").join(stats, on).select(*on, "w", "mean_length", raw.alias("raw"))
    mean = small(per_word.groupBy(*on).agg(F.avg("raw").alias("mean")))
    asked = queries.select(*one, F.col("query_id").cast("bigint").alias("query_id"), F.explode(words(F.col("text"))).alias("w")).groupBy(*on, "query_id", "w").agg(F.count("*").alias("times"))
    idf = F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw"))
    # A query of which no text holds a word still has its first k texts.
    known = asked.join(stats.select(*on, F.col("mean_length").alias("length")), on).join(per_word.join(mean, on).select(*on, "w", idf.alias("idf")), [*on, "w"], "left")
    weights = known.select(*group, "query_id", "w", F.coalesce(F.col("times") * F.col("idf") * (k1 + 1), F.lit(0.0)).alias("weight"), F.col("length").alias("mean_length"))

    def values(counts: Counter, n_words: int, asked: LexicalBlock) -> Iterator[tuple[int, float]]:
        norm = k1 * (1 - b + b * n_words / asked.mean_length) if asked.mean_length else k1
        for w in counts.keys() & asked.columns.keys():
            tf = counts[w]
            yield asked.columns[w], tf / (tf + norm)

    return _scored(held, weights, group, k, values, positive=False)


def tfidf(chunks: DataFrame, queries: DataFrame, stop_words: Sequence[str], k: int = 5, max_features: int = 10_000) -> DataFrame:
    """Cosine of sublinear tf-idf over identifiers: query_id, chunk_seq, score, rank; only scores above 0.

    tf is 1 + ln(count), idf is ln((1 + n) / (1 + df)) + 1, the features are the ``max_features``
    most frequent identifiers that are no stop words (ties by name), rows have length 1. Texts are
    read twice: to find the features, whose counts are combined before the shuffle, and to score all
    queries of a block at once (:func:`_scored`).
    """
    n = chunks.count()
    stop = list(stop_words)
    docs = chunks.select("chunk_seq", identifiers(F.col("content")).alias("ws"))
    per_word = word_counts(docs, [], F.col("ws")).filter(F.col("w").isNotNull() & ~F.col("w").isin(stop)).groupBy("w").agg(F.sum("c").alias("cf"), F.count("*").alias("df"))
    features = cut_lineage(per_word.orderBy(F.desc("cf"), "w").limit(max_features).select("w", (F.log(F.lit(1 + n) / (1 + F.col("df"))) + 1).alias("idf")))
    idf = dict(features.toPandas().itertuples(index=False))  # at most max_features rows
    counts = word_counts(queries.select(F.col("query_id").cast("bigint").alias("query_id"), identifiers(F.col("text")).alias("ws")), ["query_id"], F.col("ws"))
    y = counts.join(F.broadcast(features), "w").select("query_id", "w", ((1 + F.log("c")) * F.col("idf")).alias("y"))
    length = y.groupBy("query_id").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("length"))
    weights = y.join(length, "query_id").select("query_id", "w", (F.col("y") / F.col("length")).alias("weight"), F.lit(0.0).alias("mean_length"))
    shared = chunks.sparkSession.sparkContext.broadcast(idf)

    def values(counts: Counter, n_words: int, asked: LexicalBlock) -> Iterator[tuple[int, float]]:
        known = shared.value
        x = {w: (1 + math.log(c)) * known[w] for w, c in counts.items() if w in known}
        # The length of a text's row counts all its features, not only those some query asks for.
        norm = math.sqrt(sum(v * v for v in x.values()))
        for w in x.keys() & asked.columns.keys():
            yield asked.columns[w], x[w] / norm

    return _scored(docs, weights, [], k, values, positive=True)


def dense(vectors: DataFrame, queries: DataFrame, k: int = 5, positive: bool = True, key: str = "vec_id", query: str = "query_id", vector: str = "embedding") -> DataFrame:
    """Cosine top k of every query against all vectors: query_id, key, score, rank.

    The queries, a stated set, go to the executors in blocks; each task multiplies its vectors with
    a block and hands on its own best k per query, so what is shuffled follows queries and tasks,
    not pairs. Rows of length 0 have score 0. ``positive`` drops scores of 0 and below. Ties go by
    key. Null vectors match nothing.
    """
    spark = vectors.sparkSession
    asked = queries.filter(F.col(vector).isNotNull()).select(query, vector)
    count = asked.count()
    blocks = max(1, -(-count // QUERY_BLOCK))
    rows = vectors.filter(F.col(vector).isNotNull()).select(key, vector)
    result = None
    for block in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64(query), F.lit(blocks)) == block)
        pdf = part.toPandas()  # at most about a block
        q_ids = pdf[query].to_numpy(np.int64)
        q = np.array(pdf[vector].tolist(), np.float64).reshape(len(pdf), -1)
        norms = np.linalg.norm(q, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((q_ids, np.divide(q, norms, out=np.zeros_like(q), where=norms > 0)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            best_s, best_k = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)
            for batch in batches:
                v = np.array(batch[vector].tolist(), np.float64).reshape(len(batch), -1)
                n = np.linalg.norm(v, axis=1, keepdims=True)
                score = q @ np.divide(v, n, out=np.zeros_like(v), where=n > 0).T
                best_s = np.hstack([best_s, score])
                best_k = np.hstack([best_k, np.broadcast_to(batch[key].to_numpy(np.int64), score.shape)])
                order = np.lexsort((best_k, -best_s), axis=1)[:, :k]
                best_s, best_k = np.take_along_axis(best_s, order, 1), np.take_along_axis(best_k, order, 1)
            if best_s.shape[1]:
                yield pd.DataFrame({query: np.repeat(ids, best_s.shape[1]), key: best_k.ravel(), "score": best_s.ravel()})

        found = rows.mapInPandas(run, f"{query} bigint, {key} bigint, score double")
        result = found if result is None else result.unionByName(found)
    return top_k(result.filter("score > 0") if positive else result, query, k, [key])


def dense_files(vectors: DataFrame, queries: DataFrame, k: int = 5, **names: str) -> DataFrame:
    """:func:`dense` over one vector per file: the best ``k`` whole files (s 1, e -1), whatever the sign of their score."""
    return dense(vectors, queries, k, positive=False, **names).withColumn("s", F.lit(1)).withColumn("e", F.lit(-1))


def rerank(base: DataFrame, replies: DataFrame, k: int, query: str = "query_id") -> DataFrame:
    """Second stage: base (query, rank from 1, columns) reordered by replies (query, pos, id).

    An id is a rank of the base; ids out of range, repeated ids and those past the k-th are
    ignored. A query without any usable reply keeps the base order.
    """
    sizes = base.groupBy(query).agg(F.max("rank").alias("n"))
    usable = replies.join(sizes, query).filter("id >= 1 and id <= n").groupBy(query, F.col("id").alias("rank")).agg(F.min("pos").alias("pos"))
    place = Window.partitionBy(query)
    joined = base.join(usable, [query, "rank"], "left").withColumn("answered", F.max(F.col("pos").isNotNull()).over(place))
    kept = joined.filter("not answered or pos is not null")
    order = place.orderBy(F.coalesce("pos", "rank"), "rank")
    return kept.withColumn("final_rank", F.row_number().over(order)).filter(F.col("final_rank") <= k).drop("pos", "answered")


def simple_rule(files: DataFrame, k: int = 5, repo: str = "repo") -> DataFrame:
    """The first k files of a repository by the first priority name in their name, then name, then path; lines 1 to 100."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    score = F.lit(len(PRIORITY_NAMES))
    for i, pattern in reversed(list(enumerate(PRIORITY_NAMES))):
        score = F.when(name.contains(pattern), i).otherwise(score)
    order = Window.partitionBy(repo).orderBy(score, name, "path")
    return files.select(repo, "path").distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        repo, "path", "rank", F.lit(1).alias("s"), F.lit(100).alias("e")
    )


def random_regions(core: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A reproducible sample of ``n`` distinct core regions: those with the least hash of region and seed."""
    draw = F.md5(F.concat_ws("|", "path", "s", "e", F.lit(seed)))
    return core.select("path", "s", "e").distinct().withColumn("draw", draw).orderBy("draw", "path", "s", "e").limit(n)


def flatten_results(results: DataFrame) -> DataFrame:
    """Ranked results with lists of regions as one ranked list per case: instance_id, rank from 0, path, s, e."""
    flat = results.select("instance_id", "result_no", F.posexplode("regions").alias("pos", "r"))
    order = Window.partitionBy("instance_id").orderBy("result_no", "pos")
    return flat.select("instance_id", (F.row_number().over(order) - 1).alias("rank"), "r.path", "r.s", "r.e")


def truncate_context(regions: DataFrame, modified: DataFrame, max_lines: int, least: int = 10) -> DataFrame:
    """Regions that fit a budget of lines: all of modified files first, then others large enough for their share.

    regions: instance_id, pos, path, s, e (e = -1 counts no lines). Within the budget all are kept.
    If modified files use it up, only their first 0.8 * max_lines regions are.
    """
    case = Window.partitionBy("instance_id")
    marked = regions.join(modified.select("instance_id", "path").distinct().withColumn("m", F.lit(True)), ["instance_id", "path"], "left")
    m = F.coalesce("m", F.lit(False))
    lines = F.when(F.col("e") == -1, 0).otherwise(F.col("e") - F.col("s") + 1)
    sums = (
        marked.withColumn("m", m).withColumn("lines", lines)
        .withColumn("all_lines", F.sum("lines").over(case))
        .withColumn("m_lines", F.coalesce(F.sum(F.when(F.col("m"), F.col("lines"))).over(case), F.lit(0)))
        .withColumn("m_pos", F.sum(F.col("m").cast("int")).over(case.orderBy("pos")))
    )
    room = F.greatest(F.lit(0), max_lines - F.col("m_lines"))
    others = F.col("all_lines") - F.col("m_lines")
    keep = (
        F.when(F.col("all_lines") <= max_lines, True)
        .when(room == 0, F.col("m") & (F.col("m_pos") <= int(max_lines * 0.8)))
        .when(F.col("m") | (others <= room), True)
        .otherwise(F.col("lines") * room / others >= least)
    )
    return sums.filter(keep).select("instance_id", "pos", "path", "s", "e")
