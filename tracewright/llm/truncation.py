"""Texts that were cut off, judged by their structure and by how whole texts of their source end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.endings import BLANKS, ending
from tracewright.session import cut_lineage, small

#: A last line ends texts of its source if this share of them, after this many different passages, end so.
LINE_SHARE, LINE_TEXTS = 0.001, 3
#: A last line of fewer words is no terminator.
LINE_WORDS = 4
#: Logs of a source end with a summary if this share of them does.
LOG_SHARE = 0.5

SCHEMA = "doc_id bigint, source string, state string, log boolean, line bigint, words int, before bigint"


def _key(text: str) -> int:
    """A 64-bit hash of a whole passage, as a signed number."""
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch["text"]:
            state, line, words, before = ending(text), None, 0, None
            if state == "loose":
                body, _, last = text.rstrip(BLANKS).rpartition("\n")
                last = last.strip(BLANKS)
                line, words, before = _key(last), len(last.split()), _key(body.rstrip(BLANKS))
            rows.append((state, line, words, before))
        told = pd.DataFrame(rows, columns=["state", "line", "words", "before"], index=batch.index)
        told["line"], told["before"] = told["line"].astype("Int64"), told["before"].astype("Int64")
        yield pd.concat([batch[["doc_id", "source", "log"]], told], axis=1)[["doc_id", "source", "state", "log", "line", "words", "before"]]


def judged(documents: DataFrame) -> DataFrame:
    """doc_id, source, cut (boolean) of every non-blank document.

    A stack automaton reads each whole text once: code blocks, brackets, quotation marks and markup
    that stay open (see :func:`endings.open_structure`), code ticks left open in the last line,
    broken characters or escapes at the end, and marks left by a cut make a text cut; a full stop,
    closed block, list of files, trailer, signature or log summary makes it whole. What is left ends
    without a terminator, and its source decides: the last line is a terminator there if a
    thousandth of the source's texts end with that very line, after at least three different
    passages (copies of one cut text prove nothing). A log that ends on an entry is cut where most
    logs of the source end with a summary.

    Lines and passages are compared by 64-bit hashes of the whole of them, so no text is shuffled,
    and counts are combined before it. Blank and null texts and null ids are left out; a null
    source is a source of its own; repeated rows count once.
    """
    texts = documents.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"(?U)\S")).select(
        "doc_id",
        "source",
        "text",
        F.col("text").rlike(r"(?m)^\[?\d{4}-\d\d-\d\d[ T]\d\d:\d\d\S*\]? +\[?[A-Z]{4,8}\b").alias("log"),
    )
    # A few bytes per text, read by four plans below: written once, so each text is read once.
    states = cut_lineage(texts.mapInPandas(_judge, SCHEMA))
    per_source = small(
        states.groupBy("source")
        .agg(
            F.count("*").alias("texts"),
            F.count_if("log").alias("logs"),
            F.count_if(F.col("log") & (F.col("state") == "whole")).alias("summed"),
        )
        .withColumnRenamed("source", "s")
    )
    loose = states.filter("state = 'loose'")
    per_line = (
        loose.filter(F.col("words") >= LINE_WORDS)
        .groupBy("source", "line", "before").agg(F.lit(1).alias("one"))
        .groupBy("source", "line").agg(F.count("*").alias("ends"))
        .filter(F.col("ends") >= LINE_TEXTS)
    )
    terminators = small(
        per_line.join(per_source, F.col("source").eqNullSafe(F.col("s")))
        .filter(F.col("ends") >= LINE_SHARE * F.col("texts"))
        .select(F.col("source").alias("s"), F.col("line").alias("l"))
    )
    unknown = loose.join(terminators, F.col("source").eqNullSafe(F.col("s")) & (F.col("line") == F.col("l")), "left_anti")
    summed = per_source.filter(F.col("summed") >= LOG_SHARE * F.col("logs"))
    broken_off = states.filter("state = 'log'").join(summed, F.col("source").eqNullSafe(F.col("s")), "left_semi")
    ids = ["doc_id", "source"]
    cut = states.filter("state = 'cut'").select(*ids).unionByName(unknown.select(*ids)).unionByName(broken_off.select(*ids))
    whole = loose.join(terminators, F.col("source").eqNullSafe(F.col("s")) & (F.col("line") == F.col("l")), "left_semi").select(*ids)
    whole = whole.unionByName(states.filter("state = 'whole'").select(*ids)).unionByName(
        states.filter("state = 'log'").join(summed, F.col("source").eqNullSafe(F.col("s")), "left_anti").select(*ids)
    )
    return cut.withColumn("cut", F.lit(True)).unionByName(whole.withColumn("cut", F.lit(False)))


def cut_documents(documents: DataFrame) -> DataFrame:
    return judged(documents).filter("cut").select("doc_id").distinct()


def cut_share(documents: DataFrame) -> DataFrame:
    """Per source: texts, cut texts and their share. Each doc_id counts once."""
    one = judged(documents).groupBy("doc_id").agg(F.max("source").alias("source"), F.max("cut").alias("cut"))
    return one.groupBy("source").agg(
        F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"), F.round(F.count_if("cut") / F.count("*"), 6).alias("cut_share")
    )
