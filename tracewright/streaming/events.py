"""Streams: windowed counts with late data, latest result rows, and a fold of agent events per session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events per window and kind; the same plan serves a stream and a table."""
    timed = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", width), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("start"), kind, "n", "total"
    )


def sliding_counts(events: DataFrame, width: str = "2 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    timed = events.withColumn("__ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__ts", late)
    return timed.groupBy(F.window("__ts", width, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    timed = events.withColumn("__ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("__ts", late)
    return timed.groupBy("user_id", F.session_window("__ts", gap)).agg(F.count("*").alias("n")).select(
        "user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n"
    )


def new_rows(results: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """Result rows appended to a file source, each key once within the watermark."""
    return results.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


class SessionFold(StatefulProcessor):
    """Running state of an agent session: steps, tokens, finished."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("fold", "steps bigint, tokens bigint, finished boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        steps, tokens, finished = self._state.get() if self._state.exists() else (0, 0, False)
        for batch in rows:
            steps += int((batch["event_type"] == "step_finish").sum())
            tokens += int(batch["tokens"].fillna(0).sum())
            finished = bool(finished or (batch["reason"] == "stop").any())
        self._state.update((steps, tokens, finished))
        yield pd.DataFrame({"sessionid": [key[0]], "steps": [steps], "tokens": [tokens], "finished": [finished]})

    def close(self) -> None:
        pass


def fold_sessions(events: DataFrame) -> DataFrame:
    """Per session and micro-batch the state so far; needs the RocksDB state store."""
    flat = events.select("sessionid", "event_type", F.col("part.tokens.total").alias("tokens"), F.col("part.reason").alias("reason"))
    return flat.groupBy("sessionid").transformWithStateInPandas(
        statefulProcessor=SessionFold(), outputStructType="sessionid string, steps bigint, tokens bigint, finished boolean", outputMode="Update", timeMode="None"
    )
