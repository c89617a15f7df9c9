"""Conversations rebuilt from message rows and from stream events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.ordering import running_totals
from tracewright.operators.turns import ORDER, blank, message_turns
from tracewright.session import cut_lineage


def message_conversations(messages: DataFrame) -> DataFrame:
    """Whole conversations of message rows: conv_key, turn_no, message_key, speaker.

    Messages are sorted by step_idx where every message of the conversation has one, else by
    sent_at (null last); at equal times a call precedes its results, which follow the order of the
    calls. Messages with one msg_id count once. Rows without traj_id or msg_id are left out; a
    message with an unknown role breaks its conversation.

    The automaton reads the speakers in order. Its states are told by two running totals, the
    number of user messages and of other messages so far, taken by :func:`running_totals`, so
    that even a conversation with a third of all rows is never sorted in one task:
    every user segment must hold an assistant message with text or calls, and the ends must be a
    user's and an assistant's text. Calls and answers are matched per call id.
    """
    turns = message_turns(messages)
    useful = (F.col("speaker") == "assistant") & (F.col("has_text") | (F.size("call_ids") > 0))
    totals = running_totals(turns, ["conv_key"], ORDER, {"turn_no": F.lit(1), "segment": (F.col("speaker") == "user").cast("int")})
    # Read by five plans below; the columns of the order are done with.
    placed = cut_lineage(totals.drop(*ORDER))
    talk = F.col("speaker") != "system"
    edge = F.struct("speaker", "has_text")
    ends = placed.groupBy("conv_key").agg(
        F.min_by(edge, F.when(talk, F.col("turn_no"))).alias("first"),
        F.max_by(edge, F.when(talk, F.col("turn_no"))).alias("last"),
        F.max(F.col("speaker").isNull()).alias("odd"),
    )
    ends = ends.filter(
        "not odd and first.speaker = 'user' and first.has_text and last.speaker = 'assistant' and last.has_text"
    ).select("conv_key")
    unheard = (
        placed.filter("segment > 0")
        .groupBy("conv_key", "segment")
        .agg(F.max(useful).alias("heard"))
        .filter("not heard")
        .select("conv_key")
    )
    calls = placed.select("conv_key", "turn_no", F.explode("call_ids").alias("call_id"), F.lit(1).alias("d"))
    results = placed.filter("speaker = 'tool'").select("conv_key", "turn_no", F.col("tool_call_id").alias("call_id"), F.lit(-1).alias("d"))
    both = calls.unionByName(results)
    at = lambda d: F.when(F.col("d") == d, F.col("turn_no"))
    per_id = both.groupBy("conv_key", "call_id").agg(
        F.count(at(1)).alias("asked"), F.count(at(-1)).alias("answered"), F.min(at(1)).alias("ask_at"), F.min(at(-1)).alias("answer_at")
    )
    wrong = per_id.filter("call_id is null or asked <> answered or ask_at >= answer_at").select("conv_key")
    # Ids that are asked more than once: the k-th answer must come after the k-th call.
    again = per_id.filter("call_id is not null and asked > 1 and asked = answered").select("conv_key", "call_id")
    open_calls = running_totals(
        both.join(again, ["conv_key", "call_id"], "left_semi"), ["conv_key", "call_id"], ["turn_no", F.desc("d")], {"open": F.col("d")}
    )
    broken = unheard.unionByName(wrong).unionByName(open_calls.filter("open < 0").select("conv_key")).distinct()
    kept = ends.join(broken, "conv_key", "left_anti")
    return placed.join(kept, "conv_key", "left_semi").select(
        "conv_key", F.col("turn_no").cast("int").alias("turn_no"), "message_key", "speaker"
    )


def event_conversations(events: DataFrame) -> DataFrame:
    """Whole sessions of stream events: conv_key, turn_no, message_key, speaker (always assistant).

    Events shrink to one row per message before any sort. Kept are sessions in which every message
    has a start and a finish, every tool use has an output, and the last message has text and the
    finish reason ``stop``. Messages follow their earliest ts_ms. Events without a session or
    message id are left out.
    """
    kind = F.col("event_type")
    output = F.col("part.state.output").isNotNull()
    per_message = (
        events.filter("sessionid is not null and part.messageid is not null")
        .groupBy(F.col("sessionid").alias("conv_key"), F.col("part.messageid").alias("message_key"))
        .agg(
            F.min("ts_ms").alias("at"),
            F.max(kind == "step_start").alias("started"),
            F.max(kind == "step_finish").alias("finished"),
            F.max((kind == "tool_use") & ~output).alias("unanswered"),
            F.max((kind == "text") & ~blank(F.col("part.text"))).alias("has_text"),
            F.max((kind == "step_finish") & (F.col("part.reason") == "stop")).alias("stopped"),
        )
    )
    good = F.coalesce("started", F.lit(False)) & F.coalesce("finished", F.lit(False)) & ~F.coalesce("unanswered", F.lit(False))
    end = F.coalesce("has_text", F.lit(False)) & F.coalesce("stopped", F.lit(False))
    per_message = per_message.select("conv_key", "message_key", "at", good.alias("good"), end.alias("ends"))
    place = F.struct(F.col("at").isNull(), "at", "message_key")
    kept = (
        per_message.groupBy("conv_key")
        .agg(F.min("good").alias("good"), F.max_by("ends", place).alias("ends"))
        .filter("good and ends")
    )
    placed = running_totals(
        per_message.join(kept.select("conv_key"), "conv_key", "left_semi"),
        ["conv_key"],
        [F.col("at").asc_nulls_last(), "message_key"],
        {"turn_no": F.lit(1)},
    )
    return placed.select("conv_key", F.col("turn_no").cast("int").alias("turn_no"), "message_key", F.lit("assistant").alias("speaker"))


def conversations(messages: DataFrame, events: DataFrame) -> DataFrame:
    return message_conversations(messages).unionByName(event_conversations(events))
