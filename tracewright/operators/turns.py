"""Speakers of message rows and their order within a conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.ordering import running_totals
from tracewright.session import cut_lineage

#: Spellings of the speakers.
SPEAKERS = {
    "system": ["system", "developer"],
    "user": ["user", "human"],
    "assistant": ["assistant", "ai", "model"],
    "tool": ["tool", "function", "observation"],
}


def blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def speaker(role: Column, tool_call_id: Column) -> Column:
    """One of the four speakers; a missing role is a tool's if it answers a call, else the assistant's; unknown roles are null."""
    name = F.lower(F.regexp_replace(role, r"(?U)^\s+|\s+$", ""))
    known = F.when(F.lit(False), None)
    for who, spellings in SPEAKERS.items():
        known = known.when(name.isin(spellings), who)
    missing = role.isNull() | (name == "")
    return F.when(missing & tool_call_id.isNotNull(), "tool").when(missing, "assistant").otherwise(known)


def message_turns(messages: DataFrame) -> DataFrame:
    """Slim rows in an unambiguous order: the text itself is not carried through any shuffle.

    The rows are read once and written slim, as three plans below need them.
    """
    calls = F.filter(F.coalesce("tool_calls", F.expr("array()")), lambda c: c.isNotNull())
    rows = cut_lineage(
        messages.filter("traj_id is not null and msg_id is not null")
        .select(
            F.col("traj_id").cast("string").alias("conv_key"),
            "msg_id",
            speaker(F.col("role"), F.col("tool_call_id")).alias("speaker"),
            (~blank(F.col("content"))).alias("has_text"),
            F.transform(calls, lambda c: c["id"]).alias("call_ids"),
            "tool_call_id",
            "step_idx",
            "sent_at",
        )
        .dropDuplicates(["msg_id"])
    )
    stepped = rows.groupBy("conv_key").agg((F.count("step_idx") == F.count("*")).alias("stepped"))
    asked = rows.select("conv_key", F.posexplode("call_ids").alias("call_pos", "tool_call_id"), F.col("sent_at").alias("asked_at"), F.col("msg_id").alias("asker"))
    asked = asked.filter("tool_call_id is not null").groupBy("conv_key", "tool_call_id").agg(
        F.min_by(F.struct("asked_at", "asker", "call_pos"), F.struct("asked_at", "asker", "call_pos")).alias("ask")
    )
    # At one time stamp: results of earlier calls, system, user, then each asker followed by its results.
    same = F.col("ask.asked_at") == F.col("sent_at")
    answers = F.col("speaker") == "tool"
    lane = (
        F.when(answers & same, 3)
        .when(answers, 0)
        .when(F.col("speaker") == "system", 1)
        .when(F.col("speaker") == "user", 2)
        .otherwise(F.when(F.size("call_ids") > 0, 3).otherwise(4))
    )
    anchor = F.when(answers & same, F.col("ask.asker")).otherwise(F.col("msg_id"))
    slot = F.when(answers, F.coalesce(F.col("ask.call_pos"), F.lit(0)) + 1).otherwise(0)
    use_step = F.col("stepped")
    return (
        rows.join(stepped, "conv_key")
        .join(asked, ["conv_key", "tool_call_id"], "left")
        .select(
            "conv_key",
            F.col("msg_id").cast("string").alias("message_key"),
            "speaker",
            "has_text",
            "call_ids",
            "tool_call_id",
            F.when(use_step, F.col("step_idx")).alias("o1"),
            F.coalesce("sent_at", F.lit("9999-12-31").cast("timestamp_ntz")).cast("timestamp_ntz").alias("o2"),
            lane.alias("o3"),
            anchor.alias("o4"),
            slot.alias("o5"),
            F.col("msg_id").alias("o6"),
        )
    )


ORDER = ["o1", "o2", "o3", "o4", "o5", "o6"]


def numbered_messages(messages: DataFrame) -> DataFrame:
    """Every message of every conversation once, with role as one of the speakers and step_idx as its place.

    step_idx stays where all messages of the conversation have one of their own; else all of them
    are numbered from 0 in the order of :func:`message_turns`. A role that is no known spelling
    stays, in lower case. Rows without traj_id or msg_id are left out. Only slim rows are sorted.
    """
    turns = message_turns(messages).select("conv_key", "speaker", *ORDER)
    placed = running_totals(turns, ["conv_key"], ORDER, {"turn_no": F.lit(1)})
    own = placed.groupBy("conv_key").agg((F.count_distinct("o1") == F.count("*")).alias("own"))
    step = F.when(F.col("own"), F.col("o1")).otherwise(F.col("turn_no") - 1).cast("int")
    place = placed.join(own, "conv_key").select(F.col("o6").alias("msg_id"), "speaker", step.alias("step_idx"))
    rows = messages.filter("traj_id is not null and msg_id is not null").dropDuplicates(["msg_id"]).drop("step_idx")
    role = F.coalesce("speaker", F.lower(F.trim("role")))
    return rows.join(place, "msg_id").withColumn("role", role).drop("speaker")
