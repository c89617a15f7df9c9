"""Running totals per key over a sorted table, without putting one key into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import cut_lineage

_ID, _PID = "__tw_id", "__tw_pid"


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    totals: Mapping[str, Column],
) -> DataFrame:
    """Adds, for each entry of ``totals``, the inclusive running sum of its expression per key.

    A window over ``keys`` would sort a key that holds a third of all rows in one task. Here the
    rows are range-partitioned by key *and* order, so a hot key spreads over many partitions:
    sums are taken per (partition, key), and what the earlier partitions of a key add is carried
    over. The carry needs one row per partition, never one per key or input row.

    ``order`` must be a total order within a key for the result to be unambiguous; equal rows keep
    the place that the sort gave them. Null keys form a group of their own. An empty table stays
    empty. The input's columns are kept; names of the added columns must not clash with them.
    """
    names = list(totals)
    slots = [f"__tw_v{i}" for i in range(len(names))]
    sort = [F.col(c) if isinstance(c, str) else c for c in (*keys, *order)]
    values = [F.coalesce(e.cast("bigint"), F.lit(0)).alias(s) for s, e in zip(slots, totals.values())]
    # The partition of a row must be the same in both uses below; the checkpoint pins it.
    placed = cut_lineage(
        df.select("*", *values)
        .repartitionByRange(*sort)
        .sortWithinPartitions(*sort)
        .withColumn(_ID, F.monotonically_increasing_id())
    ).withColumn(_PID, F.shiftright(_ID, 33))

    local = Window.partitionBy(_PID, *keys).orderBy(_ID).rowsBetween(Window.unboundedPreceding, 0)
    within = placed.select("*", *[F.sum(s).over(local).alias(f"{s}s") for s in slots])

    key = F.struct(*[F.col(k) for k in keys])
    per_run = placed.groupBy(_PID, *keys).agg(
        F.min(_ID).alias("lo"), F.max(_ID).alias("hi"), *[F.sum(s).alias(s) for s in slots]
    )
    sums = F.struct(*slots) if slots else F.struct(F.lit(0).alias("none"))
    ends = (
        per_run.groupBy(_PID)
        .agg(
            F.min_by(F.to_json(key), "lo").alias("first"),
            F.max_by(F.to_json(key), "hi").alias("last"),
            F.max_by(sums, "hi").alias("tail"),
            F.min("lo").alias("start"),
        )
        .orderBy(_PID)
        .collect()  # one row per partition
    )
    carries, open_key, held = [], None, [0] * len(slots)
    for row in ends:
        carried = held if row["first"] == open_key else [0] * len(slots)
        if any(carried):
            carries.append((row[_PID], row["first"], *carried))
        tail = [row["tail"][s] for s in slots]
        single = row["first"] == row["last"]
        held = [a + b for a, b in zip(tail, carried)] if single else tail
        open_key = row["last"]

    if not carries:
        result = within.select(*df.columns, *[F.col(f"{s}s").alias(n) for s, n in zip(slots, names)])
        return result
    schema = f"{_PID} bigint, __tw_key string, " + ", ".join(f"{s}c bigint" for s in slots)
    carry = F.broadcast(df.sparkSession.createDataFrame(carries, schema))
    joined = within.withColumn("__tw_key", F.to_json(key)).join(carry, [_PID, "__tw_key"], "left")
    return joined.select(
        *df.columns,
        *[(F.col(f"{s}s") + F.coalesce(f"{s}c", F.lit(0))).alias(n) for s, n in zip(slots, names)],
    )
