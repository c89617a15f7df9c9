"""Sweep line over inclusive integer intervals: covered stretches and the gaps between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.paths import relative_to

#: Stands for "to the end"; reported as -1.
OPEN_END = 2**31 - 1


def covered_and_gaps(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Maximal covered stretches and the gaps between neighbours, per key.

    ``start`` and ``end`` are inclusive integers with start <= end; an end of :data:`OPEN_END` is
    unbounded. Result: keys, kind (``covered`` or ``gap``), first_line, last_line (-1 if unbounded).

    Each interval becomes a plus at its start and a minus after its end. They are summed per key
    and position before anything is sorted, so repeated or shared boundaries of a hot key shrink to
    one row each on the map side, and a key never holds more rows than it has distinct boundaries.
    A prefix sum then gives the number of open intervals. Rows with a null bound are ignored;
    repeated rows change nothing; an empty table gives an empty result.
    """
    keys = list(keys)
    a, b = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    events = (
        df.filter(a.isNotNull() & b.isNotNull())
        .select(*keys, F.explode(F.array(F.struct(a.alias("at"), F.lit(1).alias("d")), F.struct((b + 1).alias("at"), F.lit(-1).alias("d")))).alias("e"))
        .groupBy(*keys, F.col("e.at").alias("at"))
        .agg(F.sum("e.d").alias("d"))
        .filter("d <> 0")
    )
    line = Window.partitionBy(*keys).orderBy("at")
    open_now = F.sum("d").over(line.rowsBetween(Window.unboundedPreceding, 0))
    edges = (
        events.withColumn("open", open_now)
        .withColumn("before", F.col("open") - F.col("d"))
        .filter("(open = 0) <> (before = 0)")
        .withColumn("next_at", F.lead("at").over(line))
        .filter("next_at is not null")
    )
    last = F.col("next_at") - 1
    return edges.select(
        *keys,
        F.when(F.col("open") > 0, "covered").otherwise("gap").alias("kind"),
        F.col("at").cast("int").alias("first_line"),
        F.when(last == OPEN_END, -1).otherwise(last).cast("int").alias("last_line"),
    )


def read_bounds(start: Column, end: Column) -> tuple[Column, Column]:
    """Inclusive bounds of a read: null or 0 starts at 1, null or -1 ends open, an end before the start is the start."""
    first = F.when(start.isNull() | (start == 0), F.lit(1)).otherwise(start).cast("bigint")
    last = F.when(end.isNull() | (end == -1), F.lit(OPEN_END)).otherwise(F.greatest(first, end)).cast("bigint")
    return first, last


def read_stretches(regions: DataFrame, root: str = "/repo") -> DataFrame:
    """Continuous stretches read and the holes between them, per traj_id and file.

    Rows with a negative start or without a path are left out. All spellings of a path below
    ``root`` are one file. Needs traj_id, path, start_line, end_line; other columns are ignored.
    A null traj_id is a group of its own.
    """
    first, last = read_bounds(F.col("start_line"), F.col("end_line"))
    reads = (
        regions.filter("path is not null and (start_line is null or start_line >= 0)")
        .select("traj_id", relative_to(F.col("path"), root).alias("path"), first.alias("s"), last.alias("e"))
        .filter("path <> ''")
    )
    return covered_and_gaps(reads, ["traj_id", "path"], "s", "e")
