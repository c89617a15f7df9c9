"""Algebra of inclusive line intervals in long form: one row per interval, columns keys, s and e.

Ends that mean "to the end of the file" are held as :data:`EOF` during the algebra and written -1
outside of it. Intervals with a negative start ("the last n lines") take no part in it: they are
tails, which :func:`merge` hands through and the other operators drop or keep as they say. Nothing
is ever expanded to lines: all operators sweep over the boundaries, which are summed per key and
position before the sort, so the cost follows the number of distinct boundaries.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import cut_lineage

#: Fixed value: the end of a file during the algebra.
EOF = 1_000_000


def concrete(start: Column, end: Column) -> tuple[Column, Column]:
    """Bounds for the algebra: no start is 1, no end or -1 is EOF, an end before the start is the start; tails stay."""
    tail = start < 0
    s = F.when(start.isNull() | (start == 0), F.lit(1)).otherwise(start).cast("bigint")
    e = F.when(tail, end).when(end.isNull() | (end == -1), F.lit(EOF)).otherwise(F.greatest(end, s)).cast("bigint")
    return s, e


def report_end(e: Column) -> Column:
    return F.when(e >= EOF, F.lit(-1)).otherwise(e).cast("bigint")


def elementary(df: DataFrame, keys: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """Consecutive segments between boundaries with the sum of each weight over the intervals that cover them."""
    keys, weights = list(keys), list(weights)
    edge = lambda at, sign: F.struct(at.alias("at"), *[(F.col(w) * sign).alias(w) for w in weights])
    events = (
        df.filter("s <= e")
        .select(*keys, F.explode(F.array(edge(F.col("s").cast("bigint"), 1), edge(F.col("e").cast("bigint") + 1, -1))).alias("x"))
        .groupBy(*keys, F.col("x.at").alias("at"))
        .agg(*[F.sum(f"x.{w}").alias(w) for w in weights])
    )
    line = Window.partitionBy(*keys).orderBy("at")
    running = line.rowsBetween(Window.unboundedPreceding, 0)
    return events.select(
        *keys, F.col("at").alias("s"), (F.lead("at").over(line) - 1).alias("e"), *[F.sum(w).over(running).alias(w) for w in weights]
    )


def sweep_where(df: DataFrame, keys: Sequence[str], weights: Sequence[str], holds: Column) -> DataFrame:
    """Maximal stretches over which ``holds``, a condition on the summed weights, is true."""
    keys = list(keys)
    line = Window.partitionBy(*keys).orderBy("s")
    flagged = elementary(df, keys, weights).withColumn("on", F.coalesce(holds, F.lit(False)))
    turns = flagged.withColumn("was", F.coalesce(F.lag("on").over(line), F.lit(False))).filter("on <> was")
    return turns.withColumn("e", F.lead("s").over(line) - 1).filter("on and e is not null").select(*keys, "s", "e")


def merge(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overlapping and adjacent intervals become one; tails are handed through as they are."""
    one = df.filter("s >= 0").select(*keys, "s", "e", F.lit(1).alias("n"))
    tails = df.filter("s < 0").select(*keys, F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"))
    return sweep_where(one, keys, ["n"], F.col("n") > 0).unionByName(tails)


def intersect_all(df: DataFrame, group: Sequence[str], member: str, members: DataFrame) -> DataFrame:
    """Lines that every member of a group holds, per group and path.

    ``members`` has one row per group and member, also for members that hold nothing: one of them
    empties its group. A group with a single member keeps its tails; with more, tails are dropped.
    """
    group = list(group)
    sizes = members.select(*group, member).distinct().groupBy(*group).agg(F.count("*").alias("want"))
    own = merge(df, [*group, member, "path"]).join(sizes, group)
    plain = own.filter("s >= 0").select(*group, "path", "want", "s", "e", F.lit(1).alias("n"))
    common = sweep_where(plain, [*group, "path", "want"], ["n"], F.col("n") == F.col("want")).drop("want")
    lone_tails = own.filter("s < 0 and want = 1").select(*group, "path", "s", "e")
    return common.unionByName(lone_tails)


def minus(whole: DataFrame, removed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines of ``whole`` that are not in ``removed``; tails of ``whole`` stay, tails of ``removed`` remove nothing."""
    keys = list(keys)
    both = (
        whole.filter("s >= 0").select(*keys, "s", "e", F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionByName(removed.filter("s >= 0").select(*keys, "s", "e", F.lit(0).alias("a"), F.lit(1).alias("b")))
    )
    tails = whole.filter("s < 0").select(*keys, "s", "e")
    return sweep_where(both, keys, ["a", "b"], (F.col("a") > 0) & (F.col("b") == 0)).unionByName(tails)


def intersect(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines in both; tails never intersect."""
    keys = list(keys)
    both = (
        left.filter("s >= 0").select(*keys, "s", "e", F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionByName(right.filter("s >= 0").select(*keys, "s", "e", F.lit(0).alias("a"), F.lit(1).alias("b")))
    )
    return sweep_where(both, keys, ["a", "b"], (F.col("a") > 0) & (F.col("b") > 0))


def lengths(df: DataFrame, keys: Sequence[str], path: str, weights: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    """Per key, the number of lines over which each measure's condition on the summed weights holds."""
    parts = elementary(df, [*keys, path], weights).filter("e is not null")
    size = F.col("e") - F.col("s") + 1
    return parts.groupBy(*keys).agg(*[F.sum(F.when(c, size).otherwise(0)).alias(n) for n, c in measures.items()])


def resolve(df: DataFrame, file_lines: DataFrame, on: Sequence[str] = ("path",)) -> DataFrame:
    """Adds rs and re: bounds within the file where the end is -1 or the start negative, else at least 1; null if that needs an unknown length."""
    n = F.col("n_lines")
    needs = (F.col("e") == -1) | (F.col("s") < 0)
    known = n.isNotNull() & (n >= 1)
    clamp = lambda c: F.greatest(F.lit(1), F.least(c, n))
    joined = df.join(file_lines.select(*on, "n_lines"), list(on), "left")
    rs = F.when(needs & known, clamp(F.when(F.col("s") < 0, n + F.col("s") + 1).otherwise(F.col("s")))).when(
        ~needs & (F.col("e") >= 1), F.greatest(F.lit(1), F.col("s"))
    )
    re_ = F.when(needs & known, clamp(F.when(F.col("e") == -1, n).otherwise(F.col("e")))).when(~needs & (F.col("e") >= 1), F.col("e"))
    return joined.withColumn("rs", rs.cast("bigint")).withColumn("re", re_.cast("bigint")).drop("n_lines")


def resolve_eof(df: DataFrame, file_lines: DataFrame, on: Sequence[str] = ("path",)) -> DataFrame:
    """After the algebra: an end of -1 becomes the file's length where that is known; nothing else changes."""
    joined = df.join(file_lines.select(*on, "n_lines"), list(on), "left")
    return joined.withColumn("e", F.when(F.col("e") == -1, F.coalesce("n_lines", F.col("e"))).otherwise(F.col("e"))).drop("n_lines")


def clamp_coarse(df: DataFrame, keys: Sequence[str], file_lines: DataFrame, on: Sequence[str] = ("path",)) -> DataFrame:
    """Regions fitted into their files, then merged: an end below 0 or past the file is the file's end, a start
    past it drops the region, a start below 1 is 1, swapped bounds are put right. Files of unknown length keep theirs."""
    n = F.col("n_lines")
    joined = df.join(file_lines.select(*on, "n_lines"), list(on), "left")
    known = joined.filter("n_lines is not null")
    e = F.when((F.col("e") < 0) | (F.col("e") > n), n).otherwise(F.col("e"))
    s = F.greatest(F.coalesce("s", F.lit(1)), F.lit(1))
    fitted = (
        known.filter(s <= n)
        .select(*keys, F.least(s, e).cast("bigint").alias("s"), F.greatest(s, e).cast("bigint").alias("e"))
    )
    rest = joined.filter("n_lines is null").select(*keys, F.col("s").cast("bigint").alias("s"), F.col("e").cast("bigint").alias("e"))
    return merge(fitted, keys).unionByName(rest)


def clip_refined(refined: DataFrame, coarse: DataFrame, keys: Sequence[str], totals: DataFrame, on: Sequence[str] = ("path",)) -> DataFrame:
    """Refined ranges cut to their file and merged; a file for which none is left keeps its coarse ranges."""
    keys = list(keys)
    cut = (
        refined.join(totals.select(*on, "n_lines"), list(on))
        .filter("s <= n_lines")
        .select(*keys, F.greatest("s", F.lit(1)).alias("s"), F.least("e", "n_lines").alias("e"))
        .filter("s <= e")
    )
    kept = merge(cut, keys)
    back = coarse.join(kept.select(*keys).distinct(), keys, "left_anti").select(*keys, "s", "e")
    return kept.unionByName(back)


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left_semi") -> DataFrame:
    """Rows of ``left`` that meet (left_semi) or never meet (left_anti) an interval of ``right``.

    Both sides need rs and re, the resolved bounds; rows without them never meet anything. Proper
    intervals of ``right`` are merged first, so a hot file is probed by its stretches, not by its
    rows. Inverted intervals are compared bound by bound with each single interval: they meet those
    that reach over both of their bounds.
    """
    keys = list(keys)

    def probe(rows: DataFrame, against: DataFrame) -> DataFrame:
        r = against.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("s").alias("__s"), F.col("e").alias("__e"))
        on = (F.col("rs") <= F.col("__e")) & (F.col("__s") <= F.col("re"))
        for k in keys:
            on = on & (F.col(k) == F.col(f"__{k}"))
        return rows.join(r, on, how)

    single = right.filter("rs is not null").select(*keys, F.col("rs").alias("s"), F.col("re").alias("e")).distinct()
    stretches = merge(single.filter("s <= e"), keys).unionByName(single.filter("s > e"))
    inverted = F.coalesce(F.col("rs") > F.col("re"), F.lit(False))
    return probe(left.filter(~inverted), stretches).unionByName(probe(left.filter(inverted), single))


def covered_lines(rows: DataFrame, stretches: DataFrame, keys: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """For each row (keys, rs, re, and ``ids`` that tell it apart) the number of its lines in ``stretches`` (keys, s, e; merged): ids, common.

    The covered lines up to a position follow from how many stretches begin and end before it and
    from the sums of those positions, so one sweep answers both bounds of every row; rows and
    stretches of a file are never paired.
    """
    keys, ids = list(keys), list(ids)
    more = [c for c in ids if c not in keys]
    n = lambda c, name: F.lit(c).cast("bigint").alias(name)
    event = lambda at, begins, first, ends, last: F.struct(at.cast("bigint").alias("at"), n(begins, "nb"), first.cast("bigint").alias("sb"), n(ends, "ne"), last.cast("bigint").alias("se"))
    zero = F.lit(0)
    marks = stretches.filter("s <= e").select(*keys, F.explode(F.array(event(F.col("s"), 1, F.col("s"), 0, zero), event(F.col("e") + 1, 0, zero, 1, F.col("e")))).alias("x"))
    bounds = rows.filter("rs <= re").select(*keys, *more, F.explode(F.array(F.struct((F.col("rs") - 1).alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("re").alias("at"), F.lit(1).alias("sign")))).alias("q"))
    both = marks.select(*keys, "x.*").unionByName(bounds.select(*keys, *more, "q.*"), allowMissingColumns=True)
    upto = Window.partitionBy(*keys).orderBy("at", F.col("sign").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0))
    covered = (F.col("at") + 1) * total("nb") - total("sb") - F.col("at") * total("ne") + total("se")
    return both.withColumn("covered", covered).filter("sign is not null").groupBy(*ids).agg(F.sum(F.col("sign") * F.col("covered")).alias("common"))


def runs_of_lines(df: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """Single line numbers as ranges of consecutive ones."""
    return merge(df.select(*keys, F.col(line).alias("s"), F.col(line).alias("e")), keys)


def snippet_spans(df: DataFrame, keys: Sequence[str], file_lines: DataFrame, margin: int = 3, whole: int = 400, on: Sequence[str] = ("path",)) -> DataFrame:
    """Spans to show around regions: the whole file up to ``whole`` lines, else the regions widened by ``margin`` and merged."""
    keys = list(keys)
    joined = df.join(file_lines.select(*on, "n_lines"), list(on))
    small = joined.filter(F.col("n_lines") <= whole).select(*keys, F.lit(1).cast("bigint").alias("s"), F.col("n_lines").cast("bigint").alias("e")).distinct()
    e = F.when(F.col("e") == -1, F.col("n_lines")).otherwise(F.col("e"))
    wide = joined.filter(F.col("n_lines") > whole).select(
        *keys, F.greatest(F.lit(1), F.col("s") - margin).cast("bigint").alias("s"), F.least(F.col("n_lines"), e + margin).cast("bigint").alias("e")
    )
    return small.unionByName(merge(wide, keys))


def ground_truth(reads: DataFrame, members: DataFrame, modified: DataFrame) -> dict[str, DataFrame]:
    """Core, optional and modified context per instance, from reads (instance_id, traj_id, model, path, s, e).

    core: lines that all trajectories of the instance read. optional: per model, the union of its
    trajectories' lines without the core. modified_core: paths that all of them modified. main:
    modified_core paths with core lines. Reads are merged per trajectory for the core and per model for
    the optional context.
    """
    core = cut_lineage(intersect_all(reads, ["instance_id"], "traj_id", members))  # read by all results below
    models = reads.select("instance_id", "model").distinct()
    union = merge(reads, ["instance_id", "model", "path"])
    core_by_model = core.join(models, "instance_id")
    optional = minus(union, core_by_model, ["instance_id", "model", "path"])
    want = members.select("instance_id", "traj_id").distinct().groupBy("instance_id").agg(F.count("*").alias("want"))
    modified_core = (
        modified.select("instance_id", "path", "traj_id").distinct()
        .groupBy("instance_id", "path").agg(F.count("*").alias("n"))
        .join(want, "instance_id").filter("n = want").select("instance_id", "path")
    )
    main = modified_core.join(core.select("instance_id", "path").distinct(), ["instance_id", "path"], "left_semi")
    return {"core": core, "optional": optional, "modified_core": modified_core, "main": main}


def provenance(reads: DataFrame, order: Sequence[str]) -> DataFrame:
    """Per instance and path, the reads behind it in order: array of (traj_id, step_idx, s, e)."""
    item = F.struct(*order, F.struct("traj_id", "step_idx", "s", "e").alias("read"))
    return reads.groupBy("instance_id", "path").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["read"]).alias("reads"))


def context_windows(messages: DataFrame, steps: DataFrame, k: int, keys: Sequence[str] = ("traj_id",), most: int = 2000) -> DataFrame:
    """Messages within ``k`` steps of a read step, in order, with content cut to ``most`` characters and the read ones marked.

    ``steps`` holds the keys and step_idx of the reads. A range frame over step numbers finds the
    neighbourhood, so there is no join of messages with themselves.
    """
    keys = list(keys)
    place = [*keys, "step_idx"]
    # Only numbers are windowed; contents are shuffled once, for the messages that stay.
    read = steps.select(*place).distinct().withColumn("is_read", F.lit(1))
    near = Window.partitionBy(*keys).orderBy("step_idx").rangeBetween(-k, k)
    around = (
        messages.select(*place).distinct().join(read, place, "left")
        .withColumn("near", F.max("is_read").over(near))
        .filter("near = 1").select(*place, F.coalesce("is_read", F.lit(0)).alias("is_read"))
    )
    shown = messages.filter("role in ('user', 'assistant', 'tool')").select(*place, "role", F.left("content", F.lit(most)).alias("content"))
    return shown.join(around, place).select(*place, "role", "content", "is_read")


def last_messages(messages: DataFrame, n: int = 8, keys: Sequence[str] = ("traj_id",)) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("step_idx"))
    return messages.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= n).drop("__r")


def apply_replies(regions: DataFrame, replies: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Regions with the ranges of each answered target replaced by the reply's; other targets keep theirs."""
    targets = list(targets)
    untouched = regions.join(replies.select(*targets).distinct(), targets, "left_anti").select(*targets, "s", "e")
    return untouched.unionByName(merge(replies.select(*targets, "s", "e"), targets))
