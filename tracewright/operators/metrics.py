"""Scores of ranked line ranges against labelled ones, for all cases and budgets in one set of plans.

Inputs, all with the case columns ``keys``: preds (rank, path, s, e; rank from 0), core and optional
(path, s, e), main (path), and file_lines (path, n_lines, perhaps with keys). Ends of -1 and
negative starts are resolved by the file's length; ranges that can't be resolved count as predictions
without lines. Line sets are measured by sweeping over boundaries, never by listing lines.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import intervals as iv
from tracewright.session import cut_lineage

BUDGETS = (100, 300, 500)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


class Scoring:
    """The labelled and predicted ranges of some cases, resolved once, and the metrics over them."""

    def __init__(self, preds: DataFrame, core: DataFrame, optional: DataFrame, main: DataFrame, file_lines: DataFrame, keys: Sequence[str] = ("instance_id",), scope: str = "all", cases: DataFrame | None = None):
        self.keys = list(keys)
        if scope == "gt":  # lengths are known of labelled files only
            labelled = core.select("path").unionByName(optional.select("path")).distinct()
            file_lines = file_lines.join(labelled, "path", "left_semi")
        self._given = {"preds": preds, "core": core, "optional": optional, "main": main}
        self._file_lines = file_lines
        self._cases = cases

    # Each metric reads some of these several times, so what led to them is worked out once, when the first metric asks.
    def _resolved(self, name: str) -> DataFrame:
        return cut_lineage(iv.resolve(self._given[name], self._file_lines))

    @cached_property
    def preds(self) -> DataFrame:
        return self._resolved("preds")

    @cached_property
    def core(self) -> DataFrame:
        return self._resolved("core")

    @cached_property
    def optional(self) -> DataFrame:
        return self._resolved("optional")

    @cached_property
    def main(self) -> DataFrame:
        return self._given["main"].select(*self.keys, "path").distinct()

    @cached_property
    def cases(self) -> DataFrame:
        return (self._cases if self._cases is not None else self.core).select(*self.keys).distinct()

    def _lines(self, df: DataFrame) -> DataFrame:
        return df.filter("rs is not null and rs <= re").select(*self.keys, "path", F.col("rs").alias("s"), F.col("re").alias("e"))

    def _all(self, df: DataFrame, *names: str) -> DataFrame:
        """Every case, with 0 where the metric has no row: a failed case scores as an empty answer."""
        joined = self.cases.join(df, self.keys, "left")
        return joined.select(*self.keys, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])

    def _line_counts(self, optional: bool) -> DataFrame:
        """Numbers of predicted, core and optional lines and of those in common; without ``optional`` that context is not even built."""
        flag = lambda df, n: self._lines(df).select("*", *[F.lit(int(n == x)).alias(x) for x in "pco"])
        events = flag(self.preds, "p").unionByName(flag(self.core, "c"))
        if optional:
            events = events.unionByName(flag(self.optional, "o"))
        p, c, o = F.col("p") > 0, F.col("c") > 0, F.col("o") > 0
        return iv.lengths(events, self.keys, "path", ["p", "c", "o"], {"np": p, "nc": c, "no": o, "npc": p & c, "npo": p & o, "nu": p & (c | o)})

    def prf(self) -> DataFrame:
        """precision, recall, f1."""
        return self._all(self._line_counts(False).select(*self.keys, *self._prf()), "precision", "recall", "f1")

    def _prf(self) -> list[Column]:
        precision, recall = _ratio(F.col("npc"), F.col("np")), _ratio(F.col("npc"), F.col("nc"))
        return [precision.alias("precision"), recall.alias("recall"), _ratio(2 * precision * recall, precision + recall).alias("f1")]

    def line_metrics(self) -> DataFrame:
        """precision, recall, f1, context_efficiency, optional_coverage."""
        out = self._line_counts(True).select(
            *self.keys, *self._prf(), _ratio(F.col("nu"), F.col("np")).alias("context_efficiency"), _ratio(F.col("npo"), F.col("no")).alias("optional_coverage")
        )
        return self._all(out, "precision", "recall", "f1", "context_efficiency", "optional_coverage")

    def file_metrics(self) -> DataFrame:
        """hit_file_rate, noise_file_rate; ranges that can't be resolved count."""
        mark = lambda df, n: df.select(*self.keys, "path", *[F.lit(int(n == x)).alias(x) for x in "pco"])
        files = (
            mark(self.preds, "p").unionByName(mark(self.core, "c")).unionByName(mark(self.optional, "o"))
            .groupBy(*self.keys, "path").agg(*[F.max(x).alias(x) for x in "pco"])
        )
        m = files.groupBy(*self.keys).agg(
            F.sum("p").alias("np"), F.sum("c").alias("nc"), F.sum(F.col("p") * F.col("c")).alias("hit"),
            F.count_if(F.expr("p = 1 and c = 0 and o = 0")).alias("noise"),
        )
        out = m.select(*self.keys, _ratio(F.col("hit"), F.col("nc")).alias("hit_file_rate"), _ratio(F.col("noise"), F.col("np")).alias("noise_file_rate"))
        return self._all(out, "hit_file_rate", "noise_file_rate")

    def region_metrics(self) -> DataFrame:
        """hit_region_rate over all core regions, noise_region_rate over all predictions."""
        on = [*self.keys, "path"]
        total = self.core.groupBy(*self.keys).agg(F.count("*").alias("n"))
        hits = iv.overlapping(self.core, self.preds, on).groupBy(*self.keys).agg(F.count("*").alias("h"))
        n_preds = self.preds.groupBy(*self.keys).agg(F.count("*").alias("np"))
        labelled = self.core.select(*on, "rs", "re").unionByName(self.optional.select(*on, "rs", "re"))
        noise = iv.overlapping(self.preds, labelled, on, "left_anti").groupBy(*self.keys).agg(F.count("*").alias("z"))
        out = total.join(hits, self.keys, "left").join(n_preds, self.keys, "left").join(noise, self.keys, "left")
        zero = lambda c: F.coalesce(c, F.lit(0))
        out = out.select(*self.keys, _ratio(zero("h"), F.col("n")).alias("hit_region_rate"), _ratio(zero("z"), zero("np")).alias("noise_region_rate"))
        return self._all(out, "hit_region_rate", "noise_region_rate")

    def _overlap(self, left: DataFrame, right: DataFrame, id_columns: Sequence[str]) -> DataFrame:
        """Lines of each row of ``left`` that lie in the merged ``right``; rows without any are left out."""
        return iv.covered_lines(left, iv.merge(self._lines(right), [*self.keys, "path"]), [*self.keys, "path"], id_columns).filter("common > 0")

    def weighted_core_coverage(self) -> DataFrame:
        """Covered share of each resolvable core region, weighted 3 in main files and 2 elsewhere; regions count separately."""
        regions = self.core.filter("rs is not null and rs <= re").withColumn("id", F.xxhash64(*self.keys, "path", "rs", "re"))
        same = [*self.keys, "path", "rs", "re"]
        counted = regions.groupBy(*same).agg(F.count("*").alias("times"))
        covered = self._overlap(counted, self.preds, same)
        w = F.when(F.col("is_main"), 3.0).otherwise(2.0) * F.col("times")
        share = F.coalesce("common", F.lit(0)) / (F.col("re") - F.col("rs") + 1)
        out = (
            counted.join(covered, same, "left")
            .join(self.main.withColumn("is_main", F.lit(True)), [*self.keys, "path"], "left")
            .groupBy(*self.keys)
            .agg(F.try_divide(F.sum(w * share), F.sum(w)).alias("weighted_core_coverage"))
        )
        return self._all(out, "weighted_core_coverage")

    def _gains(self) -> DataFrame:
        """Per prediction: rank, number of lines, gain (core lines, half as much again in main files)."""
        gains = self._overlap(self.preds.filter("rs <= re"), self.core, [*self.keys, "path", "rank"])
        gains = gains.join(self.main.withColumn("is_main", F.lit(True)), [*self.keys, "path"], "left").select(
            *self.keys, "rank", (F.col("common") * F.when(F.col("is_main"), 1.5).otherwise(1.0)).alias("gain")
        )
        lines = self.preds.select(*self.keys, "rank", F.coalesce(F.col("re") - F.col("rs") + 1, F.lit(0)).alias("lines"))
        return lines.join(gains, [*self.keys, "rank"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))

    def ndcg(self, budgets: Sequence[int] = BUDGETS) -> DataFrame:
        """ndcg_at_N for each budget of lines: the prefix ends before the first prediction past the budget, the first is always kept."""
        base = self._gains()
        case = Window.partitionBy(*self.keys)
        density = F.col("gain") / F.greatest("lines", F.lit(1))
        ranked = base.select(
            *self.keys, "gain", "lines", "rank",
            (F.row_number().over(case.orderBy("rank")) - 1).alias("i0"),
            (F.row_number().over(case.orderBy(density.desc(), "rank")) - 1).alias("i1"),
        )
        sums = []
        for i, kind in (("i0", "dcg"), ("i1", "idcg")):
            so_far = case.orderBy(i).rowsBetween(Window.unboundedPreceding, 0)
            ranked = ranked.withColumn(f"{kind}_cum", F.sum("lines").over(so_far))
            for b in budgets:
                stop = F.max(((F.col(f"{kind}_cum") > b) & (F.col(i) > 0)).cast("int")).over(so_far)
                ranked = ranked.withColumn(f"{kind}_stop_{b}", stop)
                part = F.when(F.col(f"{kind}_stop_{b}") == 0, F.col("gain") / F.log2(F.col(i) + 2)).otherwise(0.0)
                sums.append(F.sum(part).alias(f"{kind}_{b}"))
        m = ranked.groupBy(*self.keys).agg(*sums)
        names = [f"ndcg_at_{b}" for b in budgets]
        out = m.select(*self.keys, *[F.least(_ratio(F.col(f"dcg_{b}"), F.col(f"idcg_{b}")), F.lit(1.0)).alias(n) for b, n in zip(budgets, names)])
        return self._all(out, *names)

    def recall_at(self, budgets: Sequence[int] = BUDGETS) -> DataFrame:
        """recall_at_N: core lines among the first N predicted lines in rank order; repeated lines use up the budget."""
        before = Window.partitionBy(*self.keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
        size = F.col("re") - F.col("rs") + 1
        lined = self.preds.filter("rs <= re").withColumn("used", F.coalesce(F.sum(size).over(before), F.lit(0)))
        cut = lined.withColumn("b", F.explode(F.array(*[F.lit(b) for b in budgets]))).filter("used < b").select(
            *self.keys, "b", "path", F.col("rs").alias("s"), F.least("re", F.col("rs") + F.col("b") - F.col("used") - 1).alias("e"), F.lit(1).alias("p"), F.lit(0).alias("c")
        )
        goal = self._lines(self.core).withColumn("b", F.explode(F.array(*[F.lit(b) for b in budgets]))).select(
            *self.keys, "b", "path", "s", "e", F.lit(0).alias("p"), F.lit(1).alias("c")
        )
        p, c = F.col("p") > 0, F.col("c") > 0
        m = iv.lengths(cut.unionByName(goal), [*self.keys, "b"], "path", ["p", "c"], {"hit": p & c, "n": c})
        out = m.groupBy(*self.keys).agg(*[F.max(F.when(F.col("b") == b, _ratio(F.col("hit"), F.col("n")))).alias(f"recall_at_{b}") for b in budgets])
        return self._all(out, *[f"recall_at_{b}" for b in budgets])

    def first_useful_hit(self) -> DataFrame:
        hits = iv.overlapping(self.preds.filter("rs <= re"), self.core.filter("rs <= re"), [*self.keys, "path"]).groupBy(*self.keys).agg(F.min("rank").alias("first"))
        n = self.preds.groupBy(*self.keys).agg(F.count("*").alias("n"))
        return self._all(hits.join(n, self.keys).select(*self.keys, (1 - F.col("first") / F.col("n")).alias("first_useful_hit")), "first_useful_hit")

    def context_mass(self) -> DataFrame:
        """kept_regions, unique_files, total_lines (not deduplicated), whole_file_share, avg_lines of resolved regions, main_share."""
        size = F.greatest(F.lit(0), F.col("re") - F.col("rs") + 1)
        marked = self.preds.join(self.main.withColumn("is_main", F.lit(1)), [*self.keys, "path"], "left")
        return marked.groupBy(*self.keys).agg(
            F.count("*").alias("kept_regions"),
            F.countDistinct("path").alias("unique_files"),
            F.coalesce(F.sum(size), F.lit(0)).alias("total_lines"),
            (F.count_if(F.expr("e = -1")) / F.count("*")).alias("whole_file_share"),
            F.coalesce(F.avg(size), F.lit(0.0)).alias("avg_lines"),
            (F.countDistinct(F.when(F.col("is_main") == 1, F.col("path"))) / F.countDistinct("path")).alias("main_share"),
        )

    def all_metrics(self, budgets: Sequence[int] = BUDGETS) -> DataFrame:
        """All of the above but context_mass, one row per case."""
        parts = [self.line_metrics(), self.file_metrics(), self.region_metrics(), self.weighted_core_coverage(), self.ndcg(budgets), self.recall_at(budgets), self.first_useful_hit()]
        out = parts[0]
        for part in parts[1:]:
            out = out.join(part, self.keys)
        return out


def at_budgets(preds: DataFrame, ks: Sequence[int], rank: str = "rank") -> DataFrame:
    """Predictions of one run at the largest k, once per k with those of rank below k."""
    return preds.withColumn("top_k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter(F.col(rank) < F.col("top_k"))
