"""Records for patch generation: contexts of instances, regions found by explorers, and the selection of instances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.normalize import slice_lines


def selected_groups(trajectories: DataFrame, model: str | None = None, instance: str | None = None, repo: str | None = None, least: int = 1) -> DataFrame:
    """Trajectories whose model, instance and repository match a pattern each (found anywhere; null is empty), of instances with at least ``least`` of them."""
    kept = trajectories
    for column, pattern in (("model", model), ("instance_id", instance), ("repo", repo)):
        if pattern is not None:
            kept = kept.filter(F.coalesce(column, F.lit("")).rlike(pattern))
    if least <= 1:
        return kept
    # Counted apart and joined back: a hot instance is counted before the shuffle and never gathered.
    enough = kept.groupBy("instance_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("instance_id")
    return kept.join(enough, "instance_id", "left_semi")


def region_contents(regions: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Regions (keys, instance_id, repo, path, s, e) with the lines of their file (repo, path, lines ARRAY), cut to it; regions of unknown files and empty ones are left out."""
    joined = regions.join(files, ["repo", "path"])
    cut = slice_lines(F.col("lines"), F.col("s"), F.col("e"))
    return joined.select(*keys, "path", "s", "e", cut.alias("content")).filter("content <> ''")


def context_records(core: DataFrame, optional: DataFrame, issues: DataFrame, modified: DataFrame, files: DataFrame) -> DataFrame:
    """One record per instance with a core context: instance_id, repo, issue, core, optional (arrays of path, s, e, content), modified_files.

    core and optional: instance_id, repo, path, s, e; issues: instance_id, issue; modified:
    instance_id, path; files: repo, path, lines. Instances without an issue, without a known file or
    with an empty core are left out. A region counts once, those of several models too.
    """
    gathered = lambda df, name: region_contents(df.distinct(), files, ["instance_id", "repo"]).groupBy("instance_id", "repo").agg(
        F.array_sort(F.collect_list(F.struct("path", "s", "e", "content"))).alias(name)
    )
    known = issues.filter(F.coalesce(F.trim("issue"), F.lit("")) != "").select("instance_id", "issue").dropDuplicates(["instance_id"])
    changed = modified.groupBy("instance_id").agg(F.array_sort(F.collect_set("path")).alias("modified_files"))
    none = F.array().cast("array<struct<path:string,s:bigint,e:bigint,content:string>>")
    return (
        gathered(core, "core").join(known, "instance_id")
        .join(gathered(optional, "optional"), ["instance_id", "repo"], "left")
        .join(changed, "instance_id", "left")
        .select("instance_id", "repo", "issue", "core", F.coalesce("optional", none).alias("optional"), F.coalesce("modified_files", F.array().cast("array<string>")).alias("modified_files"))
    )


def explorer_regions(results: DataFrame, order: str = "pos") -> DataFrame:
    """Regions of each instance from its last result row (instance_id, order, regions ARRAY<STRUCT<path, s, e>>): instance_id, rank from 0, path, s, e; a row without regions leaves none."""
    last = results.groupBy("instance_id").agg(F.max_by("regions", order).alias("regions"))
    return last.select("instance_id", F.posexplode("regions").alias("rank", "r")).select("instance_id", "rank", "r.path", "r.s", "r.e")

