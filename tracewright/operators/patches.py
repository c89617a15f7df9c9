"""Patches of runs: their hunks, where they come from, whether they stay within what may be changed, and repairs."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators import extract as ex
from tracewright.operators import intervals as iv

#: Where a patch may be found, the best place first.
SOURCES = ("info.submission", "info.patch", "assistant.content", "tool.content", "tool.extra.raw_output")
_DIFF = r"(?m)^diff --git "
_HUNK = r"(?m)^@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@"


def hunks(df: DataFrame, keys: Sequence[str], patch: str) -> DataFrame:
    """keys, path, hunk_no, s, e: old lines of each hunk of a diff. A hunk without old lines is the line it stands at.

    Worked out within the row of a diff: sections of files, then hunks of a section.
    """
    keys = list(keys)
    section = F.explode(F.split(F.concat(F.lit("\n"), patch), r"\n(?=diff --git |--- \S[^\n]*\n\+\+\+ )")).alias("part")
    parts = df.filter(F.col(patch).isNotNull()).select(*keys, section).filter(F.col("part").rlike(_HUNK))
    path = F.coalesce(
        F.nullif(F.regexp_extract("part", r"(?m)^\+\+\+ b/([^\t\n]+)", 1), F.lit("")), F.nullif(F.regexp_extract("part", r"(?m)^--- a/([^\t\n]+)", 1), F.lit("")), F.regexp_extract("part", r"^diff --git a/(\S+)", 1)
    )
    starts = F.regexp_extract_all("part", F.lit(_HUNK), F.lit(1))
    sizes = F.regexp_extract_all("part", F.lit(_HUNK), F.lit(2))
    one = parts.select(*keys, path.alias("path"), F.posexplode(F.arrays_zip(starts.alias("s"), sizes.alias("n"))).alias("hunk_no", "h"))
    s, n = F.col("h.s").cast("bigint"), F.coalesce(F.col("h.n").try_cast("bigint"), F.lit(1))
    return one.select(*keys, "path", "hunk_no", s.alias("s"), F.greatest(s, s + n - 1).alias("e"))


def whole_diff(text: Column) -> Column:
    """Whether a text holds a diff that can be applied: a file head with its pair of names, or a head of a hunk below them."""
    return F.coalesce(text.rlike(r"(?m)^--- \S.*\n\+\+\+ \S.*\n@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@"), F.lit(False))


def candidates(texts: DataFrame) -> DataFrame:
    """Texts (instance_id, source, text) with signs of a diff: the same columns, patch (from where the diff begins) and whether it is whole."""
    begins = F.regexp_extract("text", r"(?s)((?:(?<=\n)|^)(?:diff --git |--- a/).*)", 1)
    found = texts.filter(F.col("text").rlike(r"(?m)^(?:diff --git |--- a/)"))
    return found.select("instance_id", "source", "text", begins.alias("patch"), whole_diff(begins).alias("whole"))


def best_candidate(found: DataFrame) -> DataFrame:
    """The whole diff of each instance from the best source, the longest of several."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source")), F.lit(0)), F.lit(len(SOURCES) + 1))
    return found.filter("whole").groupBy("instance_id").agg(F.min_by(F.struct("source", "patch"), F.struct(rank, -F.length("patch"), "patch")).alias("x")).select("instance_id", "x.source", "x.patch")


def allowed_lines(regions: DataFrame, mode: str = "merged_spans_per_file", padding: int = 0) -> DataFrame:
    """Regions (instance_id, path, s, e, n_lines) that a patch may change: merged per file, or widened by ``padding`` first (``span_padding``).

    An end of -1 is the end of the content, n_lines. ``file_level_allow`` allows every line of a named file.
    """
    keys = ["instance_id", "path"]
    if mode == "file_level_allow":
        return regions.select(*keys).distinct().select(*keys, F.lit(1).cast("bigint").alias("s"), F.lit(2**31 - 1).cast("bigint").alias("e"))
    if mode not in ("merged_spans_per_file", "span_padding"):
        raise ValueError(f"unknown mode {mode}")
    wide = padding if mode == "span_padding" else 0
    e = F.when(F.col("e") == -1, F.col("s") + F.coalesce("n_lines", F.lit(0)) - 1).otherwise(F.col("e"))
    return iv.merge(regions.select(*keys, F.greatest(F.lit(1), F.col("s") - wide).alias("s"), (e + wide).alias("e")), keys)


def diagnoses(runs: DataFrame, texts: DataFrame, regions: DataFrame, mode: str = "merged_spans_per_file", padding: int = 0) -> DataFrame:
    """Why a run gave no patch: instance_id, has_diff, source, file_check, region_check, failure.

    runs: instance_id, exit_status, prediction; texts as for :func:`candidates`; regions as for
    :func:`allowed_lines`. failure is null where there is a prediction; else no_diff_limits_exceeded,
    no_diff, extraction_failed, file_outside, region_outside or within_allowed_but_lost.
    """
    found = candidates(texts)
    best = best_candidate(found)
    seen = found.select("instance_id").distinct().withColumn("has_diff", F.lit(True))
    allowed = allowed_lines(regions, mode, padding)
    changed = hunks(best, ["instance_id"], "patch").withColumnsRenamed({"s": "rs", "e": "re"})
    on = ["instance_id", "path"]
    files = allowed.select(*on).distinct().withColumn("known", F.lit(True))
    inside = iv.covered_lines(changed, allowed, on, [*on, "hunk_no"]).withColumnRenamed("common", "inside")
    per_run = changed.join(files, on, "left").join(inside, [*on, "hunk_no"], "left").groupBy("instance_id").agg(
        F.max(F.col("known").isNull()).alias("file_outside"), F.max(F.coalesce("inside", F.lit(0)) < F.col("re") - F.col("rs") + 1).alias("region_outside")
    )
    told = runs.join(seen, "instance_id", "left").join(best.select("instance_id", "source"), "instance_id", "left").join(per_run, "instance_id", "left")
    judged = F.col("file_outside").isNotNull()
    file_check = F.when(judged, F.when(F.col("file_outside"), "file_outside_allowed_files").otherwise("pass"))
    region = F.lit("file_level_allow_allows_any_line") if mode == "file_level_allow" else F.when(F.col("region_outside"), "file_allowed_but_region_outside").otherwise("fully_within_allowed_regions")
    region_check = F.when(judged & ~F.col("file_outside"), region)
    failure = (
        F.when(F.coalesce(F.trim("prediction"), F.lit("")) != "", None)
        .when(F.col("has_diff").isNull() & (F.coalesce("exit_status", F.lit("")) == "LimitsExceeded"), "no_diff_limits_exceeded")
        .when(F.col("has_diff").isNull(), "no_diff")
        .when(F.col("source").isNull(), "extraction_failed")
        .when(F.col("file_outside"), "file_outside")
        .when(F.col("region_outside") & F.lit(mode != "file_level_allow"), "region_outside")
        .otherwise("within_allowed_but_lost")
    )
    return told.select("instance_id", F.coalesce("has_diff", F.lit(False)).alias("has_diff"), "source", file_check.alias("file_check"), region_check.alias("region_check"), failure.alias("failure"))


def repaired(patch: str | None) -> str | None:
    """A patch whose lines lost their marks: ends of lines stripped, lines of a hunk without a mark made context, heads of hunks recounted.

    Blank patches and null stay as they are.
    """
    if patch is None or not patch.strip():
        return patch
    lines = [line.rstrip() for line in patch.splitlines()]
    head = lambda i: lines[i].startswith("diff --git") or (lines[i].startswith("--- ") and lines[i + 1 : i + 2] != [] and lines[i + 1].startswith("+++ "))
    out, in_hunk = [], False
    for i, line in enumerate(lines):
        if head(i) or (line.startswith("+++ ") and i and lines[i - 1].startswith("--- ")):
            in_hunk = False
        elif line.startswith("@@") and "@@" in line[2:]:
            in_hunk = True
        elif in_hunk and line[:1] not in ("+", "-", "\\", " "):
            line = " " + line
        out.append(line)
    return ex.recount_hunks("\n".join(out)) + "\n"


def text_column(function: Callable[[str | None], object], kind: str = "string") -> Callable[[Column], Column]:
    """A text function of one value as a column function over Arrow batches."""

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([function(None if t is None else t) for t in texts], index=texts.index, dtype=object)

    return run


def diff_of(text: Column) -> Column:
    """:func:`extract.extract_diff` of a column."""
    return text_column(ex.extract_diff)(text)


def repaired_patch(text: Column) -> Column:
    return text_column(repaired)(text)


def test_names(text: Column) -> Column:
    """:func:`extract.test_list` of a column: names given as JSON or as a Python literal."""
    return text_column(ex.test_list, "array<string>")(text)


def json_object_in(text: Column) -> Column:
    """The first JSON object in a text, as JSON with sorted keys."""

    def run(t: str | None) -> str | None:
        found = ex.first_json_object(t)
        return None if found is None else json.dumps(found, sort_keys=True, ensure_ascii=False)

    return text_column(run)(text)
