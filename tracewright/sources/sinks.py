"""Writers: JSON lines, partitioned trees, staged replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def partitioned_json(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """One folder per combination of ``by``, in place of a file name template."""
    df.write.mode("overwrite").partitionBy(*by).json(path)


def replace_json(df: DataFrame, path: str) -> None:
    """Replaces a folder, so that ``df`` may have been read from it and a crash loses nothing.

    The new data are written beside it, the old folder is renamed aside, the new one takes its
    place, and only then is the old one deleted. After a crash between the renames the old data lie
    in ``path.old``; the next call puts them back first.
    """
    staging, aside = (path.rstrip("/") + x for x in (".staging", ".old"))
    jvm = df.sparkSession._jvm
    target, staged, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, staging, aside))
    fs = target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())

    def move(a, b) -> None:
        if not fs.rename(a, b):
            raise OSError(f"could not move {a} to {b}")

    if fs.exists(old):
        if fs.exists(target):
            fs.delete(old, True)
        else:
            move(old, target)
    df.write.mode("overwrite").json(staging)
    if fs.exists(target):
        move(target, old)
    move(staged, target)
    fs.delete(old, True)


def json_tree(df: DataFrame, path: str, by: Sequence[str], body: str) -> None:
    """One folder per combination of ``by``, with the text column ``body`` as its lines: a tree of one record, or one log, per instance.

    Rows are clustered by the folder first, so each folder gets few files however many tasks there are.
    """
    df.select(*by, body).repartition(*by).write.mode("overwrite").partitionBy(*by).text(path)


def record_and_log(df: DataFrame, path: str, by: Sequence[str], log: str) -> None:
    """Per result its record as JSON below ``path/record`` and its log as text below ``path/log``; a null log is an empty one."""
    record = F.to_json(F.struct(*[c for c in df.columns if c != log]))
    told = df.select(*by, record.alias("record"), F.coalesce(log, F.lit("")).alias("log"))
    json_tree(told, f"{path.rstrip('/')}/record", by, "record")
    json_tree(told, f"{path.rstrip('/')}/log", by, "log")


def clashing_targets(pairs: DataFrame, path: str = "path") -> DataFrame:
    """Output paths that more than one pair would write."""
    return pairs.groupBy(path).agg(F.count("*").alias("n")).filter("n > 1")


def single_json(df: DataFrame, path: str) -> None:
    """A small summary as one file."""
    df.coalesce(1).write.mode("overwrite").json(path)
