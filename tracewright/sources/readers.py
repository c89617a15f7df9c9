"""Readers of JSON lines, trajectory trees, event streams and source trees."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewright.functions.text import LINE_BREAK

#: Source files by suffix, and folders that are never entered.
SOURCE_SUFFIXES = (".py", ".md", ".txt", ".toml", ".cfg", ".ini", ".yaml", ".yml", ".json", ".rst", ".ets", ".ts", ".json5")
EXCLUDED_DIRS = (".git", "node_modules", "oh_modules", "build", ".hvigor", "dist", ".venv", "venv", "__pycache__", ".pytest_cache", ".mypy_cache")


def json_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """One object per line; a bad line fails the job. Blank lines are skipped, or are bad lines with ``strict``."""
    raw = spark.read.text(path)
    lines = raw if strict else raw.filter(F.col("value").rlike(r"(?U)\S"))
    # An empty text parses to null instead of failing.
    text = F.when(F.trim("value") == "", F.raise_error(F.lit("blank line"))).otherwise(F.col("value")) if strict else F.col("value")
    return lines.select(F.from_json(text, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def context_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of contexts (instance_id, issue, conversation), the last line of an instance wins; a missing text is empty."""
    raw = spark.read.text(path).filter(F.col("value").rlike(r"(?U)\S")).withColumn("at", F.monotonically_increasing_id())
    r = F.from_json("value", "instance_id string, issue string, conversation string", {"mode": "FAILFAST"})
    rows = raw.select("at", r.alias("r")).filter("r.instance_id is not null")
    last = rows.groupBy("r.instance_id").agg(F.max_by("r", "at").alias("r"))
    return last.select("r.instance_id", F.coalesce("r.issue", F.lit("")).alias("issue"), F.coalesce("r.conversation", F.lit("")).alias("conversation"))


def folder_names(spark: SparkSession, root: str) -> DataFrame:
    """Names of the folders right below ``root``, sorted: one row per folder, files left out. The listing of one folder is small."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()] if fs.exists(folder) else []
    return spark.createDataFrame([(n,) for n in sorted(names)], "name string")


def tolerant_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """path and variant of every line that is a JSON object; bad UTF-8 is replaced, all else is dropped."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("t"))
    v = F.try_parse_json("t")
    return raw.select("path", v.alias("row")).filter(F.schema_of_variant("row").startswith("OBJECT"))


def keyed_json_lines(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """Lines of the form {key: {...}}: key and the fields of its value."""
    m = F.from_json("value", f"map<string,{value_schema}>")
    return spark.read.text(path).select(F.explode(m).alias("key", "v")).select("key", "v.*")


def json_tree(spark: SparkSession, path: str, schema: StructType | str, glob: str = "*.json") -> DataFrame:
    """Whole-file JSON documents below a folder, unreadable ones skipped: file_path and the fields."""
    docs = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("mode", "DROPMALFORMED").json(path)
    return docs.select(F.col("_metadata.file_path").alias("file_path"), "*")


def parquet_parts(spark: SparkSession, glob: str, schema: StructType | str | None = None) -> DataFrame:
    """Parquet parts; corrupt ones are skipped. Without a schema it is taken from one part, from all of them if that one is corrupt."""
    reader = spark.read.option("ignoreCorruptFiles", True)
    if schema is not None:
        return reader.schema(schema).parquet(glob)
    try:
        return reader.parquet(glob)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return reader.option("mergeSchema", True).parquet(glob)


def event_lines(raw: DataFrame, text: str = "value", keys: Iterable[str] = ()) -> DataFrame:
    """Events of newline-delimited JSON, one variant per row: byte-order marks go, arrays are flattened, bad lines dropped."""
    keys = list(keys)
    line = F.btrim(F.translate("line", "﻿", ""))
    lines = raw.select(*keys, F.posexplode(F.split(text, LINE_BREAK)).alias("pos", "line")).select(*keys, "pos", line.alias("line")).filter(F.col("line").rlike(r"^[\[{]"))
    v = lines.select(*keys, "pos", F.try_parse_json("line").alias("v"))
    items = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v").cast("array<variant>")).otherwise(F.array("v"))
    flat = v.filter("v is not null").select(*keys, "pos", F.posexplode(items).alias("item", "event"))
    return flat.filter(F.schema_of_variant("event").startswith("OBJECT"))


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:  # the built-in decode fails on bad bytes
        yield pd.DataFrame({"path": batch["path"], "text": [bytes(b).decode("utf-8", "replace") for b in batch["content"]]})


def source_tree(spark: SparkSession, root: str, suffixes: Iterable[str] = SOURCE_SUFFIXES, excluded: Iterable[str] = EXCLUDED_DIRS) -> DataFrame:
    """Source files below a folder: path relative to it and text. Suffixes and folder names match without regard to case.

    Bytes that are no UTF-8 are replaced. Order by path for a fixed order; byte order is code point order.
    """
    suffixes = tuple(s.lower() if s.startswith(".") else f".{s.lower()}" for s in ([suffixes] if isinstance(suffixes, str) else suffixes))
    excluded = [d.rstrip("/\\").lower() for d in ([excluded] if isinstance(excluded, str) else excluded)]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").removeprefix("file:") + "/"
    # A condition on the file's metadata prunes the listing, so the bytes of other files are never read.
    place = F.lower(F.col("_metadata.file_path"))
    start = re.escape(base.lower())
    wanted = place.rlike("(?:" + "|".join(re.escape(s) for s in suffixes) + ")$")
    if excluded:
        wanted = wanted & ~place.rlike(f"{start}(?:.*/)?(?:{'|'.join(re.escape(d) for d in excluded)})/")
    rel = F.substring_index(F.regexp_replace("path", "^file:/*", "/"), base, -1)
    return files.filter(wanted).select(rel.alias("path"), "content").mapInPandas(_decoded, "path string, text string")
