"""Functions and classes of source files, and answers of several formats that name them."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.variants import strict_json

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Suffixes of paths in raw answer lines.
SOURCE_SUFFIXES = (
    "py", "go", "java", "js", "ts", "tsx", "jsx", "rs", "rb", "php", "c", "h", "cc", "cpp", "cxx", "hpp", "hh", "hxx", "scala", "kt", "swift", "cs", "lua", "dart", "ex", "exs", "erl", "clj", "m", "mm",
    "proto", "sh", "bash", "yml", "yaml", "sql",
)


def named_entities(source: str | None) -> list[tuple[str, int, int]]:
    """(name, first line, last line) of every function, class and Class.method of a Python source; the first of a name counts.

    Names are met level by level, so an outer one goes before an inner one. A source that can't be
    parsed has none.
    """
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    found: dict[str, tuple[int, int]] = {}
    for node in ast.walk(tree):
        if isinstance(node, (*FUNCTIONS, ast.ClassDef)):
            found.setdefault(node.name, (node.lineno, node.end_lineno or node.lineno))
        if isinstance(node, ast.ClassDef):
            for inner in ast.walk(node):
                if isinstance(inner, FUNCTIONS):
                    found.setdefault(f"{node.name}.{inner.name}", (inner.lineno, inner.end_lineno or inner.lineno))
    return [(name, *lines) for name, lines in found.items()]


def entity_table(files: DataFrame) -> DataFrame:
    """repo, path, name, s, e of the functions and classes of Python files (repo, path, text). Repeated files count once; null texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(r, p, *x) for r, p, t in zip(batch["repo"], batch["path"], batch["text"]) for x in named_entities(t)]
            yield pd.DataFrame(rows, columns=["repo", "path", "name", "s", "e"])

    sources = files.filter("text is not null and path like '%.py'").select("repo", "path", "text")
    found = sources.mapInPandas(run, "repo string, path string, name string, s bigint, e bigint")
    first = F.min(F.struct("s", "e")).alias("x")
    return found.groupBy("repo", "path", "name").agg(first).select("repo", "path", "name", "x.s", "x.e")


def located(named: DataFrame, entities: DataFrame) -> DataFrame:
    """Lines of named entities (instance_id, repo, pos, path, name): an entity that is not found is its whole file (1, -1)."""
    joined = named.join(entities, ["repo", "path", "name"], "left")
    return joined.select("instance_id", "pos", "path", F.coalesce("s", F.lit(1)).cast("bigint").alias("s"), F.coalesce("e", F.lit(-1)).cast("bigint").alias("e"))


def _clean(path: Column) -> Column:
    return F.regexp_replace(F.translate(F.trim(path), "\\", "/"), r"^(?:\./|/)+", "")


def _answers(answers: DataFrame, more: list[str]) -> DataFrame:
    return strict_json(answers, ["instance_id", *more], F.col("answer"))


def _texts(path: str) -> Column:
    """Texts of a list, or of a list of lists, at a path of the variant ``v``."""
    nested = F.flatten(F.try_variant_get("v", path, "array<array<string>>"))
    return F.coalesce(nested, F.try_variant_get("v", path, "array<string>"), F.array().cast("array<string>"))


def _files(v: DataFrame) -> DataFrame:
    files = v.select("instance_id", F.posexplode(_texts("$.found_files")).alias("pos", "p"))
    return files.select("instance_id", "pos", _clean(F.col("p")).alias("path"), F.lit(1).cast("bigint").alias("s"), F.lit(-1).cast("bigint").alias("e")).filter("path <> ''")


def listed_locations(answers: DataFrame) -> DataFrame:
    """Answers [{"rel_file_path", "start", "end"}]: instance_id, pos, path, s, e; no start is 1, no end is -1."""
    items = _answers(answers, []).select("instance_id", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("pos", "x"))
    n = lambda k, d: F.coalesce(F.nullif(F.try_variant_get("x", f"$.{k}", "bigint"), F.lit(0)), F.lit(d))
    path = _clean(F.try_variant_get("x", "$.rel_file_path", "string"))
    return items.select("instance_id", "pos", path.alias("path"), n("start", 1).alias("s"), n("end", -1).alias("e")).filter("path <> ''")


def bug_locations(answers: DataFrame, entities: DataFrame) -> DataFrame:
    """Answers {"bug_locations": [{"file_path", "class_name", "method_name", "line_range": "[a, b]"}]}: instance_id, pos, path, s, e.

    A range that can't be read is looked up by class and method; without any range it is the whole file.
    """
    items = _answers(answers, ["repo"]).select("instance_id", "repo", F.posexplode(F.try_variant_get("v", "$.bug_locations", "array<variant>")).alias("pos", "x"))
    text = lambda k: F.coalesce(F.try_variant_get("x", f"$.{k}", "string"), F.lit(""))
    pattern = r"^\s*[\[(]\s*(-?\d+)\s*,\s*(-?\d+)\s*,?\s*[\])]\s*$"
    bound = lambda i: F.regexp_extract("range", pattern, i).try_cast("bigint")
    name = F.concat_ws(".", *[F.nullif(text(k), F.lit("")) for k in ("class_name", "method_name")])
    told = items.select("instance_id", "repo", "pos", _clean(text("file_path")).alias("path"), text("line_range").alias("range"), name.alias("name")).filter("path <> ''")
    read = (F.col("range") == "") | bound(1).isNotNull()
    ranged = told.filter(read).select("instance_id", "pos", "path", F.coalesce(bound(1), F.lit(1)).alias("s"), F.coalesce(bound(2), F.lit(-1)).alias("e"))
    return ranged.unionByName(located(told.filter(~read), entities))


def related_locations(answers: DataFrame, entities: DataFrame) -> DataFrame:
    """Answers {"found_related_locs": {file: [names]}, "found_files": [...]}: instance_id, pos, path, s, e; files only where no name is given."""
    v = _answers(answers, ["repo"])
    entry = F.explode(F.map_entries(F.try_variant_get("v", "$.found_related_locs", "map<string,variant>"))).alias("f")
    names = v.select("instance_id", "repo", entry).select("instance_id", "repo", _clean(F.col("f.key")).alias("path"), F.posexplode(F.try_variant_get("f.value", "$", "array<string>")).alias("at", "name"))
    pos = (F.row_number().over(Window.partitionBy("instance_id").orderBy("path", "at")) - 1).alias("pos")  # names of one answer
    named = located(names.filter("name is not null").select("instance_id", "repo", "path", "name", pos), entities)
    return named.unionByName(_files(v.join(named.select("instance_id").distinct(), "instance_id", "left_anti")))


def found_entities(answers: DataFrame, entities: DataFrame) -> DataFrame:
    """Answers {"found_entities": ["file:Class.method"], "raw_output_loc": [text], "found_files": [...]}: instance_id, pos, path, s, e.

    The first of the three that gives anything counts. Lines of the raw texts must be a source path and a
    name without blanks; each counts once.
    """
    v = _answers(answers, ["repo"])
    part = lambda x: F.struct(_clean(F.substring_index(x, ":", 1)).alias("path"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("name"))
    given = F.transform(F.filter(_texts("$.found_entities"), lambda x: x.contains(":")), part)
    lines = F.flatten(F.transform(_texts("$.raw_output_loc"), lambda t: F.split(t, r"\r?\n")))
    bare = F.transform(lines, lambda x: F.btrim(x, F.lit("` \t")))
    suffix = r"(?i)^[^:#]*\.(?:" + "|".join(SOURCE_SUFFIXES) + r")\s*:\s*\S+$"
    raw = F.array_distinct(F.transform(F.filter(bare, lambda x: x.rlike(suffix)), part))
    told = v.select("*", F.when(F.size(given) > 0, given).otherwise(raw).alias("told"))
    named = told.select("instance_id", "repo", F.posexplode("told").alias("pos", "x")).select("instance_id", "repo", "pos", "x.path", "x.name")
    return located(named, entities).unionByName(_files(told.filter("size(told) = 0")))
