"""Text expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what ends a line in the language's own line splitting.
LINE_BREAK = "\r\n|[\n\u000b\u000c\r\u001c-\u001e\u0085  ]"


def split_lines(text: Column, breaks: str = LINE_BREAK) -> Column:
    """Lines without their ends; no empty line after a last line end; an empty text has no lines."""
    parts = F.split(text, breaks)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(whole)


def words(text: Column) -> Column:
    """Runs without any kind of blank."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def identifiers(text: Column) -> Column:
    """Lower-case identifiers of two or more characters; letters beyond ASCII make a word no identifier."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}\p{M}_]+)"), F.lit(1))
    return F.filter(runs, lambda w: w.rlike("^[a-z_][a-z0-9_]+$"))


def word_counts(df: DataFrame, keys: Sequence[str], text_words: Column) -> DataFrame:
    """keys, n_words, w and c: each word of a text once with its count, counted within the row, so nothing is shuffled. Texts without words have one row with a null word."""
    keys = list(keys)
    ordered = df.select(*keys, F.array_sort(text_words).alias("__s"))
    n = F.size("__s")
    first = lambda i: (i == 1) | (F.element_at("__s", i) != F.element_at("__s", i - 1))
    starts = ordered.select(*keys, "__s", F.when(n > 0, F.filter(F.sequence(F.lit(1), n), first)).otherwise(F.array().cast("array<int>")).alias("__at"))
    run = lambda i, j: F.struct(F.element_at("__s", i).alias("w"), (F.coalesce(F.get("__at", j + 1), n + 1) - i).cast("bigint").alias("c"))
    return starts.select(*keys, n.alias("n_words"), F.explode_outer(F.transform("__at", run)).alias("__r")).select(*keys, "n_words", "__r.w", "__r.c")
