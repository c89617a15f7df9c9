"""Variant expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a text is put between so that the parser, which stops after one value, meets what follows it.
_BEFORE, _AFTER, _VALUE = '[[{"v":[', "]}]]", "$[0][0].v"


def worked_out(df: DataFrame, keys: Sequence[str], value: Column, name: str, nulls: bool = False) -> DataFrame:
    """``keys`` and a costly value, computed once per row: the optimizer copies no expression out of an explode. Rows without a value are left out, or kept with ``nulls``."""
    one = F.array(value)
    return df.select(*keys, F.explode(one if nulls else F.filter(one, lambda x: x.isNotNull())).alias(name))


def _framed(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit(_BEFORE), text, F.lit(_AFTER)))


def _only(framed: Column) -> Column:
    return F.when(F.try_variant_get(framed, f"{_VALUE}[1]", "variant").isNull(), F.try_variant_get(framed, f"{_VALUE}[0]", "variant"))


def strict_json(df: DataFrame, keys: Sequence[str], text: Column, name: str = "v", twice: bool = False, nulls: bool = False) -> DataFrame:
    """``keys`` and the one JSON value that a text is, as a variant; rows whose text is anything else are left out, or have a null with ``nulls``.

    A value with something behind it is no JSON, nor are objects with a key twice, values nested
    deeper than 1,000 levels and texts above the size limit of a variant. With ``twice`` a JSON
    string is read once more: its text must be JSON too.
    """
    keys = list(keys)
    framed = worked_out(df, keys, _framed(text), "__f", nulls)
    one = worked_out(framed, keys, _only(F.col("__f")), "__one", nulls)
    if not twice:
        return one.withColumnRenamed("__one", name)
    # An object, a list or a number has no text of its own; only what is a string is parsed again.
    string = F.when(F.schema_of_variant("__one") == "STRING", _framed(F.try_variant_get("__one", "$", "string")))
    again = one.select(*keys, "__one", F.explode(F.array(F.struct((F.schema_of_variant("__one") == "STRING").alias("s"), string.alias("f")))).alias("__x"))
    return worked_out(again, keys, F.when(F.col("__x.s"), _only(F.col("__x.f"))).otherwise(F.col("__one")), name, nulls)


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def is_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>").isNotNull()


def depth(marks: Column, opening: str, closing: str) -> Column:
    """Greatest depth of a text of brackets."""
    seen = F.aggregate(
        F.split(marks, ""),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")),
        lambda a, x: F.struct(
            (a["at"] + F.when(x.isin(*opening), 1).when(x.isin(*closing), -1).otherwise(0)).alias("at"),
            F.greatest(a["most"], a["at"] + F.when(x.isin(*opening), 1).otherwise(0)).alias("most"),
        ),
    )
    return seen["most"]


def levels(value: Column) -> Column:
    """Levels of objects and lists in a value: those of its inferred schema, or of its text where the schema hides some below mixed types."""
    schema = F.schema_of_variant(value)
    bare = F.regexp_replace(value.cast("string"), r'"(?:[^"\\]|\\.)*+"', "")
    return F.when(schema.contains("VARIANT"), depth(F.regexp_replace(bare, r"[^\[\]{}]", ""), "[{", "]}")).otherwise(
        depth(F.regexp_replace(schema, "[^<>]", ""), "<", ">")
    )
