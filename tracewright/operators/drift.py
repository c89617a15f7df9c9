"""Schemas that drift between the files of a feed: one table, and a list of every change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.variants import strict_json, worked_out
from tracewright.session import cut_lineage, small

#: Share of re-sent records whose values must agree under the old and the new key.
RENAME_SHARE = 0.6
#: Share of distinct values in common that is asked for where no re-sent records tell.
RENAME_VALUES = 0.5


#: JSON types in the order in which they are joined; each is one bit of a number.
KINDS = ("array", "boolean", "number", "object", "string")


def _kind(value: Column) -> Column:
    """JSON type of a variant value."""
    name = F.schema_of_variant(value)
    return (
        F.when(name.startswith("OBJECT"), "object")
        .when(name.startswith("ARRAY"), "array")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "VOID", None)
        .otherwise("number")
    )


def _bit(value: Column) -> Column:
    """The bit of a value's type; null for JSON null."""
    bits = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, 1 << i)])
    return F.element_at(bits, _kind(value))


def _kinds(bits: Column) -> Column:
    """Names of the types that are set in ``bits``, joined."""
    return F.concat_ws("|", *[F.when(bits.bitwiseAND(F.lit(1 << i)) > 0, k) for i, k in enumerate(KINDS)])


def _canonical(value: Column) -> Column:
    """Text of a value that is the same for 5 and "5", or for an object and its JSON in a string."""
    text = value.cast("string")
    inner = F.try_parse_json(F.when(text.rlike(r"^\s*[\[{]"), text)).cast("string")
    return F.coalesce(inner, text)


def _lines(records: DataFrame, *more: str) -> DataFrame:
    """feed, file_name, more columns, and the fields of each valid line as a map of variants. Lines that are null, no JSON or no JSON object are left out."""
    keys = ["feed", "file_name", *more]
    parsed = strict_json(records, keys, F.col("raw_line"))
    return worked_out(parsed, [*keys, "v"], F.try_variant_get("v", "$", "map<string,variant>"), "fields")


def tagged_fields(records: DataFrame) -> DataFrame:
    """Types of each top-level field of each file, as bits: feed, file_name, field, bits. Null values have no type."""
    one = _lines(records).select("feed", "file_name", F.explode("fields").alias("field", "value"))
    return one.select("feed", "file_name", "field", _bit(F.col("value")).alias("bit")).filter("bit is not null").groupBy("feed", "file_name", "field").agg(F.bit_or("bit").alias("bits"))


def _compared(records: DataFrame, id_field: str) -> tuple[DataFrame, ...]:
    """files with their number, fields that are new, old and of another type, gone, came, and the renamings among them.

    Lines are parsed twice: once for the types of all fields, and once for the values of the few
    fields that went or came, in files that have both. Each result is written once.
    """
    records = records.filter("feed is not null and file_name is not null")
    order = Window.partitionBy("feed").orderBy("file_name")
    files = small(records.select("feed", "file_name").distinct().withColumn("n", F.row_number().over(order)))
    types = cut_lineage(tagged_fields(records).join(files, ["feed", "file_name"]).select("feed", "n", "file_name", "field", _kinds(F.col("bits")).alias("kind")))
    new = types.select("feed", "n", "field", F.col("kind").alias("new_kind"))
    old = types.select("feed", (F.col("n") + 1).alias("n"), "field", F.col("kind").alias("old_kind"))
    both = cut_lineage(
        new.join(old, ["feed", "n", "field"], "full_outer")
        .filter("n > 1 and not new_kind <=> old_kind")
        .join(files, ["feed", "n"], "left_semi")
    )
    gone = both.filter("new_kind is null").select("feed", "n", "field")
    came = both.filter("old_kind is null").select("feed", "n", "field")

    # Fields to compare, by the file that holds them; n is the file in which the change shows.
    either = gone.select("feed", "n").distinct().join(came.select("feed", "n").distinct(), ["feed", "n"])
    asked = (
        gone.select("feed", "n", (F.col("n") - 1).alias("at"), "field", F.lit(True).alias("was"))
        .unionByName(came.select("feed", "n", F.col("n").alias("at"), "field", F.lit(False).alias("was")))
        .join(either, ["feed", "n"])
        .join(files.select("feed", F.col("n").alias("at"), "file_name"), ["feed", "at"])
        .groupBy("feed", "file_name").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("field", "was"), "n"))).alias("asked"))
    )
    picked = _lines(records.join(small(asked), ["feed", "file_name"]), "asked").select(
        "feed", F.try_variant_get("v", f"$.{id_field}", "string").alias("rec_key"), "fields", F.explode("asked").alias("which", "n")
    )
    value = F.element_at("fields", F.col("which.field"))
    told = picked.select("feed", "n", "rec_key", F.col("which.field").alias("field"), F.col("which.was").alias("was"), value.alias("value")).filter("value is not null and not is_variant_null(value)")
    told = cut_lineage(told.select("feed", "n", "rec_key", "field", "was", F.xxhash64(_canonical(F.col("value"))).alias("h")).distinct())

    pair = ["feed", "n", "old_field", "new_field"]

    def met(on: list[str], rows: DataFrame) -> DataFrame:
        """Old and new fields that meet in ``on``: fields of two files only, however often a value or an id is repeated."""
        one = rows.select(*on, "field", "was").distinct()
        return one.filter("was").withColumnRenamed("field", "old_field").drop("was").join(one.filter("not was").withColumnRenamed("field", "new_field").drop("was"), on)

    keyed = told.filter("rec_key is not null")
    seen = met(["feed", "n", "rec_key"], keyed).groupBy(*pair).agg(F.count("*").alias("seen"))
    same = met(["feed", "n", "rec_key", "h"], keyed).groupBy(*pair).agg(F.count_distinct("rec_key").alias("same"))
    common = met(["feed", "n", "h"], told).groupBy(*pair).agg(F.count("*").alias("common"))
    sizes = told.select("feed", "n", "field", "was", "h").distinct().groupBy("feed", "n", "field", "was").agg(F.count("*").alias("n_values"))
    size = lambda was, name: sizes.filter(F.col("was") == was).select("feed", "n", F.col("field").alias(f"{name}_field"), F.col("n_values").alias(f"n_{name}"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    judged = (
        seen.join(same, pair, "full_outer").join(common, pair, "full_outer")
        .select(*pair, zero("seen"), zero("same"), zero("common"))
        .join(size(True, "old"), ["feed", "n", "old_field"])
        .join(size(False, "new"), ["feed", "n", "new_field"])
        .withColumn("alike", F.col("common") / (F.col("n_old") + F.col("n_new") - F.col("common")))
        .filter(F.when(F.col("seen") >= 2, F.col("same") >= RENAME_SHARE * F.col("seen")).otherwise(F.col("alike") >= RENAME_VALUES))
    )
    rank = [F.desc("same"), F.desc("alike"), "old_field", "new_field"]
    renamed = cut_lineage(
        judged.withColumn("r1", F.row_number().over(Window.partitionBy("feed", "n", "old_field").orderBy(*rank)))
        .withColumn("r2", F.row_number().over(Window.partitionBy("feed", "n", "new_field").orderBy(*rank)))
        .filter("r1 = 1 and r2 = 1")
        .select(*pair)
    )
    return files, new, old, both, gone, came, renamed


def file_changes(records: DataFrame, id_field: str = "id") -> DataFrame:
    """Changes of each file against the previous file of its feed, in order of file_name.

    Result: file_name, change_kind (added, removed, renamed, retyped), field_name, new_value.

    Types per (feed, file, field) are fused with a map-side aggregate; what follows works on a few
    rows per file. A renaming is proved by records that the next file sends again: those with the
    same ``id_field`` in both files must agree under the old and the new key. Where fewer than two
    of them carry both keys, at least half of all distinct values must be common. A key takes part
    in one renaming only: the one with most agreeing records. Files without valid lines have no
    fields; the first file of a feed has no changes; rows without feed or file_name are left out.
    """
    files, new, old, both, gone, came, renamed = _compared(records, id_field)
    old_renamed = renamed.select("feed", "n", F.col("old_field").alias("field"))
    new_renamed = renamed.select("feed", "n", F.col("new_field").alias("field"))
    kinds = lambda c: F.lit(c).alias("change_kind")
    none = F.lit("").alias("new_value")
    changes = (
        came.join(new_renamed, ["feed", "n", "field"], "left_anti").select("feed", "n", kinds("added"), "field", none)
        .unionByName(gone.join(old_renamed, ["feed", "n", "field"], "left_anti").select("feed", "n", kinds("removed"), "field", none))
        .unionByName(renamed.select("feed", "n", kinds("renamed"), F.col("old_field").alias("field"), F.col("new_field").alias("new_value")))
        .unionByName(both.filter("new_kind is not null and old_kind is not null").select("feed", "n", kinds("retyped"), "field", F.col("new_kind").alias("new_value")))
        .unionByName(
            renamed.join(old.withColumnRenamed("field", "old_field"), ["feed", "n", "old_field"])
            .join(new.withColumnRenamed("field", "new_field"), ["feed", "n", "new_field"])
            .filter("new_kind <> old_kind")
            .select("feed", "n", kinds("retyped"), F.col("new_field").alias("field"), F.col("new_kind").alias("new_value"))
        )
    )
    return changes.join(files, ["feed", "n"]).select("file_name", "change_kind", F.col("field").alias("field_name"), "new_value")


def field_names(records: DataFrame, id_field: str = "id") -> DataFrame:
    """The one name of each key of each file: feed, file_name, field, name.

    The renamings that :func:`file_changes` finds are followed back to the name the field had first in
    its feed. Where that is the name of two keys of one file, the renamed field keeps it (the first
    by key of several), and the others have their own key added in brackets.
    """
    files, *_, renamed = _compared(records, id_field)
    back = F.reverse(F.array_sort(F.collect_list(F.struct("n", "old_field", "new_field"))))
    chains = renamed.groupBy("feed").agg(back.alias("chain"))
    known = _lines(records).select("feed", "file_name", F.explode(F.map_keys("fields")).alias("field")).distinct().join(files, ["feed", "file_name"])
    step = lambda name, r: F.when((r["n"] <= F.col("n")) & (r["new_field"] == name), r["old_field"]).otherwise(name)
    named = known.join(chains, "feed", "left").withColumn(
        "name", F.coalesce(F.aggregate("chain", F.col("field"), step), F.col("field"))
    )
    same = Window.partitionBy("feed", "file_name", "name").orderBy(F.col("field") == F.col("name"), "field")
    name = F.when(F.row_number().over(same) == 1, F.col("name")).otherwise(F.concat("name", F.lit(" ("), "field", F.lit(")")))
    return named.select("feed", "file_name", "field", name.alias("name"))


def unified_table(records: DataFrame, id_field: str = "id") -> DataFrame:
    """Every line of every file in one schema: a tagged union per path.

    A field that is renamed between files has one name in all of them, see :func:`field_names`. Each field keeps all alternative types as typed branches and a canonical text:
    fields MAP<field, STRUCT<kind, as_string, as_number, as_boolean, as_json>>. Invalid lines stay,
    with a null map, so no row is lost. Repeated rec_id count once.
    """
    own = ["rec_id", "feed", "file_name", "line_no"]
    one = worked_out(strict_json(records.dropDuplicates(["rec_id"]), own, F.col("raw_line"), nulls=True), own, F.try_variant_get("v", "$", "map<string,variant>"), "as_map", nulls=True)
    value = lambda x: F.struct(
        _kind(x).alias("kind"),
        F.when(_kind(x) == "string", x.cast("string")).alias("as_string"),
        F.when(_kind(x) == "number", F.try_variant_get(x, "$", "double")).alias("as_number"),
        F.when(_kind(x) == "boolean", F.try_variant_get(x, "$", "boolean")).alias("as_boolean"),
        _canonical(x).alias("as_json"),
    )
    names = field_names(records, id_field).groupBy("feed", "file_name").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "name"))).alias("names")
    )
    entry = lambda e: F.struct(F.coalesce(F.col("names")[e["key"]], e["key"]), value(e["value"]))
    return one.join(names, ["feed", "file_name"], "left").select(
        "rec_id", "feed", "file_name", "line_no", F.map_from_entries(F.transform(F.map_entries("as_map"), entry)).alias("fields")
    )
