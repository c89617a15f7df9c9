"""Deeply nested JSON records as flat child tables that keep their parent's key and their ordinal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.variants import is_array, is_object, levels, strict_json, worked_out
from tracewright.session import cut_lineage

#: Keys under which lists of objects lie, and the tag that may enclose a result.
LIST_KEYS = ("subtasks", "files", "hits", "edits", "hunks")
RESULT_TAG = r"(?s)<task_result>(.*?)</task_result>"

#: Levels that are opened in one plan; what lies deeper is opened in further ones.
MOST_LEVELS = 12

KEY = ["record_kind", "record_id", "parent_path", "node_path", "node_kind"]


def decoded(df: DataFrame, keys: list[str], text: Column, tagged: bool = False) -> DataFrame:
    """``keys`` and, as ``open``, the JSON object or list in ``text``, which may be encoded once more as a JSON string; others are left out."""
    if tagged:
        text = F.when(text.contains("<task_result>") & text.rlike(RESULT_TAG), F.regexp_extract(text, RESULT_TAG, 1)).otherwise(text)
    texts = worked_out(df, keys, text, "__t").filter(F.col("__t").rlike(r'^\s*[\[{"]'))
    return strict_json(texts, keys, F.col("__t"), "open", twice=True).filter(is_object(F.col("open")) | is_array(F.col("open")))


def _opener(values: bool) -> Callable[[DataFrame], DataFrame]:
    """A function that opens one level: an object with its fields, or a list (``list_kind`` says under which key) with its positions.

    A node found is emitted twice, once finished (``open`` is a list of one that keeps it in the
    next level) and once to be opened itself. Finished rows pass.
    """
    done = F.col("finished")
    in_list = F.col("list_kind").isNotNull()
    listed = F.col("key").isin(*LIST_KEYS)
    step = lambda at: F.when(F.col("at_path") == "", at.cast("string")).otherwise(F.concat("at_path", F.lit("."), at))
    row = lambda finished, at_path, list_kind, parent, node, kind, value: F.struct(
        finished.alias("finished"), at_path.alias("at_path"), F.col("above").alias("above") if parent is None else parent.alias("above"),
        list_kind.alias("list_kind"), value.alias("open"), node.alias("node_path"), kind.alias("node_kind"),
    )
    none = F.lit(None).cast("string")
    here = F.when(in_list, step(F.col("pos"))).otherwise(step(F.lit(0)))
    kind = F.coalesce("list_kind", "key")
    kept = F.array(row(done, F.col("at_path"), F.col("list_kind"), None, F.col("node_path"), F.col("node_kind"), F.col("open")))
    held = F.to_variant_object(F.array(F.col("value"))) if values else F.parse_json(F.lit("[0]"))
    node = F.array(
        row(F.lit(True), F.col("above"), none, None, here, kind, held),
        row(F.lit(False), here, none, here, none, none, F.col("value")),
    )
    plain = F.array(row(F.lit(False), F.col("at_path"), none, None, none, none, F.col("value")))
    nested = F.array(row(F.lit(False), here, F.col("list_kind"), None, none, none, F.col("value")))
    under = F.array(row(F.lit(False), F.col("at_path"), F.col("key"), None, none, none, F.col("value")))
    out = (
        F.when(done, kept)
        .when((in_list | listed) & F.col("o"), node)
        .when(in_list & F.col("a"), nested)
        .when(~in_list & listed & F.col("a"), under)
        .when(~in_list & ~listed & F.col("o"), plain)
    )
    # The columns are the same for every level, so they are put together once.
    told = [F.col("*"), (~done & is_object(F.col("value"))).alias("o"), (~done & is_array(F.col("value"))).alias("a")]
    exploded, opened = F.explode(out).alias("x"), F.col("open").outer()

    def open_level(rows: DataFrame) -> DataFrame:
        inner = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(opened)).select(*told)
        return inner.select("record_kind", "record_id", exploded).select("record_kind", "record_id", "x.*")

    return open_level


def nested_nodes(events: DataFrame, messages: DataFrame, values: bool = True) -> DataFrame:
    """Every object in a list, of part.state.output of events and of tool_calls of messages.

    Result: record_kind, record_id, parent_path, node_path, node_kind, and with ``values`` value (the
    object, a variant). record_id and parent_path are the surrogate key of the parent, which is the enclosing
    object in a list, the last step of node_path is the ordinal. Repeated records count once. Null or
    invalid JSON gives no node; a null position in a list is counted but is no node. Rows without
    an id are left out.

    A schema is inferred of each record, and their greatest depth taken; then each level is opened
    by one explode that carries parent key and ordinal. Keys that are objects here and lists there
    need no common type, as all values stay variants; :func:`merged_paths` gives the merged schema.
    No Python, and no shuffle but the last one, which drops repeated records.
    """
    outputs = decoded(
        events.filter("event_id is not null and part.state.output is not null").select(
            F.lit("event").alias("record_kind"), F.col("event_id").alias("record_id"), F.lit("").alias("at"), F.col("part.state.output").alias("text")
        ),
        ["record_kind", "record_id", "at"], F.col("text"), tagged=True,
    )
    calls = messages.filter("msg_id is not null and size(tool_calls) > 0").select(F.col("msg_id").alias("record_id"), F.posexplode("tool_calls").alias("at", "c")).filter("c is not null")
    text = F.col("c.function.arguments")
    # Arguments that name no list key, not even escaped, hold no node.
    named = calls.filter(text.rlike("|".join(LIST_KEYS)) | text.contains("\\u"))
    arguments = decoded(named.select(F.lit("message").alias("record_kind"), "record_id", F.col("at").cast("string").alias("at"), text.alias("text")), ["record_kind", "record_id", "at"], F.col("text"))
    known = outputs.unionByName(arguments.filter(is_object(F.col("open"))))
    left = known.agg(F.max(levels(F.col("open")))).first()[0] or 0

    none = F.lit(None).cast("string")
    rows = known.select(
        "record_kind", "record_id", F.lit(False).alias("finished"), F.col("at").alias("at_path"), F.col("at").alias("above"),
        F.when(is_array(F.col("open")), "items").alias("list_kind"), "open", none.alias("node_path"), none.alias("node_kind"),
    )
    found = calls.select(
        F.lit("message").alias("record_kind"), "record_id", F.lit("").alias("parent_path"), F.col("at").cast("string").alias("node_path"), F.lit("tool_calls").alias("node_kind"),
        F.to_variant_object(F.struct("c.id", "c.type", F.col("c.function.name").alias("name"))).alias("value"),
    )
    one = F.try_variant_get("open", "$[0]", "variant")
    open_level = _opener(values)
    while left > 0:
        for _ in range(min(left, MOST_LEVELS)):
            rows = open_level(rows)
        finished = rows.filter("finished").select("record_kind", "record_id", F.col("above").alias("parent_path"), "node_path", "node_kind", one.alias("value"))
        found = found.unionByName(finished)
        left -= MOST_LEVELS
        if left > 0:
            rows = cut_lineage(rows.filter("not finished"))
    return found.dropDuplicates(KEY) if values else found.select(*KEY).distinct()


def merged_paths(found: DataFrame) -> DataFrame:
    """The merged schema: for each node_kind, the fields seen, their types and how often each occurs."""
    return (
        found.select("record_kind", "node_kind", F.explode(F.try_variant_get("value", "$", "map<string,variant>")).alias("field", "v"))
        .groupBy("record_kind", "node_kind", "field")
        .agg(
            F.array_join(F.array_sort(F.collect_set(F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0))), "|").alias("types"),
            F.count("*").alias("n"),
        )
    )


def child_table(found: DataFrame, node_kind: str) -> DataFrame:
    """The flat table of one list key: parent key, own key, ordinal and values (those under a list key lie in tables of their own)."""
    own = F.map_filter(F.try_variant_get("value", "$", "map<string,variant>"), lambda k, v: ~k.isin(*LIST_KEYS))
    return found.filter(F.col("node_kind") == node_kind).select(
        "record_kind",
        "record_id",
        "parent_path",
        "node_path",
        F.regexp_extract("node_path", r"(\d+)$", 1).cast("int").alias("ordinal"),
        F.transform_values(own, lambda k, v: v.cast("string")).alias("fields"),
    )


def token_totals(events: DataFrame) -> DataFrame:
    """Token sums per session: sessionid, n_steps, total, input, output, reasoning, cache_write, cache_read.

    A missing total is the sum of its parts. Events count once, however often they are repeated;
    events without tokens add nothing, and a session without any is left out.
    """
    t = "part.tokens"
    part = lambda name: F.coalesce(F.col(f"{t}.{name}"), F.lit(0)).alias(name.replace(".", "_"))
    own = (
        events.filter(f"{t} is not null")
        .select("event_id", "sessionid", *[part(n) for n in ("input", "output", "reasoning", "cache.write", "cache.read")], F.col(f"{t}.total").alias("given"))
        .dropDuplicates(["event_id"])
    )
    whole = F.coalesce("given", F.expr("input + output + reasoning + cache_write + cache_read"))
    return own.groupBy("sessionid").agg(
        F.count("*").alias("n_steps"),
        F.sum(whole).alias("total"),
        *[F.sum(c).alias(c) for c in ("input", "output", "reasoning", "cache_write", "cache_read")],
    )
