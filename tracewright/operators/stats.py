"""Statistics of logs, tokens, commands and patches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.variants import is_array, is_object, levels, strict_json, worked_out
from tracewright.operators.ordering import running_totals

# Bounds of length classes; commands by what they do.
LENGTH_BOUNDS = (1, 5, 10, 20, 50, 100, 200, 500, 1000)
READ_COMMANDS = "cat nl ls grep head tail find which whereis type file stat readlink dirname basename pwd echo printenv env export cd pushd popd".split()
EXECUTE_COMMANDS = (
    "curl wget python python3 pip pip3 npm node ping make cmake gcc g++ javac java go rustc cargo docker kubectl git svn hg bash sh zsh perl "
    "ruby php dotnet mvn gradle yarn npx tsc eslint pytest unittest nosetests tox"
).split()
EDIT_COMMANDS = "sed vim nano vi emacs ed".split()
CLASS_ORDER = ("edit", "execute", "read", "other")
CHARS_PER_TOKEN, INPUT_PRICE, OUTPUT_PRICE, REPLY_CHARS = 2.5, 3.0, 15.0, 50


def length_class(n: Column) -> Column:
    out = F.when(n <= 0, "0")
    for b in LENGTH_BOUNDS:
        out = out.when(n <= b, f"≤{b}")
    return out.otherwise(f">{LENGTH_BOUNDS[-1]}")


def simple_command_class(command: Column) -> Column:
    c = F.lower(F.trim(command))
    first = F.regexp_extract(c, r"^(\S+)", 1)
    return (
        F.when(first == "", "other")
        .when(first.isin(*EDIT_COMMANDS), "edit")
        .when(c.contains("sed") & c.contains("-i"), "edit")
        .when((first == "find") & c.contains("-exec"), "execute")
        .when(first.isin(*READ_COMMANDS), "read")
        .when(first.isin(*EXECUTE_COMMANDS), "execute")
        .otherwise("other")
    )


def command_class(command: Column) -> Column:
    """Class of a command line: its parts between && and | are classed, the first in edit, execute, read, other wins."""
    parts = F.filter(F.transform(F.split(command, r"&&|\|"), lambda x: F.trim(x)), lambda x: x != "")
    rank = F.transform(parts, lambda x: F.array_position(F.array(*[F.lit(c) for c in CLASS_ORDER]), simple_command_class(x)))
    return F.coalesce(F.get(F.array(*[F.lit(c) for c in CLASS_ORDER]), (F.array_min(rank) - 1).cast("int")), F.lit("other"))


def token_contribution(commands: DataFrame, key: str, order: Sequence[str], tokens: str, command: str) -> DataFrame:
    """Per class: tokens, and tokens weighted by the number of steps that still carry them (n - i), with their shares."""
    w = Window.partitionBy(key)
    weighted = commands.withColumn("i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count("*").over(w))
    sums = weighted.groupBy(command_class(F.col(command)).alias("class")).agg(
        F.count("*").alias("n_commands"), F.sum(tokens).alias("tokens"), F.sum(F.col(tokens) * (F.col("n") - F.col("i"))).alias("carried")
    )
    everything = Window.partitionBy(F.lit(0))  # four rows
    return sums.withColumn("token_share", F.col("tokens") / F.sum("tokens").over(everything)).withColumn("carried_share", F.col("carried") / F.sum("carried").over(everything))


def upper_order_statistic(value: str, keys: Sequence[str], df: DataFrame, marks: dict[str, Column]) -> DataFrame:
    """Values at positions of the sorted column, per key, by rank: no list of values is gathered.

    ``marks`` maps a name to a 0-based position as a column over n, the number of values.
    """
    ranked = running_totals(df.filter(F.col(value).isNotNull()).select(*keys, value), list(keys), [value], {"__n": F.lit(1)}).withColumn("__i", F.col("__n") - 1)
    sizes = df.groupBy(*keys).agg(F.count(value).alias("n"))
    joined = ranked.join(sizes, list(keys))
    return joined.groupBy(*keys).agg(*[F.max(F.when(F.col("__i") == p, F.col(value))).alias(name) for name, p in marks.items()])


def distribution(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, mean, upper median sorted[n // 2], p95 sorted[min(int(0.95 n), n - 1)], min, max."""
    n = F.col("n")
    marks = {"median": F.floor(n / 2), "p95": F.least(F.floor(n * 0.95), n - 1)}
    base = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return base.join(upper_order_statistic(value, keys, df, marks), list(keys))


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between the least and the greatest value of each key: bin from 0, count."""
    span = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return df.join(span, list(keys)).filter(F.col(value).isNotNull()).groupBy(*keys, place.cast("int").alias("bin")).agg(F.count("*").alias("count"))


def compare_groups(df: DataFrame, label: str, base: str, values: Sequence[str]) -> DataFrame:
    """Mean of each value per group and its difference to the base group in percent (0 if the base is not above 0)."""
    means = df.groupBy(label).agg(*[F.avg(v).alias(v) for v in values])
    long = means.select(label, F.explode(F.array(*[F.struct(F.lit(v).alias("stat"), F.col(v).alias("mean")) for v in values])).alias("x")).select(label, "x.*")
    reference = long.filter(F.col(label) == base).select("stat", F.col("mean").alias("base"))
    diff = F.when(F.col("base") > 0, (F.col("mean") - F.col("base")) / F.col("base") * 100).otherwise(0.0)
    return long.join(F.broadcast(reference), "stat").select(label, "stat", "mean", diff.alias("diff_pct"))


def count_of_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))


def cost(calls: DataFrame, chars: str) -> DataFrame:
    """Tokens and price of planned calls: prompt characters by characters per token, a guessed reply for each call."""
    tokens_in, tokens_out = F.sum(chars) / CHARS_PER_TOKEN, F.count("*") * REPLY_CHARS / CHARS_PER_TOKEN
    return calls.agg(
        F.count("*").alias("calls"), tokens_in.alias("input_tokens"), tokens_out.alias("output_tokens"),
        (tokens_in * INPUT_PRICE / 1e6 + tokens_out * OUTPUT_PRICE / 1e6).alias("price"),
    )


def verdicts(wanted: DataFrame, statuses: DataFrame) -> DataFrame:
    """resolved per instance: every wanted test PASSED; a test without status is MISSING. wanted: instance_id, test (null for none)."""
    joined = wanted.join(statuses, ["instance_id", "test"], "left")
    good = F.col("test").isNull() | (F.coalesce("status", F.lit("MISSING")) == "PASSED")
    return joined.groupBy("instance_id").agg(F.min(good).alias("resolved"))


def mode_analysis(results: DataFrame, baseline: str = "core_optional") -> DataFrame:
    """Per mode: n, resolved, pass_rate, sufficiency against the baseline mode (else the best), ids lost and won against it."""
    per = results.groupBy("mode").agg(F.count("*").alias("n"), F.count_if("resolved").alias("resolved"))
    per = per.withColumn("pass_rate", F.try_divide("resolved", "n"))
    reference = per.agg(F.coalesce(F.max(F.when(F.col("mode") == baseline, F.col("pass_rate"))), F.max("pass_rate")).alias("base"))
    base = results.filter(F.col("mode") == baseline).select("instance_id", F.col("resolved").alias("base_ok"))
    moves = results.join(base, "instance_id").groupBy("mode").agg(
        F.count_if(F.expr("base_ok and not resolved")).alias("degraded"), F.count_if(F.expr("resolved and not base_ok")).alias("improved"),
        F.count_if(F.expr("not resolved and not base_ok")).alias("both_fail"),
    )
    return per.crossJoin(F.broadcast(reference)).join(moves, "mode", "left").select(
        "mode", "n", "resolved", "pass_rate", F.try_divide("pass_rate", "base").alias("sufficiency"), "degraded", "improved", "both_fail"
    )


def route_source(ids: DataFrame, sources: Sequence[tuple[str, DataFrame]], key: str = "instance_id") -> DataFrame:
    """The first source, in order, that holds an id; else unknown."""
    out, label = ids, F.lit("unknown")
    for i, (_, df) in enumerate(sources):
        out = out.join(df.select(key).distinct().withColumn(f"__s{i}", F.lit(True)), key, "left")
    for i, (name, _) in reversed(list(enumerate(sources))):
        label = F.when(F.col(f"__s{i}"), name).otherwise(label)
    return out.withColumn("source", label).drop(*[f"__s{i}" for i in range(len(sources))])


def find_key(value: object, name: str) -> object | None:
    """The value under the first key ``name``: keys of a level before what lies below it, depth first."""
    work = [value]
    while work:
        at = work.pop()
        if isinstance(at, dict):
            if name in at:
                return at[name]
            work += reversed(list(at.values()))
        elif isinstance(at, list):
            work += reversed(at)
    return None


# Names of token counts, lower case, letters only.
INPUT_NAMES = {"inputtokens", "prompttokens", "input", "prompttokencount"}
INPUT_WITH_CACHE = {"prompttokens", "prompttokencount"}
OUTPUT_NAMES = {"outputtokens", "completiontokens", "output"}
OUTPUT_APART = {"candidatestokencount"}
CACHE_READ_NAMES = {"cachereadinputtokens", "cachereadtokens", "cacheread", "cachedtokens", "cachedinputtokens", "cachedcontenttokencount"}
CACHE_WRITE_NAMES = {"cachecreationinputtokens", "cachecreationtokens", "cachewritetokens", "cachewrite"}
REASONING_NAMES = {"reasoningtokens", "reasoning", "thoughtstokencount", "thoughts"}
#: Fixed value: objects nested deeper than this below the usage are not looked at.
USAGE_DEPTH = 12

_MAP = "map<string,variant>"
_KINDS = ("input", "output", "cache_read", "cache_write", "reasoning")


def _letters(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z]", "")


def _whole(value: Column) -> Column:
    """A JSON number without its fraction; null for anything else."""
    kind = F.schema_of_variant(value)
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(value, "$", "double").cast("bigint"))


def _inner(value: Column) -> Column:
    """Objects and lists right inside an object or list; the object ``cache`` of an object counts as part of it."""
    holds = lambda x: is_object(x) | is_array(x)
    fields = F.filter(F.map_entries(F.try_variant_get(value, "$", _MAP)), lambda e: holds(e["value"]) & ~((_letters(e["key"]) == "cache") & is_object(e["value"])))
    items = F.filter(F.try_variant_get(value, "$", "array<variant>"), holds)
    return F.coalesce(items, F.transform(fields, lambda e: e["value"]), F.array().cast("array<variant>"))


def _counts(value: Column) -> Column:
    """Counts of one object: (kind, amount, holds the cached part, has reasoning apart)."""
    entries = F.map_entries(F.try_variant_get(value, "$", _MAP))
    named = F.transform(entries, lambda e: F.struct(_letters(e["key"]).alias("name"), _whole(e["value"]).alias("amount"), e["value"].alias("value")))
    numbers = F.filter(named, lambda e: e["amount"].isNotNull())
    details = F.exists(named, lambda e: e["name"] == "inputtokensdetails")
    beside = F.exists(numbers, lambda e: e["name"].isin(*REASONING_NAMES))
    sides = (("input", INPUT_NAMES), ("output", OUTPUT_NAMES | OUTPUT_APART), ("cache_read", CACHE_READ_NAMES), ("cache_write", CACHE_WRITE_NAMES), ("reasoning", REASONING_NAMES))

    def kind(name: Column) -> Column:
        found = F.lit(None).cast("string")
        for label, names in sides:
            found = F.when(name.isin(*names), label).otherwise(found)
        return found

    plain = F.transform(
        numbers,
        lambda e: F.struct(
            kind(e["name"]).alias("kind"), e["amount"].alias("amount"),
            (kind(e["name"]) == "input").__and__(e["name"].isin(*INPUT_WITH_CACHE) | details).alias("cached"),
            (kind(e["name"]) == "output").__and__(e["name"].isin(*OUTPUT_APART) | beside).alias("apart"),
        ),
    )
    nested = F.filter(named, lambda e: (e["name"] == "cache") & is_object(e["value"]))
    part = lambda label, key: F.transform(
        nested,
        lambda e: F.struct(F.lit(label).alias("kind"), _whole(F.try_variant_get(e["value"], f"$.{key}", "variant")).alias("amount"), F.lit(False).alias("cached"), F.lit(False).alias("apart")),
    )
    both = F.filter(F.concat(plain, part("cache_read", "read"), part("cache_write", "write")), lambda x: x["kind"].isNotNull() & x["amount"].isNotNull())
    return F.coalesce(both, F.array().cast("array<struct<kind:string,amount:bigint,cached:boolean,apart:boolean>>"))


def token_usage(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """Token counts of each JSON text of any provider: keys, input (without cached reads), output, cache_read, cache_write, reasoning, total.

    Counts are summed wherever they lie, by the names above. Prompt counts that hold the cached part
    lose it once; reasoning that stands beside the output, not inside it, adds to the total. A text
    that is no JSON counts nothing. Objects are gathered level by level within their row, as deep as
    the deepest text, so nothing is shuffled.
    """
    keys = list(keys)
    parsed = strict_json(df, keys, F.col(text), nulls=True)
    deep = parsed.agg(F.max(levels(F.col("v")))).first()[0] or 0
    at = parsed.select(*keys, F.array(F.array_compact(F.array("v"))).alias("all"))
    for _ in range(min(deep - 1, USAGE_DEPTH)):
        at = worked_out(at, keys, F.concat("all", F.array(F.flatten(F.transform(F.element_at("all", -1), _inner)))), "all")
    counted = worked_out(at, keys, F.flatten(F.transform(F.flatten("all"), _counts)), "counts")
    total = lambda k: F.aggregate(F.filter("counts", lambda x: x["kind"] == k), F.lit(0).cast("bigint"), lambda a, x: a + x["amount"]).alias(k)
    any_of = lambda name: F.exists("counts", lambda x: x[name])
    sums = counted.select(*keys, *[total(k) for k in _KINDS], any_of("cached").alias("with_cache"), any_of("apart").alias("apart"))
    own = F.when(F.col("with_cache"), F.greatest(F.lit(0), F.col("input") - F.col("cache_read"))).otherwise(F.col("input"))
    more = F.when(F.col("apart"), F.col("reasoning")).otherwise(0)
    return sums.select(*keys, own.alias("input"), "output", "cache_read", "cache_write", "reasoning", (own + F.col("output") + more).alias("total"))


def usage_totals(df: DataFrame, keys: Sequence[str], text: str, subagent: str | None = None) -> DataFrame:
    """Token sums per key from JSON texts of any provider. With ``subagent``, a boolean column, also the part of each sum that
    subagents used (``sub_`` before its name): a slice of the sum, not an addition to it."""
    names = [*_KINDS, "total"]
    more = [subagent] if subagent else []
    used = token_usage(df, [*keys, *more], text)
    slices = [F.sum(F.when(F.col(subagent), F.col(n)).otherwise(0)).alias(f"sub_{n}") for n in names] if subagent else []
    return used.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names], *slices)


def file_reading(reads: DataFrame, edits: DataFrame) -> DataFrame:
    """One row about files that were read (path, n_lines per read) and edited (path): n_read, n_edited, n_read_only, their shares in percent, mean lines per read file.

    Lines of a file are summed over all reads of it, null counts as none. Without any read file all are 0.
    """
    per_file = reads.groupBy("path").agg(F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines"))
    marked = per_file.join(edits.select("path").distinct().withColumn("edited", F.lit(True)), "path", "left")
    n, edited = F.count("*"), F.count("edited")
    share = lambda x: F.coalesce(F.try_divide(x * 100, n), F.lit(0.0))
    return marked.agg(
        n.alias("n_read"), edited.alias("n_edited"), (n - edited).alias("n_read_only"), share(edited).alias("edit_pct"), share(n - edited).alias("read_only_pct"),
        F.coalesce(F.avg("n_lines"), F.lit(0.0)).alias("mean_lines"),
    )


def resolve_states(results: DataFrame) -> DataFrame:
    """State of each result (instance_id, resolved, error): resolved, error (also beside resolved), unresolved; one row per state it is in."""
    failed = F.coalesce("error", F.lit("")) != ""
    states = F.array_compact(F.array(F.when(F.col("resolved"), "resolved"), F.when(failed, "error"), F.when(~F.col("resolved") & ~failed, "unresolved")))
    return results.select("instance_id", F.explode(states).alias("state"))


def resolve_summary(results: DataFrame) -> DataFrame:
    """total, resolved, unresolved, errors and resolve_rate (0 without results)."""
    failed = F.coalesce("error", F.lit("")) != ""
    return results.agg(
        F.count("*").alias("total"), F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved") & ~failed).alias("unresolved"), F.count_if(failed).alias("errors"),
        F.coalesce(F.try_divide(F.count_if("resolved"), F.count("*")), F.lit(0.0)).alias("resolve_rate"),
    )
