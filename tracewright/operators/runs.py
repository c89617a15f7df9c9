"""Run bookkeeping: outcomes, averages, resuming, identities of configurations."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Outcomes of a case.
OUTCOMES = ("success", "timeout", "provider_error", "invalid_output", "binary_not_found", "error")
#: Fixed value: fields whose difference does not make two runs differ.
IGNORED_FIELDS = ("model_source",)


def latest_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``, which must be total within a key; combined before the shuffle, so a hot key sorts nothing."""
    place = F.struct(*order)
    others = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), place).alias("__last"))
    return last.select(*[F.col(c) if c in keys else F.col("__last")[c].alias(c) for c in rows.columns])


def first_non_empty(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Per key the first value, by ``order``, that is neither null nor blank."""
    return rows.filter(F.trim(value) != "").groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))


def finished_cases(rows: DataFrame, budgets: int) -> DataFrame:
    """Cases that need no new run: present for every budget, and with a success or an unrecorded outcome in any row."""
    return (
        rows.groupBy("explorer", "instance_id")
        .agg(F.countDistinct("top_k").alias("ks"), F.max((F.col("outcome") == "success") | F.col("outcome").isNull()).alias("ok"))
        .filter((F.col("ks") == budgets) & F.col("ok"))
        .select("explorer", "instance_id")
    )


def pending_cases(cases: DataFrame, rows: DataFrame, budgets: int, explorers: Sequence[str]) -> DataFrame:
    """Cases still to run, for each of the given explorers."""
    wanted = cases.withColumn("explorer", F.explode(F.array(*[F.lit(x) for x in explorers])))
    return wanted.join(finished_cases(rows, budgets), ["explorer", "instance_id"], "left_anti")


def outcome_summary(rows: DataFrame, cases: int, keys: Sequence[str] = ("explorer", "top_k")) -> DataFrame:
    """Per run: rows by outcome (unrecorded for null), attempted, not_attempted, completion of all cases (null without cases)."""
    counts = [F.count_if(F.coalesce("outcome", F.lit("unrecorded")) == o).alias(f"n_{o}") for o in (*OUTCOMES, "unrecorded")]
    summed = rows.groupBy(*keys).agg(*counts, F.count("*").alias("attempted"))
    return summed.withColumn("not_attempted", F.greatest(F.lit(cases) - F.col("attempted"), F.lit(0))).withColumn(
        "completion", F.try_divide(F.col("n_success"), F.lit(cases))
    )


def run_averages(rows: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("explorer", "top_k")) -> DataFrame:
    """Mean of each metric over attempted rows; a missing value counts as 0."""
    return rows.groupBy(*keys).agg(*[F.avg(F.coalesce(m, F.lit(0.0))).alias(m) for m in metrics])


def usage_once(rows: DataFrame, tokens: str, keys: Sequence[str] = ("explorer",)) -> DataFrame:
    """Token usage of each case once, from the least budget; cases without usage are not counted."""
    least = rows.groupBy(*keys).agg(F.min("top_k").alias("top_k"))
    one = rows.join(least, [*keys, "top_k"])
    return one.groupBy(*keys).agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"), F.count_if(F.col(tokens) > 0).alias("cases"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fields that differ between two manifests (explorer, field, value): a null or missing side is unknown, not different."""
    both = old.withColumnRenamed("value", "old_value").join(new.withColumnRenamed("value", "new_value"), ["explorer", "field"], "full_outer")
    return both.filter(~F.col("field").isin(*IGNORED_FIELDS) & F.col("old_value").isNotNull() & F.col("new_value").isNotNull() & (F.col("old_value") != F.col("new_value")))


def outcome_of(return_code: str = "return_code", timed_out: str = "timed_out", has_errors: str = "has_errors", has_answer: str = "has_answer"):
    """Outcome of a finished process, as a column."""
    return (
        F.when(F.col(timed_out), "timeout")
        .when(F.col(return_code) == 127, "binary_not_found")
        .when(F.col(has_errors) & ~F.col(has_answer), "provider_error")
        .when((F.col(return_code) != 0) & ~F.col(has_answer), "error")
        .when(~F.col(has_answer), "invalid_output")
        .otherwise("success")
    )


# How names of settings that hold secrets end, how those of mere numbers begin (letters only), and maps of which only the names are kept.
SECRET_ENDINGS = (
    "key", "keys", "keyid", "secret", "secrets", "password", "passwords", "passwd", "passphrase", "passphrases", "token", "tokens", "credential", "credentials",
    "cookie", "cookies", "authorization",
)
SECRET_NAMES = ("auth",)
NUMBER_BEGINNINGS = ("max", "min", "num", "total", "count", "limit")
OPAQUE_MAPS = ("environment", "env", "headers")
HIDDEN = "<redacted>"

_NUMBER_NAME = re.compile("|".join(NUMBER_BEGINNINGS))
_SECRET_NAME = re.compile(f".*(?:{'|'.join(SECRET_ENDINGS)})|(?:{'|'.join(SECRET_NAMES)})")


def secret_key(name: str) -> bool:
    """Whether a setting's name, letters only, is or ends like a secret's; names of numbers (max_tokens) are not."""
    letters = re.sub("[^a-z]", "", name.lower())
    return _SECRET_NAME.fullmatch(letters) is not None and _NUMBER_NAME.match(letters) is None


def secret_name(name: Column) -> Column:
    """:func:`secret_key` of a column; null is no secret."""
    letters = F.regexp_replace(F.lower(name), "[^a-z]", "")
    return F.coalesce(letters.rlike(f"^(?:{_SECRET_NAME.pattern})$") & ~letters.rlike(f"^(?:{_NUMBER_NAME.pattern})"), F.lit(False))


def redact(value: object) -> object:
    """A configuration with every text under a secret name replaced, however deep below it; a name of its own below it counts instead.

    Maps of variables and headers keep their names only. Numbers are settings, not secrets.
    """
    work: list[tuple[object, object, str]] = []

    def copied(at: object, above: str) -> object:
        """A container is copied now and filled later, so depth costs no stack."""
        if isinstance(at, dict):
            return dict.fromkeys(sorted(at), HIDDEN) if above.lower() in OPAQUE_MAPS else later({}, at, above)
        if isinstance(at, list):
            return later([None] * len(at), at, above)
        return HIDDEN if isinstance(at, str) and secret_key(above) else at

    def later(copy: object, at: object, above: str) -> object:
        work.append((copy, at, above))
        return copy

    out = copied(value, "")
    while work:
        copy, at, above = work.pop()
        for name, inner in at.items() if isinstance(at, dict) else enumerate(at):
            own = isinstance(name, str) and (secret_key(name) or name.lower() in OPAQUE_MAPS)
            copy[name] = copied(inner, name if own else above)
    return out


def identity(value: object) -> str:
    """SHA-256 of a value's JSON with sorted keys and no blanks."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
