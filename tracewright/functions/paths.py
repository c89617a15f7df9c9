"""Path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_steps(path: Column) -> Column:
    """Forward slashes, no empty, ``.`` or ``..`` steps (a ``..`` at the top is dropped); no leading slash."""
    steps = F.split(F.translate(path, "\\", "/"), "/")
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, step: F.when((step == "") | (step == "."), done)
        .when(step == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(step))),
    )
    return F.array_join(kept, "/")


def relative_to(path: Column, root: str) -> Column:
    """``path`` relative to the absolute folder ``root``, in one spelling.

    Null stays null. A relative path is taken as relative to ``root``. An absolute path outside of
    ``root`` keeps its leading slash. The root itself becomes an empty string.
    """
    root = root.strip("/")
    flat = F.translate(path, "\\", "/")
    # Most paths are clean already; only the others pay for the step-by-step rewrite.
    odd = flat.rlike(r"(^|/)\.{0,2}(/|$)")
    steps = F.when(odd, clean_steps(path)).otherwise(flat)
    absolute = flat.startswith("/")
    inside = steps.startswith(root + "/") | (steps == root)
    under = F.when(steps == root, F.lit("")).otherwise(F.substr(steps, F.lit(len(root) + 2)))
    return F.when(absolute & inside, under).when(absolute, F.concat(F.lit("/"), steps)).otherwise(steps)
