"""Texts packed into containers of fixed capacity: large-item matching, best fit of the rest."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.ordering import running_totals

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenizing pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Containers for ``counts`` items of each size, as runs: (size, first_rank, last_rank, first_container, per_container).

    Items of a size are numbered from 0; the run puts ``per_container`` of them into each of the
    consecutive containers from first_container on. Returns the runs and the number of containers.

    Works on sizes with their counts, so its cost follows the capacity, not the number of items.
    Items above a third of the capacity come first: at most two of them share a container. Each
    largest one is matched with the largest partner that fits. Smaller items then go, largest
    first, into the smallest gap that holds them, and open a container only if no gap does.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first container, how many)
    open_gaps: list[int] = []
    containers = 0

    def give(size: int, first: int, n: int, each: int) -> None:
        runs.append((size, used[size], used[size] + n * each - 1, first, each))
        used[size] += n * each
        left[size] -= n * each

    def keep(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(open_gaps, gap)
            gaps[gap].append((first, n))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        at = bisect.bisect_right(large, capacity - size) - 1
        partner = large[at] if at >= 0 else None
        if partner is None:
            n = left[size]
            give(size, containers, n, 1)
            keep(capacity - size, containers, n)
        elif partner == size:
            n = left[size] // 2
            if n:
                give(size, containers, n, 2)
                keep(capacity - 2 * size, containers, n)
                containers += n
            n = left[size]
            if n and at > 0:  # one is left over; it may take the next smaller partner
                partner = large[at - 1]
                give(size, containers, 1, 1)
                give(partner, containers, 1, 1)
                keep(capacity - size - partner, containers, 1)
                if not left[partner]:
                    large.remove(partner)
                n = 1
            elif n:
                give(size, containers, n, 1)
                keep(capacity - size, containers, n)
        else:
            n = min(left[size], left[partner])
            give(size, containers, n, 1)
            give(partner, containers, n, 1)
            keep(capacity - size - partner, containers, n)
            if not left[partner]:
                large.remove(partner)
        containers += n
        if not left[size]:
            large.remove(size)

    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect.bisect_left(open_gaps, size)
            if at == len(open_gaps):
                each = min(capacity // size, left[size])
                n = left[size] // each
                give(size, containers, n, each)
                keep(capacity - each * size, containers, n)
                containers += n
                continue
            gap = open_gaps[at]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.pop(at)
            each = min(gap // size, left[size])
            full = min(n, left[size] // each)
            give(size, first, full, each)
            keep(gap - each * size, first, full)
            keep(gap, first + full, n - full)
    return runs, containers


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and n_tokens of all non-blank texts, each doc_id once. Texts that are not blank have at least one token.

    The vocabulary, a file of about a megabyte, is read where the job is started and sent to the executors.
    """
    vocabulary = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.value.splitlines())}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(encode(t)) for t in batch["text"]]})

    texts = documents.filter(F.col("doc_id").isNotNull() & F.col("text").rlike(r"(?U)\S")).select("doc_id", "text")
    return texts.mapInPandas(run, "doc_id bigint, n_tokens bigint").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))


def pack(sized: DataFrame, capacity: int = 2048, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Containers for all items: key, piece_no, first_token, n_tokens, container_id.

    Only an item above the capacity is split: into full containers of its own and a rest that is
    packed like any other item. Sizes below 1 are left out. The items themselves never leave the
    executors: the driver sees one count per size, at most ``capacity`` of them, and its plan is
    joined back by size and by the item's number within its size.
    """
    # An item of q full containers and a rest becomes q + 1 pieces, or q if there is no rest.
    n = F.col("__n")
    last = F.ceil(n / capacity)
    parts = (
        sized.filter(f"{size} > 0")
        .select(F.col(key), F.col(size).cast("bigint").alias("__n"))
        .select(key, "__n", F.explode(F.sequence(F.lit(1).cast("bigint"), last)).alias("p"))
        .select(
            key,
            F.col("p").cast("int").alias("piece_no"),
            ((F.col("p") - 1) * capacity).alias("first_token"),
            F.least(F.lit(capacity).cast("bigint"), n - (F.col("p") - 1) * capacity).alias("n"),
        )
    )
    ranked = running_totals(parts, ["n"], [key, "piece_no"], {"rank": F.lit(1)})
    counts = {r["n"]: r["c"] for r in ranked.groupBy("n").agg(F.count("*").alias("c")).collect()}
    runs, _ = plan(counts, capacity)
    spark = sized.sparkSession
    table = spark.createDataFrame(runs, "n bigint, lo bigint, hi bigint, first bigint, each bigint")
    place = F.broadcast(table) if len(runs) <= 64 * capacity else table
    number = F.col("rank") - 1
    return ranked.join(place, (ranked["n"] == table["n"]) & number.between(table["lo"], table["hi"])).select(
        key,
        "piece_no",
        "first_token",
        ranked["n"].alias("n_tokens"),
        (F.col("first") + F.floor((number - F.col("lo")) / F.col("each"))).alias("container_id"),
    )
