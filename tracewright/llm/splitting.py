"""Oversized items cut at natural boundaries, by pointer doubling over successor tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_SCHEMA = "{key} bigint, piece_no int, start_char bigint, end_char bigint, first_line int, last_line int, cut_kind string, piece string"


def cut_table(line_ends: np.ndarray, n: int, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places where a piece may end, where the next piece then starts, and whether it is a line's end.

    ``line_ends`` are the offsets behind each newline of a text of ``n`` characters. Places are 0
    (before the text), every line end, and for each line that fits in no piece a chain of cuts
    inside it. A chain starts at the one place from which such a line can be entered, its own
    start, so the table stays as long as the text has lines plus pieces.
    """
    ends = np.unique(np.append(line_ends[(line_ends > 0) & (line_ends < n)], n))
    starts = np.concatenate(([0], ends[:-1]))
    # The next piece starts at the first line start within the overlap, else exactly `overlap` before.
    at = np.searchsorted(starts, ends - overlap, side="left")
    begin = np.where((at < len(starts)) & (starts[np.minimum(at, len(starts) - 1)] < ends), starts[np.minimum(at, len(starts) - 1)], ends - overlap)
    begin = np.maximum(begin, np.maximum(ends - overlap, 0))
    # A line that would fit but for the overlap gets a shorter overlap.
    following = np.append(ends[1:], n)
    begin = np.where((following - begin > size) & (following - ends <= size), following - size, begin)
    places, resume, whole = [np.array([0]), ends], [np.array([0]), begin], [np.array([True]), np.ones(len(ends), bool)]
    for i in np.flatnonzero(ends - starts > size):
        entry = 0 if i == 0 else begin[i - 1]
        # First cut inside, then every size - overlap; those that leave a rest within reach end the chain.
        chain = np.arange(entry + size, ends[i], size - overlap)
        places.append(chain), resume.append(chain - overlap), whole.append(np.zeros(len(chain), bool))
    place, back, line = np.concatenate(places), np.concatenate(resume), np.concatenate(whole)
    first = np.argsort(place, kind="stable")
    place, back, line = place[first], back[first], line[first]
    return place, back, line


def successors(place: np.ndarray, back: np.ndarray, line: np.ndarray, size: int) -> np.ndarray:
    """Index of the farthest legal end of the piece that follows each place; the last place follows itself.

    A line's end is taken wherever one is in reach; else the one cut inside the line that the chain allows.
    """
    ids = np.arange(len(place))
    natural = np.maximum.accumulate(np.where(line, ids, 0))
    reach = np.searchsorted(place, back + size, side="right") - 1
    best = natural[reach]
    return np.where(best > ids, best, np.minimum(np.maximum(reach, ids), len(place) - 1))


def reached(succ: np.ndarray) -> np.ndarray:
    """All places on the greedy path from place 0, found by squaring the successor table.

    After k squarings a table jumps 2**k pieces, and marking what the known places jump to doubles
    the number of known places, so the path is found in log2(pieces) array operations.
    """
    known = np.array([0])
    jump = succ
    last = len(succ) - 1
    while True:
        grown = np.unique(np.append(known, jump[known]))
        if known[-1] == last and len(grown) == len(known):
            return known[1:]
        known, jump = grown, jump[jump]


def pieces(text: str, size: int = 6000, overlap: int = 200) -> list[tuple[int, int, int, int, str]]:
    """(start, end, first_line, last_line, cut_kind) of each piece of at most ``size`` characters.

    A line of exactly ``size`` characters may end before its newline. A text that fits is one piece;
    an empty text has none. Offsets count code points, lines count from 1.
    """
    n = len(text)
    if n == 0:
        return []
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    newline = np.flatnonzero(raw == 10)
    if n <= size:
        return [(0, n, 1, int(np.count_nonzero(newline < n - 1)) + 1, "line")]
    bounds = newline + 1
    lengths = np.diff(np.concatenate(([0], bounds)))
    bounds = np.append(bounds, newline[lengths == size + 1])
    place, back, line = cut_table(bounds, n, size, overlap)
    path = reached(successors(place, back, line, size))
    ends = place[path]
    starts = np.concatenate(([0], back[path][:-1]))
    first = np.searchsorted(newline, starts, side="left") + 1
    last = np.searchsorted(newline, ends - 1, side="left") + 1
    return [
        (int(s), int(e), int(a), int(b), "line" if w else "inside")
        for s, e, a, b, w in zip(starts, ends, first, last, line[path])
    ]


def split_oversized(items: DataFrame, key: str = "chunk_id", text: str = "content", size: int = 6000, overlap: int = 200) -> DataFrame:
    """Pieces of every item of more than ``size`` characters, each starting with the end of the one before.

    Result: key, piece_no (from 1), start_char, end_char (offsets, end exclusive), first_line,
    last_line (within the item), cut_kind (``line`` if the piece ends at a line's or the text's end,
    else ``inside``), piece. Null texts, null keys and texts that fit are not in the result; an item counts
    once however often its row is repeated; the length filter runs before anything is shuffled.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, whole in zip(batch[key], batch[text]):
                cuts = pieces(whole, size, overlap)
                # Some pieces at a time: a very long text is never held twice as a frame.
                for i in range(0, len(cuts), 1000):
                    part = cuts[i : i + 1000]
                    yield pd.DataFrame(
                        [(k, i + j + 1, s, e, a, b, kind, whole[s:e]) for j, (s, e, a, b, kind) in enumerate(part)],
                        columns=[key, "piece_no", "start_char", "end_char", "first_line", "last_line", "cut_kind", "piece"],
                    )

    large = items.select(key, text).filter(F.col(key).isNotNull() & (F.length(text) > size)).dropDuplicates([key])
    return large.mapInPandas(run, PIECE_SCHEMA.format(key=key))


def cut_kinds(items: DataFrame, key: str = "chunk_id", text: str = "content", size: int = 6000, overlap: int = 200) -> DataFrame:
    """Per oversized item: ``inside`` if any of its pieces had to end inside a line, else ``line``."""
    return (
        split_oversized(items, key, text, size, overlap)
        .groupBy(key)
        .agg(F.when(F.max((F.col("cut_kind") == "inside").cast("int")) == 1, "inside").otherwise("line").alias("cut_kind"))
    )
