"""Evaluation texts in a corpus: CGK embedding of word windows, bit-sampling LSH, exact verification."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word is a run of letters and digits; the underscore is neither.
WORD = re.compile(r"[^\W_]+")
#: Bytes of keys that go to the executors at once; more items make more passes over the documents.
BLOCK_BYTES = 128_000_000
#: Repetitions at most; where the wanted recall needs more, the one that is reached is told.
MOST_REPEATS = 64
#: Pairs of windows that are verified at once.
VERIFIED = 200_000
#: Coordinates of the embedding in one LSH key.
SAMPLED = 8
#: Pairs drawn to measure how often a key survives the allowed edits.
TRIALS = 4000


def words(text: str) -> list[str]:
    return WORD.findall(text.casefold())


def edit_distances(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Edit distance of each row of ``a`` to the same row of ``b``, all of one length, or more than ``most``: one table for all rows, of its diagonals within ``most`` only."""
    n = a.shape[1]
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    far = np.full(a.shape[1], most + 1, np.int16)
    row = [np.full(a.shape[1], j, np.int16) if j <= most else far for j in range(n + 1)]
    for i in range(1, n + 1):
        new = [far] * (n + 1)
        if i <= most:
            new[0] = np.full(a.shape[1], i, np.int16)
        for j in range(max(1, i - most), min(n, i + most) + 1):
            new[j] = np.minimum(np.minimum(row[j], new[j - 1]) + np.int16(1), row[j - 1] + (a[i - 1] != b[j - 1]))
        row = new
    return row[n]


@dataclass
class Index:
    """Items of one block: vocabulary, word ids of all items, and per repetition the sorted keys of their windows."""

    vocabulary: dict[str, int]
    ids: np.ndarray
    item_of: np.ndarray
    starts: np.ndarray
    width: int
    edits: int
    coins: np.ndarray  # repetition x 64-bit step block x word
    picks: np.ndarray  # repetition x SAMPLED
    mixers: np.ndarray  # SAMPLED odd multipliers
    keys: list[np.ndarray]
    order: list[np.ndarray]
    expected: float  # recall of windows at the allowed edits
    pieces: np.ndarray  # hashes of the items' runs of width // (edits + 1) words
    may: np.ndarray  # a bit for each value of a piece's first bits


def embed_keys(ids: np.ndarray, starts: np.ndarray, width: int, coins: np.ndarray, picks: np.ndarray, mixers: np.ndarray) -> np.ndarray:
    """LSH keys of the windows at ``starts``.

    CGK walk: step j writes the current word and moves on if the coin of (j, word) says so. Windows
    within a small edit distance fall into step again after each edit, so their walks differ in few
    places. Only the sampled places enter the key, mixed by odd multipliers.
    """
    at = np.zeros(len(starts), np.int64)
    key = np.zeros(len(starts), np.uint64)
    wanted = {int(p): m for p, m in zip(picks, mixers)}
    for j in range(int(picks.max()) + 1):
        inside = at < width
        word = np.where(inside, ids[starts + np.minimum(at, width - 1)], 0)
        if j in wanted:
            key += (word.astype(np.uint64) + np.uint64(1)) * wanted[j]
            key ^= key >> np.uint64(29)
        at += (coins[j // 64][word] >> np.uint64(j % 64) & np.uint64(1)).astype(np.int64) * inside
    return key


def _piece_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` words."""
    h = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for j in range(n):
        h = (h ^ ids[j : j + len(h)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def _may_match(ids: np.ndarray, starts: np.ndarray, index: Index) -> np.ndarray:
    """Windows that hold a run of words of some item: ``edits`` edits leave one of edits + 1 equal pieces whole, so no match is lost."""
    n = index.width // (index.edits + 1)
    h = _piece_hashes(ids, n)
    held = np.flatnonzero(index.may[(h >> np.uint64(44)).astype(np.int64)])
    at = np.minimum(np.searchsorted(index.pieces, h[held]), len(index.pieces) - 1)
    told = np.zeros(len(h) + 1, np.int64)
    told[held[index.pieces[at] == h[held]] + 1] = 1
    told = np.cumsum(told)
    return told[starts + index.width - n + 1] > told[starts]


def build_index(items: list[tuple[int, str]], width: int, edits: int, recall: float, seed: int = 7, most_repeats: int = MOST_REPEATS) -> Index:
    vocabulary: dict[str, int] = {}
    ids, item_of, starts, base = [], [], [], 0
    for item, text in items:
        own = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)]
        ids += own
        starts += range(base, base + len(own) - width + 1)
        item_of += [item] * max(0, len(own) - width + 1)
        base += len(own)
    random = np.random.default_rng(seed)
    ids_a, starts_a = np.array(ids, np.int64), np.array(starts, np.int64)
    steps = 3 * width
    blocks = -(-steps // 64)
    draw = lambda: (
        random.integers(0, 2**64, (blocks, len(vocabulary) + 2), np.uint64),
        np.sort(random.choice(steps, min(SAMPLED, steps), replace=False)),
    )
    mixers = random.integers(0, 2**64, SAMPLED, np.uint64) | np.uint64(1)
    coins, picks = zip(*[draw()])
    expected = 1.0
    if edits and len(starts_a):
        # Keys differ in how much they survive, so as many draws as may be needed are measured, and as many used as are needed.
        missed, kept = 1.0, []
        while len(kept) < most_repeats and missed > 1 - recall:
            one = draw()
            missed *= 1 - _survival(ids_a, starts_a, width, edits, one[0], one[1], mixers, random)
            kept.append(one)
        coins, picks = zip(*kept)
        expected = 1 - missed
    keys, order = [], []
    for c, p in zip(coins, picks):
        k = embed_keys(ids_a, starts_a, width, c, p, mixers)
        o = np.argsort(k, kind="stable")
        keys.append(k[o]), order.append(o)
    pieces = np.unique(_piece_hashes(ids_a, width // (edits + 1)))
    may = np.zeros(1 << 20, bool)
    may[(pieces >> np.uint64(44)).astype(np.int64)] = True
    return Index(vocabulary, ids_a, np.array(item_of, np.int64), starts_a, width, edits, np.array(coins), np.array(picks), mixers, keys, order, expected, pieces, may)


def _survival(ids, starts, width, edits, coins, picks, mixers, random) -> float:
    """Share of item windows whose key is the same after ``edits`` random edits."""
    some = random.choice(starts, min(TRIALS, len(starts)))
    changed = []
    for s in some:
        w = list(ids[s : s + width])
        for _ in range(edits):
            at, how = random.integers(len(w)), random.integers(3)
            if how == 0:
                w[at] = len(coins[0]) - 1
            elif how == 1:
                w.insert(at, len(coins[0]) - 1)
            else:
                w.pop(at)
        changed += (w + [0] * width)[:width]
    before = embed_keys(ids, some, width, coins, picks, mixers)
    after = embed_keys(np.array(changed), np.arange(len(some)) * width, width, coins, picks, mixers)
    return float(np.mean(before == after))


def matches(texts: list[str], index: Index) -> list[tuple[int, int]]:
    """(text number, item) of all texts that hold a window of an item within the allowed edits."""
    get, width = index.vocabulary.get, index.width
    parts, lengths = [], []
    for text in texts:
        own = np.fromiter((get(w, 0) for w in words(text)), np.int64)
        parts.append(own), lengths.append(len(own))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if len(ids) < width or not len(index.starts):
        return []
    owner = np.repeat(np.arange(len(texts)), lengths)
    starts = np.arange(len(ids) - width + 1)
    # A word that is in no item costs an edit, so a window with more such words can't match.
    known = np.concatenate(([0], np.cumsum(ids > 0)))
    keep = (known[starts + width] - known[starts] >= width - index.edits) & (owner[starts] == owner[starts + width - 1])
    starts = starts[keep]
    if index.edits and len(starts):
        starts = starts[_may_match(ids, starts, index)]
    found = np.zeros((0, 2), np.int64)
    spread = np.arange(width)
    code = {int(i): n for n, i in enumerate(np.unique(index.item_of))}
    numbers = np.vectorize(code.__getitem__, otypes=[np.int64])(index.item_of)
    coded = lambda pairs: pairs[:, 0] * len(code) + pairs[:, 1]
    for coins, picks, keys, order in zip(index.coins, index.picks, index.keys, index.order):
        own = embed_keys(ids, starts, width, coins, picks, index.mixers)
        low, high = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        hit = np.flatnonzero(high > low)
        many = np.cumsum(high[hit] - low[hit])
        # A key that many windows of both sides have is verified in parts, so memory stays bounded.
        cuts = np.searchsorted(many, np.arange(VERIFIED, (many[-1] if len(many) else 0) + VERIFIED, VERIFIED), "left") + 1
        first = 0
        for last in cuts:
            part = hit[first:last]
            first = last
            if not len(part):
                continue
            sizes = high[part] - low[part]
            window = np.repeat(part, sizes)
            at = np.arange(len(window)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low[part], sizes)
            entry = order[at]
            pairs = np.stack([owner[starts[window]], numbers[entry]], 1)
            # What an earlier repetition found needs no proof again.
            fresh = ~np.isin(coded(pairs), coded(found))
            window, entry, pairs = window[fresh], entry[fresh], pairs[fresh]
            a, b = index.ids[index.starts[entry][:, None] + spread], ids[starts[window][:, None] + spread]
            good = edit_distances(a, b, index.edits) <= index.edits if index.edits else (a == b).all(1)
            found = np.unique(np.concatenate([found, pairs[good]]), axis=0)
    item = {n: i for i, n in code.items()}
    return [(int(d), item[int(n)]) for d, n in found]


def leaked_items(
    documents: DataFrame, items: DataFrame, width: int = 13, edits: int = 0, recall: float = 0.99, block_bytes: int = BLOCK_BYTES, most_repeats: int = MOST_REPEATS
) -> DataFrame:
    """(doc_id, item_id) of every document that holds ``width`` consecutive words of an item.

    Each window of a document is embedded by a CGK random walk over its words, which turns edit
    distance into Hamming distance; sampled coordinates form an LSH key that is looked up among
    the keys of the items' windows; hits are then verified word by word. With ``edits`` > 0 windows
    within that edit distance match too; repetitions are added until the measured share of keys
    that survive so many edits gives the wanted recall. Where ``most_repeats`` of them don't, a
    warning tells the recall that is expected. With 0 edits equal windows have equal walks: one
    repetition finds all of them. With edits, windows of which no piece can have stayed whole are not
    embedded, which loses no match.

    Documents are never shuffled: the items, a stated query set, go to the executors in blocks of
    at most about ``block_bytes`` bytes of keys, with one pass over the documents per block. Words are runs
    of letters and digits without regard to case. Null texts and ids, and items of fewer than
    ``width`` words, match nothing; repeated rows change nothing.
    """
    spark = documents.sparkSession
    asked = items.filter("item_id is not null and text is not null").select("item_id", "text")
    total = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    # A word and what parts it from the next take two characters at least; a key and its place take 16 bytes.
    blocks = max(1, -(-8 * int(total) * (most_repeats if edits else 1) // block_bytes))
    texts = documents.filter("doc_id is not null and text is not null").select("doc_id", "text")
    result = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        rows = [(r[0], r[1]) for r in part.orderBy("item_id").toLocalIterator()]  # at most a block
        index = build_index(rows, width, edits, recall, most_repeats=most_repeats)
        if index.expected < recall:
            warnings.warn(f"{most_repeats} repetitions reach a recall of {index.expected:.3f} of windows at {edits} edits, not {recall}", stacklevel=2)
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for batch in batches:
                keys = batch["doc_id"].to_numpy()
                hits = matches(list(batch["text"]), index)
                yield pd.DataFrame([(keys[d], i) for d, i in hits], columns=["doc_id", "item_id"])

        found = texts.mapInPandas(run, "doc_id bigint, item_id bigint")
        result = found if result is None else result.unionByName(found)
    return result.distinct()
