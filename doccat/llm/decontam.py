"""Benchmark decontamination: SimHash of item-sized windows, Hamming index, exact check."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.llm.common import Batches, arrow_map, with_content_key, without
from doccat.operators.scale import cut

SHINGLE = 5
SIMILARITY = 0.8
BITS = 64
# Fingerprints up to this many bits apart are candidates; the index has BLOCKS tables.
RADIUS = 19
BLOCKS = 8
# Items with fewer words have too few shingles for a similarity and are matched word for word.
LEAST_WORDS = 8
# Bytes of item text whose index goes to the executors at once; more items take further passes.
INDEX_BYTES = 2 << 20
SEED = 42
# Windows whose bits are counted at a time.
CHUNK = 1 << 13
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def hashes_of(words: list[str]) -> np.ndarray:
    """XXH64 of each shingle of five words, in order."""
    from xxhash import xxh64_intdigest

    if len(words) < SHINGLE:
        return np.empty(0, np.uint64)
    line = " ".join(words).encode()
    sizes = np.fromiter((len(w.encode()) for w in words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - SHINGLE + 1].tolist()
    return np.array([xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64)


class Index:
    """Items by the number of their shingles, each size with tables of fingerprint blocks.

    The weight of a shingle is ``log(1 + items / items that have it)``; one that no item has weighs as
    much as one of a single item. A fingerprint bit is 1 if the weights of the shingles with that
    bit exceed half of all. Two fingerprints within ``RADIUS`` bits agree up to ``RADIUS // BLOCKS`` bits in
    some block, so the table of that block, which holds every key that near, finds the pair.
    """

    def __init__(self, items: list[tuple[int, str]]):
        split = [(i, words_of(t)) for i, t in items]
        kept = [(i, hashes_of(w)) for i, w in split if len(w) >= LEAST_WORDS]
        # Short items by their words, and by a first word the lengths that can follow.
        self.short: dict[tuple[str, ...], list[int]] = {}
        self.lengths: dict[str, set[int]] = {}
        for i, w in split:
            if 0 < len(w) < LEAST_WORDS:
                self.short.setdefault(tuple(w), []).append(i)
                self.lengths.setdefault(w[0], set()).add(len(w))
        self.ids = [i for i, _ in kept]
        self.counts = [Counter(h.tolist()) for _, h in kept]
        spread = Counter(s for c in self.counts for s in c)
        n = max(1, len(kept))
        self.rare = math.log(1 + n)
        self.weights = {s: math.log(1 + n / df) for s, df in spread.items()}
        self.shingles = np.array(sorted(spread), np.uint64)
        self.shingle_weights = np.array([self.weights[s] for s in self.shingles.tolist()])
        self.fps = fingerprints_of([self.weigh(h) for _, h in kept], [h for _, h in kept])
        self.sizes: dict[int, tuple[np.ndarray, list[dict[int, list[int]]]]] = {}
        self.near = nearby(BITS // BLOCKS, RADIUS // BLOCKS)
        for size in sorted({len(h) for _, h in kept}):
            members = [k for k, (_, h) in enumerate(kept) if len(h) == size]
            # Per block an array from key to the members near it.
            tables = np.zeros((BLOCKS, 1 << (BITS // BLOCKS), len(members)), bool)
            for m, k in enumerate(members):
                for b, key in enumerate(self.fps[k : k + 1].view(np.uint8).tolist()):
                    tables[b, key ^ self.near, m] = True
            self.sizes[size] = (np.array(members), tables)

    def weigh(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.full(len(hashes), self.rare)
        at = np.minimum(np.searchsorted(self.shingles, hashes), len(self.shingles) - 1)
        return np.where(self.shingles[at] == hashes, self.shingle_weights[at], self.rare)

    def similarity(self, item: int, hashes: np.ndarray) -> float:
        """Weighted Jaccard similarity of the two shingle multisets."""
        mine, theirs = self.counts[item], Counter(hashes.tolist())
        both = sum(self.weights[s] * min(n, theirs[s]) for s, n in mine.items() if s in theirs)
        all_ = sum(self.weights.get(s, self.rare) * max(mine[s], theirs[s]) for s in mine.keys() | theirs.keys())
        return both / all_ if all_ else 0.0


def nearby(bits: int, radius: int) -> np.ndarray:
    every = np.arange(1 << bits)
    return every[np.bitwise_count(every) <= radius]


def fingerprints_of(weights: list[np.ndarray], hashes: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(hashes), np.uint64)
    for k, (w, h) in enumerate(zip(weights, hashes, strict=True)):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = (2 * (w @ bits) > w.sum()).astype(np.uint8)
        out[k] = np.packbits(ones, bitorder="little").view("<u8")[0]
    return out


def window_hits(hashes: np.ndarray, index: Index, least: float) -> list[tuple[int, float, int, int, int]]:
    """``(item, similarity, first shingle, shingles, bits apart)``: the best window per item.

    Windows have the sizes of the items and start at every shingle. One that has no shingle of any
    item has similarity 0 with all of them, so only windows that reach such a shingle get a fingerprint.
    """
    if not len(index.shingles) or not len(hashes):
        return []
    at = np.minimum(np.searchsorted(index.shingles, hashes), len(index.shingles) - 1)
    shared = np.flatnonzero(index.shingles[at] == hashes)
    if not len(shared):
        return []
    best: dict[int, tuple[int, float, int, int, int]] = {}
    # Stretches around shared shingles, as far as the longest item reaches, overlaps joined.
    longest = max(index.sizes)
    lows, highs = np.maximum(shared - longest + 1, 0), np.minimum(shared + longest, len(hashes))
    new = np.flatnonzero(np.concatenate([[True], lows[1:] > highs[:-1]]))
    for first, last in zip(lows[new], np.append(highs[new[1:] - 1], highs[-1]), strict=True):
        # Long stretches in parts that overlap by the longest window.
        for low in range(int(first), int(last), CHUNK):
            _search(hashes, low, min(int(last), low + CHUNK + longest - 1), index, least, best)
    return sorted(best.values())


def short_hits(words: list[str], index: Index) -> list[tuple[int, int, int]]:
    """``(item id, first word, words)``: the first place of each short item that stands in ``words`` as it is."""
    if not index.short:
        return []
    first: dict[tuple[str, ...], int] = {}
    for at, word in enumerate(words):
        for n in index.lengths.get(word, ()):
            item = tuple(words[at : at + n])
            if item in index.short:
                first.setdefault(item, at)
    return sorted((i, at, len(item)) for item, at in first.items() for i in index.short[item])


def _search(hashes, low: int, high: int, index: Index, least: float, best: dict) -> None:
    part = hashes[low:high]
    weights = index.weigh(part)
    bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(part) + 1, BITS))
    np.cumsum(bits * weights[:, None], axis=0, out=sums[1:])
    totals = np.concatenate([[0.0], np.cumsum(weights)])
    for size, (members, tables) in index.sizes.items():
        # A text shorter than the item is one window of its own.
        span = min(size, len(part)) if len(hashes) < size else size
        n = len(part) - span + 1
        if n < 1:
            continue
        ones = 2 * (sums[span : span + n] - sums[:n]) > (totals[span : span + n] - totals[:n])[:, None] + 1e-9
        keys = np.packbits(ones, axis=1, bitorder="little")
        found = np.zeros((n, len(members)), bool)
        for b in range(BLOCKS):
            found |= tables[b][keys[:, b]]
        starts, which = np.nonzero(found)
        apart = np.bitwise_count(keys.view("<u8")[starts, 0] ^ index.fps[members[which]])
        near = apart <= RADIUS
        # Nearest fingerprints first: later windows must only be checked if they could be better.
        for start, k, d in sorted(zip(starts[near].tolist(), members[which[near]].tolist(), apart[near].tolist()), key=lambda x: (x[2], x[0])):
            old = best.get(k)
            if old and old[1] >= 1.0:
                continue
            s = index.similarity(k, part[start : start + span])
            if s >= least and (not old or (s, -(low + start)) > (old[1], -old[2])):
                best[k] = (k, s, low + start, span, d)


def item_blocks(items: DataFrame, block_bytes: int = INDEX_BYTES) -> list[list[tuple[int, str]]]:
    """Items in lists of at most ``block_bytes`` of text, each to be searched for in its own pass."""
    picked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    picked = picked.filter("item_id IS NOT NULL AND text IS NOT NULL")
    blocks: list[list[tuple[int, str]]] = [[]]
    held = 0
    for row in picked.orderBy("item_id", "text").toLocalIterator():
        if held and held + len(row["text"]) > block_bytes:
            blocks.append([])
            held = 0
        blocks[-1].append((row["item_id"], row["text"]))
        held += len(row["text"])
    return blocks


def contaminated(docs: DataFrame, items: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, similarity, start_word, n_words, bits_apart``: items found in documents.

    One row per row of ``docs`` and item whose best window reaches ``least``; ties go to the first window.
    Words are lower-cased runs of letters, digits and underscores, shingles have five. Items of fewer than
    ``LEAST_WORDS`` words are found where all their words stand in a row; null ids and texts are left out of ``items``, and an item id that
    comes twice counts as two items. A null or short text has no row, neither has an empty table. Other
    columns are not read. The documents are read once per ``INDEX_BYTES`` of item text.
    """
    shape = pa.schema([
        ("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()),
        ("start_word", pa.int64()), ("n_words", pa.int64()), ("bits_apart", pa.int64()),
    ])
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def search(block: list[tuple[int, str]]):
        def run(batches: Batches) -> Batches:
            index = Index(block)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    words = words_of(text)
                    for k, s, first, n, d in window_hits(hashes_of(words), index, least):
                        rows.append((doc_id, index.ids[k], s, first, n + SHINGLE - 1, d))
                    for i, first, n in short_hits(words, index):
                        rows.append((doc_id, i, 1.0, first, n, 0))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape
                    )

        return run

    schema = "doc_id long, item_id long, similarity double, start_word long, n_words long, bits_apart long"
    parts = [arrow_map(picked, search(block), schema) for block in item_blocks(items)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, items: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns as they are.

    Each row goes or stays by its own text, also if it shares its ``doc_id`` with others or has none.
    """
    rows = with_content_key(docs, "text")
    found = contaminated(rows.select(F.col("_row").alias("doc_id"), "_doc.text"), items, least)
    return without(rows, cut(found.select(F.col("doc_id").alias("_row")).distinct()), "_row").select("_doc.*")
