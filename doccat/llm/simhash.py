"""SimHash near duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccat.llm.common import Batches, arrow_map, texts_of, with_row_key, without
from doccat.llm.graph import components
from doccat.operators.scale import cut

BITS = 64
WORDS = 4
RADIUS = 4
SEED = 42
# Hashes whose bits are counted at a time.
CHUNK = 1 << 14
# Fingerprints that are compared with each other at once; larger buckets are split by more masks.
BUCKET = 1 << 12


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of each run of ``words`` words, in order; fewer words are one shingle, none are none.

    A-Z are lower-cased; words are runs of bytes other than 09 to 0D and 20.
    """
    from xxhash import xxh64_intdigest

    found = text.lower().split()
    if not found:
        return np.empty(0, "<u8")
    line = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends[min(words, len(found)) - 1 :].tolist()
    return np.array([xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts, ends)], "<u8")


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """A bit is 1 if more than half of the shingles' XXH64 have it. No word: 0."""
    hashes = shingles(text, words)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The long columns ``keys`` and ``fp``: the fingerprint of each row's whole ``text`` as a signed long.

    A null text has no word, so its fingerprint is 0. Other columns are not read.
    """

    def sign(batches: Batches) -> Batches:
        for batch in batches:
            found = [fingerprint(t, words) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, keys), pa.array(np.array(found, np.uint64).view(np.int64))], [*keys, "fp"]
            )

    docs = docs.select(*[F.col(k).cast("long").alias(k) for k in keys], F.col("text").cast("string").alias("text"))
    return arrow_map(docs, sign, "".join(f"{k} long, " for k in keys) + "fp long")


def covering_masks(radius: int, bits: int = BITS, within: int | None = None) -> list[int]:
    """``2**(radius+1) - 1`` masks; any ``radius`` bits are all outside at least one of them.

    Bit ``i`` gets a vector ``m(i)`` of ``radius + 1`` bits; mask ``v`` has the bits whose
    ``m(i) & v`` has odd parity. For any ``radius`` bits, fewer than ``radius + 1`` linear equations
    ``m(i) . v = 0`` always have a solution ``v`` other than 0. Vectors are dealt out evenly, so
    each mask has about half of the bits. ``within`` limits the masks to the bits of that number.
    """
    places = [i for i in range(bits) if within is None or within >> i & 1]
    top = 1 << (radius + 1)
    vectors = {p: 1 + n * 5 % (top - 1) for n, p in enumerate(places)}
    masks = []
    for v in range(1, top):
        masks.append(sum(1 << p for p in places if (vectors[p] & v).bit_count() & 1))
    return masks


def links_within(fps: np.ndarray, radius: int, free: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that connect all of ``fps`` (distinct) that are linked at ``radius``.

    The pairs span the linked sets and are fewer than the fingerprints. ``free`` are the bits in
    which members can differ. A set above ``BUCKET`` is split by covering masks over the free
    bits, which lose no pair; each split leaves about half of the bits free.
    """
    n = len(fps)
    if n < 2:
        return []
    masks = covering_masks(radius, within=free) if n > BUCKET and free.bit_count() > 2 * radius else []
    if masks and all(masks):
        out = []
        for mask in masks:
            keys = fps & np.uint64(mask)
            order = np.argsort(keys, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
                sub = links_within(fps[group], radius, free & ~mask)
                out += [(group[a], group[b]) for a, b in sub]
        return out
    # Breadth first: everything near the node in hand leaves the open set and links to it.
    a_side, b_side = [], []
    open_ = np.arange(n)
    while len(open_):
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            node = queue.pop()
            near = np.bitwise_count(fps[open_] ^ fps[node]) <= radius
            if near.any():
                hit, open_ = open_[near], open_[~near]
                a_side.append(np.full(len(hit), node))
                b_side.append(hit)
                queue.extend(hit.tolist())
    return [(np.concatenate(a_side), np.concatenate(b_side))] if a_side else []


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b)``: pairs of the column ``id`` whose distinct ``fp`` differ in ``radius`` bits or fewer.

    Every such pair is connected by the listed ones. A fingerprint goes to one bucket per covering
    mask; buckets of one member are dropped by a count that is summed up before its shuffle.
    """
    masks = covering_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])
    placed = fps.select("fp", "id", F.posexplode(keys).alias("mask", "key"))
    dealt = placed.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")

    def link(batches: Batches) -> Batches:
        # A bucket can go on in the next batch: its rows wait until the key changes.
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("mask", "key", "fp", "id")])
            other = (rows[:2] != rows[:2, -1:]).any(axis=0)
            first = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if first or (held and (held[0][:2, 0] != rows[:2, 0]).any()):
                yield from buckets(np.concatenate([*held, rows[:, :first]], axis=1))
                held = []
            held.append(rows[:, first:])
        if held:
            yield from buckets(np.concatenate(held, axis=1))

    def buckets(rows: np.ndarray) -> Batches:
        if rows.shape[1] < 2:
            return
        change = (np.diff(rows[:2], axis=1) != 0).any(axis=0)
        starts = np.flatnonzero(np.concatenate([[True], change]))
        ends = np.append(starts[1:], rows.shape[1])
        a, b = [], []
        sizes = ends - starts
        # Buckets of two are by far the most: all at once.
        two = starts[sizes == 2]
        fp = rows[2].view(np.uint64)
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        a.append(rows[3][near])
        b.append(rows[3][near + 1])
        for s, e in zip(starts[sizes > 2], ends[sizes > 2], strict=True):
            free = ~masks[int(rows[0, s])] & (1 << BITS) - 1
            for x, y in links_within(fp[s:e], radius, free):
                a.append(rows[3][s:e][x])
                b.append(rows[3][s:e][y])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return arrow_map(dealt, link, "a long, b long").distinct()


def linked_groups(signed: DataFrame, radius: int, first: Column) -> DataFrame:
    """``fp, low``: per distinct ``fp`` of the written table ``signed`` the smallest ``first`` that links reach.

    Copies share a fingerprint, and everything here works on one row per distinct one.
    """
    # One node per fingerprint: its smallest value, if any, and a number that is surely its own.
    nodes = cut(signed.groupBy("fp").agg(F.min(first).alias("first")).withColumn("id", F.monotonically_increasing_id()))
    found = components(near_links(nodes, radius))
    grouped = nodes.join(found, nodes["id"] == found["node"]).select("fp", "first", "component")
    lows = grouped.groupBy("component").agg(F.min("first").alias("low"))
    linked = grouped.join(lows, "component").select("fp", "low")
    return cut(nodes.join(linked, "fp", "left").select("fp", F.coalesce("low", "first").alias("low")))


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs (doc_id, text)``.

    Documents whose fingerprints differ in ``radius`` bits or fewer are linked, and
    ``component_id`` is the smallest ``doc_id`` that links reach. Documents without a word have
    fingerprint 0 and are linked like any other. Rows that repeat a ``doc_id`` are linked by
    their own texts. A null ``doc_id`` links others but is no component id; a component of
    such rows alone has a null one. Other columns are not read. An empty table stays empty.
    """
    signed = cut(fingerprints(docs, words))
    labels = linked_groups(signed, radius, F.col("doc_id"))
    return signed.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("low").alias("component_id")
    )


def one_per_group(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, that with the smallest ``doc_id``.

    Of rows that share this id, and in components without any id, any one stays. Each row is linked by its
    own text, whether its ``doc_id`` is null or repeated. Texts without a word are one component. Columns are
    kept as they are; an empty table stays empty.
    """
    rows = with_row_key(docs)
    keyed = rows.select(F.col("_doc.doc_id").alias("doc_id"), "_row", "_doc.text")
    signed = cut(fingerprints(keyed, words, ("doc_id", "_row")))
    # Rows without an id come after all others.
    place = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "_row")
    labels = linked_groups(signed, radius, place)
    gone = signed.join(labels, "fp").filter(F.col("_row") != F.col("low._row")).select("_row")
    return without(rows, cut(gone), "_row").select("_doc.*")
