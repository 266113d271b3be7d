"""Documents linked by the Jaccard similarity of their word n-grams, with PartEnum signatures."""

from __future__ import annotations

import hashlib
import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccat.llm.common import Batches, arrow_map, texts_of
from doccat.llm.graph import components
from doccat.llm.simhash import shingles
from doccat.operators.scale import HOT_SHARE, SALTS, cut, drop_cut, fits_broadcast

WORDS = 3
# Similarity in percent.
PERCENT = 90
# Upper edge of a band of set sizes over its lower one.
BAND = 1.25
# Second-level partitions, of which a signature leaves out ``LEFT_OUT``.
PARTS = 3
LEFT_OUT = 1
# Counts of a sketch; each is one byte.
SKETCH = 128
# Most rows of a bucket that meet as many others in one step.
STRETCH = 2048
# One in so many sets is counted to find signatures that very many sets share.
SAMPLED = 64


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``words`` words; fewer words are one run, none are none."""
    return np.unique(shingles(text, words))


@cache
def bands() -> list[int]:
    """Lower edges of the bands of set sizes, up to any size that fits in memory."""
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 1, math.floor(edges[-1] * BAND)))
    return edges


def band_of(size: int) -> int:
    return int(np.searchsorted(bands(), size, "right")) - 1


def most_apart(band: int, percent: int = PERCENT) -> int:
    """The most elements that are in one only of two similar sets, the larger one of this band.

    With ``i`` shared elements of ``n`` in total, ``100 i >= percent n`` and sizes ``a + b = n + i`` leave
    ``n - i <= (100 - percent) (a + b) / (100 + percent)``.
    """
    largest = bands()[band + 1] - 1
    return (100 - percent) * 2 * largest // (100 + percent)


def bands_signed(size: int, percent: int = PERCENT) -> list[int]:
    """The bands whose signatures a set has: its own, and above it each one with a set that can be similar."""
    own, most = band_of(size), 100 * size // percent
    return list(range(own, band_of(most) + 1))


def signatures(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures of one set; two sets of at least ``percent`` similarity have one in common.

    For the band of the larger set, at most ``k`` elements differ. The domain is cut by the hash into
    ``(k + 1) / 2`` partitions, rounded up, so that in one of them at most one element differs; each is cut
    into ``PARTS`` more, and for every choice of all but ``LEFT_OUT`` of them the elements inside are
    summed up as a signature. One choice leaves out the part with the element that differs. A sum that
    other sets share by chance costs a comparison, never a link.
    """
    out = []
    mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    for band in bands_signed(len(hashes), percent):
        apart = most_apart(band, percent)
        first = -(-(apart + 1) // (LEFT_OUT + 1))
        second = PARTS if apart else 1
        place = ((hashes >> np.uint64(8)) % np.uint64(first * second)).astype(np.int64)
        sums = np.zeros(first * second, np.uint64)
        np.add.at(sums, place, mixed)
        sums = sums.reshape(first, second)
        if apart:
            sums = sums.sum(axis=1, dtype=np.uint64)[:, None] - sums
        slot = np.arange(first * second, dtype=np.uint64).reshape(first, second) + np.uint64(band << 40)
        key = (sums ^ (slot * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x9E3779B97F4A7C15)
        out.append((key ^ (key >> np.uint64(29))).ravel())
    return np.concatenate(out)


def sketch(hashes: np.ndarray) -> bytes:
    """Elements per class of the hash, as bytes.

    The counts of two sets differ by no more than the elements that are in one of them only.
    """
    counts = np.bincount((hashes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def sign(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``doc_id, n, digest, sketch, sigs`` per row, a narrow step.

    Equal sets have equal digests. Only the first set of a digest that a task meets has a sketch and signatures, so
    copies send at most one list per task.
    """

    def make(batches: Batches) -> Batches:
        met: set[bytes] = set()
        for batch in batches:
            sizes, digests, sketches, sigs = [], [], [], []
            for text in texts_of(batch.column("text")):
                found = shingle_set(text, words)
                digest = hashlib.blake2b(found.astype("<u8").tobytes(), digest_size=16).digest()
                new = len(found) > 0 and digest not in met
                met.add(digest)
                sizes.append(len(found))
                digests.append(digest)
                sketches.append(sketch(found) if new else None)
                sigs.append(signatures(found, percent).view(np.int64) if new else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                    pa.array(sketches, pa.binary()), pa.array(sigs, pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "digest", "sketch", "sigs"],
            )

    return arrow_map(docs, make, "doc_id long, n long, digest binary, sketch binary, sigs array<long>")


def _key(salt: int) -> Column:
    """A number per distinct set; :func:`similar_groups` makes sure that no two sets share one."""
    return F.xxhash64("digest", F.lit(salt))


def buckets(entries: DataFrame) -> DataFrame:
    """``sig, key``: the ``entries (sig, key)`` whose signature some other set has too, each once; a written table.

    Rows of one signature meet in one task, sorted, and pass by one at a time. Signatures that a large share of
    all sets have, as told by a sample of the sets, are dealt to ``SALTS`` tasks; all of their rows stay.
    """
    sample = entries.filter(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(SAMPLED)) == 0)
    seen = cut(sample.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1"))
    sets = sample.agg(F.count_distinct("key")).first()[0]
    hot = seen.filter(F.col("n") * HOT_SHARE > F.lit(sets) + 10 * HOT_SHARE).select("sig", F.lit(True).alias("hot"))
    # The share bounds the hot signatures by those of HOT_SHARE sets.
    dealt = entries.join(F.broadcast(hot) if fits_broadcast(hot) else hot, "sig", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    )
    dealt = dealt.select("sig", "key", "salt", F.coalesce("hot", F.lit(False)).alias("hot"))
    dealt = dealt.repartition("sig", "salt").sortWithinPartitions("sig", "key")

    def shared(batches: Batches) -> Batches:
        # The last distinct row so far, and whether it has been passed on.
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, key = batch.column("sig").to_numpy(), batch.column("key").to_numpy()
            hot = batch.column("hot").to_numpy(zero_copy_only=False)
            if last is not None:
                sig, key = np.append(last[0], sig), np.append(last[1], key)
                hot = np.append(last[2], hot)
            same_sig = sig[1:] == sig[:-1]
            new = np.append(True, ~(same_sig & (key[1:] == key[:-1])))
            # A row is shared if its neighbour has its signature and another key.
            sig, key, hot = sig[new], key[new], hot[new]
            near = sig[1:] == sig[:-1]
            keep = hot | np.append(False, near) | np.append(near, False)
            if last is not None:
                keep[0] |= last[3]
            done = keep[:-1]
            if done.any():
                yield pa.RecordBatch.from_arrays([pa.array(sig[:-1][done]), pa.array(key[:-1][done])], ["sig", "key"])
            last = (sig[-1:], key[-1:], hot[-1:], bool(keep[-1]))
        if last is not None and last[3]:
            yield pa.RecordBatch.from_arrays([pa.array(last[0]), pa.array(last[1])], ["sig", "key"])

    return cut(arrow_map(dealt, shared, "sig long, key long"))


def star_pairs(shared: DataFrame) -> DataFrame:
    """``a, b``: each set with the head of each of its buckets, once.

    The head is the set that meets most others in all its buckets: of copies with changes of their own, it is
    most often the original.
    """
    sizes = cut(shared.groupBy("sig").agg(F.count("*").alias("m")))
    known = shared.join(F.broadcast(sizes) if fits_broadcast(sizes) else sizes, "sig")
    weight = cut(known.groupBy("key").agg(F.sum("m").alias("met")))
    weighed = known.join(F.broadcast(weight) if fits_broadcast(weight) else weight, "key")
    heads = cut(weighed.groupBy("sig").agg(F.max(F.struct("met", "key")).alias("head")).select("sig", F.col("head.key").alias("b")))
    pairs = shared.join(F.broadcast(heads) if fits_broadcast(heads) else heads, "sig").filter("key <> b")
    return pairs.select(F.least("key", "b").alias("a"), F.greatest("key", "b").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs (a, b)`` whose sets in ``sets (key, n, hashes)`` have the similarity; a written table."""
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("hashes").alias("h_a"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("hashes").alias("h_b"))
    sizes = (100 * F.least("n_a", "n_b")) >= percent * F.greatest("n_a", "n_b")
    both = F.size(F.array_intersect("h_a", "h_b"))
    met = pairs.join(left, "a").join(right, "b").filter(sizes)
    return cut(met.filter(100 * both >= percent * (F.col("n_a") + F.col("n_b") - both)).select("a", "b"))


def open_pairs(shared: DataFrame, parts: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``a, b``: sets of one bucket that are not connected yet and may be similar by size and sketch; a written table.

    ``parts (node, component)`` are the connections so far. A bucket within one component is done. The others are cut into
    stretches of ``STRETCH`` rows on average, and any two stretches meet in a step of their own. Sizes and sketches
    bound the similarity from above, so no similar pair is lost.
    """
    known = shared.join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn(
        "part", F.coalesce("component", "key")
    ).drop("component")
    known = cut(known)
    spread = known.groupBy("sig").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("m"))
    mixed = cut(spread.filter("low <> high").select("sig", F.ceil(F.col("m") / STRETCH).cast("int").alias("cuts")))
    left = known.join(F.broadcast(mixed) if fits_broadcast(mixed) else mixed, "sig")
    left = left.join(nodes.filter("sketch IS NOT NULL").select("key", "n", "sketch"), "key")
    left = left.withColumn("at", F.pmod(F.xxhash64("key"), F.col("cuts")).cast("int"))
    sent = left.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).select(
        "sig", F.least("at", "other").alias("x"), F.greatest("at", "other").alias("y"), "at", "key", "part", "n", "sketch"
    )
    keys = ["sig", "x", "y"]
    dealt = sent.repartition(*keys).sortWithinPartitions(*keys, "at", "key")

    def meet(batches: Batches) -> Batches:
        # A group can go on in the next batch; it has two stretches at most.
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(c).to_numpy() for c in keys])
            other = (group != group[:, -1:]).any(axis=0)
            first = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            before = held and any(held[0].column(c)[0] != batch.column(c)[0] for c in keys)
            if before and not first:
                yield from groups(held)
                held = []
            elif first:
                yield from groups([*held, batch.slice(0, first)])
                held = []
            held.append(batch.slice(first))
        if held:
            yield from groups(held)

    def groups(rows: list[pa.RecordBatch]) -> Batches:
        table = pa.Table.from_batches(rows).combine_chunks()
        group = np.stack([table.column(c).to_numpy() for c in keys])
        starts = np.flatnonzero(np.append(True, (np.diff(group, axis=1) != 0).any(axis=0)))
        at, key, part, n = (table.column(c).to_numpy() for c in ("at", "key", "part", "n"))
        flat = b"".join(table.column("sketch").to_pylist())
        counts = np.frombuffer(flat, np.uint8).reshape(-1, SKETCH).astype(np.int16)
        for s, e in zip(starts, np.append(starts[1:], len(key)), strict=True):
            x, y = group[1, s], group[2, s]
            mine = np.arange(s, e) if x == y else np.flatnonzero(at[s:e] == x) + s
            theirs = mine if x == y else np.flatnonzero(at[s:e] == y) + s
            a_side, b_side = [], []
            for i in mine:
                rest = theirs[theirs > i] if x == y else theirs
                total = n[rest] + n[i]
                may = (part[rest] != part[i]) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))
                rest, total = rest[may], total[may]
                apart = np.abs(counts[rest] - counts[i]).sum(axis=1, dtype=np.int64)
                rest = rest[apart * (100 + percent) <= (100 - percent) * total]
                if len(rest):
                    a_side.append(np.full(len(rest), key[i]))
                    b_side.append(key[rest])
            if a_side:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_side)), pa.array(np.concatenate(b_side))], ["a", "b"])

    found = arrow_map(dealt, meet, "a long, b long")
    return cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def sets_of(docs: DataFrame, wanted: DataFrame, words: int, salt: int) -> DataFrame:
    """``key, n, hashes`` of the sets ``wanted (key, first)``, made anew from the texts; a written table.

    ``first`` is the id of some row with the set; texts are not shuffled if the ids fit a broadcast.
    """
    ids = cut(wanted.select(F.coalesce("first", F.lit(0)).alias("_id"), F.col("first").isNull().alias("_bare")).distinct())
    rows = docs.withColumn("_id", F.coalesce("doc_id", F.lit(0))).withColumn("_bare", F.col("doc_id").isNull())
    rows = rows.join(F.broadcast(ids) if fits_broadcast(ids) else ids, ["_id", "_bare"], "left_semi")

    def make(batches: Batches) -> Batches:
        for batch in batches:
            found = [shingle_set(t, words) for t in texts_of(batch.column("text"))]
            digests = [hashlib.blake2b(x.astype("<u8").tobytes(), digest_size=16).digest() for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(digests, pa.binary()), pa.array([len(x) for x in found], pa.int64()),
                    pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64())),
                ],
                ["digest", "n", "hashes"],
            )

    made = arrow_map(rows.select("text"), make, "digest binary, n long, hashes array<long>")
    made = made.withColumn("key", _key(salt)).join(wanted.select("key"), "key", "left_semi")
    return cut(made.select("key", "n", "hashes").dropDuplicates(["key"]))


def similar_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs (doc_id, text)``.

    The set of a text is its distinct runs of ``words`` words, A-Z lower-cased; with fewer words the whole sequence. Rows
    link whose sets share at least ``percent`` of the elements of either, and ``component_id`` is the smallest
    ``doc_id`` that links reach. A null or empty text and one without words have an empty set, link with nothing and are their own
    component. A null ``doc_id`` links others but is no component id; a component of such rows alone has a
    null one. Rows that repeat an id are linked by their own texts. Other columns are not read; an empty table stays
    empty. ``docs`` is read twice and has to give the same rows.

    Sets that share a PartEnum signature are candidates. First each is compared with the head of its buckets; then
    those in one bucket that are still unconnected, unless size or sketch rule a link out. All comparisons are by whole sets.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(sign(docs, words, percent))
    salt = 0
    while True:
        # One row per distinct set. Two sets with one key are so rare that another salt is tried.
        nodes = signed.filter("n > 0").groupBy("digest").agg(
            F.min("doc_id").alias("first"), F.max("n").alias("n"), F.max("sketch").alias("sketch")
        )
        nodes = cut(nodes.withColumn("key", _key(salt)))
        if nodes.count() == nodes.select("key").distinct().count():
            break
        salt += 1
    entries = signed.filter("sigs IS NOT NULL").select(F.explode("sigs").alias("sig"), _key(salt).alias("key"))
    shared = buckets(entries)
    wanted = cut(shared.select("key").distinct().join(nodes.select("key", "first"), "key"))
    sets = sets_of(docs, wanted, words, salt)
    stars = cut(star_pairs(shared))
    links = verified(stars, sets, percent)
    parts = cut(components(links))
    more = open_pairs(shared, parts, nodes, percent).join(stars, ["a", "b"], "left_anti")
    links = links.unionByName(verified(more, sets, percent))
    parts = cut(components(links))
    drop_cut(sets)
    drop_cut(shared)
    grouped = nodes.join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("part", F.coalesce("component", "key"))
    grouped = cut(grouped.select("digest", "part", "first"))
    lows = cut(grouped.groupBy("part").agg(F.min("first").alias("low")))
    labels = cut(grouped.join(F.broadcast(lows) if fits_broadcast(lows) else lows, "part").select("digest", "low"))
    rows = signed.select("doc_id", "n", "digest")
    rows = rows.join(F.broadcast(labels) if fits_broadcast(labels) else labels, "digest", "left")
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("doc_id")).alias("component_id")
    )
