"""Packing of token pieces into sequences by shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doccat.llm.common import Batches, arrow_map, encoder, larger, ship_vocabulary
from doccat.operators.scale import cut, drop_cut

SEQUENCE = 2048
# Characters that a worker cuts at once and runs that it remembers: packing is the last of several stages, and what the
# workers and executors of the others hold stays with them.
PART = 4 << 20
REMEMBERED = 200_000


def pack_histogram(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns ``(how many sequences, [(length, how often)])`` that hold all pieces.

    Lengths are placed longest first. Pieces of one length go, all at once, into the open packs that
    are filled least and have room for them; packs that get a piece form a new pattern with their
    own count, and pieces that find no room open new packs. Work depends on the number of
    different lengths, not of pieces.
    """
    # Open patterns in a heap by what they hold; a pattern is a chain (length, times, rest).
    open_packs: list[tuple[int, int, int, tuple | None]] = []
    done: list[tuple[int, tuple | None]] = []
    serial = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        if length < 1 or length > size:
            raise ValueError(f"piece of {length} in sequences of {size}")
        if left < 1:
            continue
        while left and open_packs and open_packs[0][0] + length <= size:
            filled, _, packs, chain = heapq.heappop(open_packs)
            # Each of the emptiest packs takes one piece, or several when pieces abound.
            times = max(1, min((size - filled) // length, left // packs))
            used = min(packs, left // times)
            if used < packs:
                serial += 1
                heapq.heappush(open_packs, (filled, serial, packs - used, chain))
            left -= used * times
            serial += 1
            now = filled + times * length
            entry = (now, serial, used, (length, times, chain))
            if now == size:
                done.append((used, entry[3]))
            else:
                heapq.heappush(open_packs, entry)
        if left:
            times = size // length
            full, rest = divmod(left, times)
            for used, n in ((full, times), (1 if rest else 0, rest)):
                if used:
                    serial += 1
                    if n * length == size:
                        done.append((used, (length, n, None)))
                    else:
                        heapq.heappush(open_packs, (n * length, serial, used, (length, n, None)))
    done += [(packs, chain) for _, _, packs, chain in open_packs]
    patterns = []
    for packs, chain in done:
        parts = []
        while chain:
            parts.append(chain[:2])
            chain = chain[2]
        patterns.append((packs, parts[::-1]))
    return patterns


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows ``length, rank, sequence, offset, packs, times`` in the order of length and rank.

    Pieces of ``length`` from ``rank`` on fill a run of ``packs`` sequences from ``sequence`` on,
    ``times`` in each, the first at ``offset``.
    """
    rows, next_rank, sequence = [], {}, 0
    for packs, parts in patterns:
        offset = 0
        for length, times in parts:
            rank = next_rank.get(length, 0)
            rows.append((length, rank, sequence, offset, packs, times))
            next_rank[length] = rank + packs * times
            offset += length * times
        sequence += packs
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 6)


def token_pieces(
    docs: DataFrame, vocabulary: str, end_id: int, size: int = SEQUENCE, spaced: bool = False
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens``: documents cut into pieces of ``size``.

    Only the last piece of a document is shorter. A null text is empty: one piece of ``end_id``. Rows are cut
    one by one, so null and repeated ids do not matter; other columns are not read. An empty table
    stays empty.
    """
    shape = pa.schema(
        [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    )

    name = ship_vocabulary(docs.sparkSession, vocabulary)

    def cut_up(batches: Batches) -> Batches:
        encode = encoder(name, spaced, PART, REMEMBERED).encode_all
        for batch in larger(batches, PART // 2):
            rows = []
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for doc_id, found in zip(ids, encode([x or "" for x in texts]), strict=True):
                found = np.append(found, np.uint32(end_id)).astype("<u4")
                for start in range(0, len(found), size):
                    piece = found[start : start + size]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(found)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=shape
                )

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(docs, cut_up, schema)


def pack(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``size``.

    1. The pieces are written: the workers that made them are done before others number them, so an executor
       holds one set of workers at a time. Each piece gets its number among pieces of its length in its
       partition; this table is written too, so partitions and numbers stay as they are.
    2. Counts per partition and length give each partition its first rank for each length. They are
       added up per length, over as many rows as there are partitions.
    3. The histogram (``size`` rows at most) goes to the driver and is packed there.
    4. The slots of the patterns, a few per length, come back to the tasks, and each piece looks up
       the slot of its rank. A length that a third of all pieces have is no key of any shuffle.

    Which piece of a length takes which rank is arbitrary. An empty table stays empty.
    """
    fields = [f for f in pieces.schema if f.name not in ("sequence_id", "offset")]
    names = [f.name for f in fields]
    made = cut(pieces.select(*names))
    part = made.withColumn("_part", F.spark_partition_id())

    def number(batches: Batches) -> Batches:
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            order = np.argsort(lengths, kind="stable")
            ordered = lengths[order]
            nth = np.empty(len(lengths), np.int64)
            nth[order] = np.arange(len(lengths)) - np.searchsorted(ordered, ordered, "left")
            nth += seen[lengths]
            seen += np.bincount(lengths, minlength=size + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth)], [*batch.schema.names, "_nth"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    numbered = cut(arrow_map(part, number, f"{kinds}, _part int, _nth long"))
    drop_cut(made)
    counts = numbered.groupBy("_part", "length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    histogram = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slots(pack_histogram(histogram, size))
    wide = 1 << 40
    keys = table[:, 0] * wide + table[:, 1]

    def place(batches: Batches) -> Batches:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            slot = table[np.searchsorted(keys, length * wide + rank, "right") - 1]
            at, times = rank - slot[:, 1], slot[:, 5]
            sequence = slot[:, 2] + at // times
            offset = slot[:, 3] + at % times * length
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    # A key holds the pieces of one length in one partition at most.
    ranked = numbered.join(firsts, ["_part", "length"]).select(
        *names, (F.col("_first") + F.col("_nth")).alias("_rank")
    )
    return arrow_map(ranked, place, f"{kinds}, sequence_id long, offset long")
