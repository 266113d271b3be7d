"""Token ids in binary files of patched frame-of-reference blocks.

A shard file is::

    magic | block* | doc ids | null flags | doc lengths | block starts | trailer

A block holds ``BLOCK`` ids: ``min u32, n u16, exceptions u16, width u8``, then the distances from
the minimum packed at ``width`` bits, then the positions (u16) and full distances (u32) of the ids
that need more. ``width`` fits a given percentile of the block. The trailer says where the parts
start, so a reader finds any block without reading the ones before.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doccat.llm.common import Batches, arrow_map, encoder, file_system, larger, make_folder, ship_vocabulary
from doccat.operators.scale import cut

MAGIC = b"PFORTOK1"
BLOCK = 1024
PERCENTILE = 95.0
HEAD = struct.Struct("<IHHB")
TRAILER = struct.Struct("<QQQ8s")
# Ids that are packed or unpacked at a time.
CHUNK = 256 * BLOCK


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs, 0 for 0. Exact for values below 2**32."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """One byte string per block of ``BLOCK`` ids; the last block may be shorter."""
    out = []
    full = len(ids) // BLOCK
    groups = [ids[: full * BLOCK].reshape(full, BLOCK)] if full else []
    if len(ids) % BLOCK:
        groups.append(ids[full * BLOCK :].reshape(1, -1))
    for block in groups:
        low = block.min(axis=1)
        gaps = block - low[:, None]
        n = gaps.shape[1]
        at = min(n - 1, int(np.ceil(n * percentile / 100)) - 1)
        widths = _bits(np.partition(gaps, at, axis=1)[:, at])
        packed: list[bytes] = [b""] * len(gaps)
        for width in np.unique(widths):
            rows = np.flatnonzero(widths == width)
            for row, bytes_ in zip(rows, _pack(gaps[rows], int(width)), strict=True):
                packed[row] = bytes_
        limit = np.left_shift(np.uint64(1), widths.astype(np.uint64))
        over = gaps >= limit[:, None]
        for row in range(len(gaps)):
            odd = np.flatnonzero(over[row])
            head = HEAD.pack(int(low[row]), n, len(odd), int(widths[row]))
            tail = odd.astype("<u2").tobytes() + gaps[row, odd].astype("<u4").tobytes()
            out.append(head + packed[row] + tail)
    return out


def _pack(gaps: np.ndarray, width: int) -> list[bytes]:
    if width in (8, 16, 32):
        kept = gaps.astype(f"<u{width // 8}")
    else:
        bits = (gaps[:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
        kept = np.packbits(bits.astype(np.uint8).reshape(len(gaps), -1), axis=1, bitorder="little")
    return [row.tobytes() for row in kept]


def unpack_block(data: bytes) -> np.ndarray:
    low, n, odd, width = HEAD.unpack_from(data)
    at = HEAD.size
    if width in (8, 16, 32):
        gaps = np.frombuffer(data, f"<u{width // 8}", n, at).astype(np.uint32)
        at += n * width // 8
    else:
        size = (n * width + 7) // 8
        bits = np.unpackbits(
            np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little"
        ).reshape(n, width)
        weights = np.left_shift(np.uint32(1), np.arange(width, dtype=np.uint32))
        gaps = bits.astype(np.uint32) @ weights if width else np.zeros(n, np.uint32)
        at += size
    if odd:
        gaps = gaps.copy()
        gaps[np.frombuffer(data, "<u2", odd, at)] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
    return gaps + np.uint32(low)


class ShardWriter:
    """Writes one shard; ids may come in pieces of any size."""

    def __init__(self, stream, percentile: float):
        self.stream, self.percentile = stream, percentile
        self.at = stream.write(MAGIC)
        self.starts: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_tokens = 0
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_tokens += len(ids)
        if self.n_waiting >= CHUNK:
            self._flush(self.n_waiting // BLOCK * BLOCK)

    def _flush(self, n: int) -> None:
        ids = np.concatenate(self.waiting)
        for start in range(0, n, CHUNK):
            for block in pack_blocks(ids[start : min(n, start + CHUNK)], self.percentile):
                self.starts.append(self.at)
                self.at += self.stream.write(block)
        self.waiting, self.n_waiting = [ids[n:]], len(ids) - n

    def close(self) -> int:
        if self.n_waiting:
            self._flush(self.n_waiting)
        nulls = np.array([x is None for x in self.doc_ids], np.uint8)
        index = self.at
        self.starts.append(self.at)
        for part in (
            np.array([x or 0 for x in self.doc_ids], "<i8"), nulls,
            np.array(self.lengths, "<u8"), np.array(self.starts, "<u8"),
        ):
            self.at += self.stream.write(part.tobytes())
        self.at += self.stream.write(
            TRAILER.pack(index, len(self.doc_ids), len(self.starts), MAGIC)
        )
        return self.at


def read_shard(path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """``(doc_id, ids)`` of each document of a shard in order, some blocks at a time."""
    system, name = file_system(path)
    with system.open_input_file(name) as file:
        end = file.size()
        index, n_docs, n_starts, magic = TRAILER.unpack(
            file.read_at(TRAILER.size, end - TRAILER.size)
        )
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token shard")
        tail = file.read_at(end - TRAILER.size - index, index)
        doc_ids = np.frombuffer(tail, "<i8", n_docs)
        nulls = np.frombuffer(tail, np.uint8, n_docs, 8 * n_docs)
        lengths = np.frombuffer(tail, "<u8", n_docs, 9 * n_docs)
        starts = np.frombuffer(tail, "<u8", n_starts, 17 * n_docs).astype(np.int64)
        ids, block = np.empty(0, np.uint32), 0
        for doc_id, null, length in zip(doc_ids, nulls, lengths, strict=True):
            have = [ids]
            total = len(ids)
            while total < length:
                last = min(n_starts - 1, block + CHUNK // BLOCK)
                data = file.read_at(int(starts[last] - starts[block]), int(starts[block]))
                for b in range(block, last):
                    have.append(unpack_block(data[starts[b] - starts[block] : starts[b + 1] - starts[block]]))
                    total += len(have[-1])
                block = last
            ids = np.concatenate(have) if len(have) > 1 else ids
            yield (None if null else int(doc_id)), ids[: int(length)]
            ids = ids[int(length) :]


def write_tokens(
    docs: DataFrame, folder: str, vocabulary: str, end_id: int,
    spaced: bool = True, percentile: float = PERCENTILE,
) -> DataFrame:
    """Encode ``text`` and write shard files below ``folder`` in ascending ``doc_id`` order.

    Returns the manifest, one row per file: ``shard, path, n_docs, n_tokens, n_bytes, start`` with
    the ids of all shards before it as ``start``. Documents are dealt out by ranges of ``doc_id``;
    null ids come first, and rows of one id are in the order of a hash of their text, so that many
    rows of one id are split too. A null text is empty: its only id is ``end_id``. Other columns
    are not read. Each attempt of a task writes a file of its own and only the one that the
    manifest names counts, so a lost executor leaves at worst a file nobody reads. An empty table
    gives an empty manifest.
    """
    make_folder(folder)
    vocabulary = ship_vocabulary(docs.sparkSession, vocabulary)

    def write(batches: Batches) -> Batches:
        encode = encoder(vocabulary, spaced).encode_all
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.pfor"
        writer = stream = None
        for batch in larger(batches):
            if writer is None and batch.num_rows:
                system, name = file_system(path)
                stream = system.open_output_stream(name)
                writer = ShardWriter(stream, percentile)
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for doc_id, found in zip(ids, encode([x or "" for x in texts]), strict=True):
                writer.add(doc_id, np.append(found, np.uint32(end_id)))
        if writer is not None:
            size = writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": [shard], "path": [path], "n_docs": [len(writer.doc_ids)],
                    "n_tokens": [writer.n_tokens], "n_bytes": [size],
                }
            )

    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).withColumn("_tie", F.xxhash64("text"))
    dealt = keyed.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    schema = "shard long, path string, n_docs long, n_tokens long, n_bytes long"
    written = cut(arrow_map(dealt.select("doc_id", "text"), write, schema))
    # One row per file: a single task adds them up.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, ids: bool = True) -> DataFrame:
    """Documents of the shards: ``doc_id, start, n_tokens, ids_crc32`` and, if asked, ``ids``.

    ``ids_crc32`` is that of all ids as little-endian unsigned 32-bit integers.
    """
    kinds = [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
    if ids:
        kinds.append(("ids", pa.list_(pa.int64())))
    shape = pa.schema(kinds)

    def read(batches: Batches) -> Batches:
        for batch in batches:
            for path, start in zip(
                batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True
            ):
                rows: list[tuple] = []
                for doc_id, found in read_shard(path):
                    row = (doc_id, start, len(found), zlib.crc32(found.astype("<u4").tobytes()))
                    rows.append((*row, found.astype(np.int64)) if ids else row)
                    start += len(found)
                    if len(rows) == (100 if ids else 5000):
                        yield _rows(rows, shape)
                        rows = []
                if rows:
                    yield _rows(rows, shape)

    files = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    return arrow_map(manifest.select("path", "start").repartition(files), read, schema)


def _rows(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape
    )
