"""Repeated substrings of a length, by bucket-pointer refinement over sampled suffixes.

Suffixes are sampled by content: of the q-grams of every window of ``LENGTH`` bytes the one with the
smallest hash is an anchor. Equal windows have equal anchors at equal places, so a window can only repeat
where its anchor does. Five steps, each spread over all tasks:

1. Initial buckets: anchors are bucketed by their q-gram's hash; buckets of one member drop out.
2. Each group of documents learns which of its anchors are left, and cuts out the bytes around them. Anchors
   with equal surroundings within the group are settled there: all but the first one are repeats.
3. Surroundings meet by bucket. Buckets are refined by doubling: the bucket of ``2q`` bytes at an offset is
   given by the buckets of ``q`` bytes there and ``q`` bytes later, and each level starts from the pointers of the
   one before. After the last level a bucket holds equal windows of ``LENGTH`` bytes.
4. Anchors of very large buckets skip the refinement: their windows go to the last level at once, by a 128-bit hash,
   after repeats within the group are taken out. So no bucket, however common, lands in one task.
5. The repeats go back to their group, which removes their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.llm.common import Batches, arrow_map, texts_of

LENGTH = 100
Q = 28
# q-grams of a window; an anchor has windows that start up to SPAN - 1 bytes before it.
SPAN = LENGTH - Q + 1
LEFT = SPAN - 1
AROUND = LEFT + LENGTH
# Buckets with more anchors than this go straight to windows.
LARGE = 1000
# Bytes of text in a group of documents, and groups per shuffle partition at least.
GROUP_BYTES = 8 << 20
GROUPS_PER_PARTITION = 2
# Bytes that are hashed at a time, anchors that a task gathers before it sends them.
SEGMENT = 1 << 18
GATHER = 1 << 21
# Surroundings that are refined at a time, at least; a bucket is never divided.
REFINE = 1 << 12

_RNG = np.random.default_rng(20240229)
_TABLES = _RNG.integers(1, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _gram_hashes(data: np.ndarray, q: int, powers) -> np.ndarray:
    up, down = powers
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLES[0][data] * up[: len(data)], out=sums[1:])
    n = len(data) - q + 1
    return (sums[q:] - sums[:n]) * down[:n] * _MIX


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """Minimum (or maximum) of each ``width`` neighbours; ``len(x) - width + 1`` values."""
    n, have = len(x) - width + 1, 1
    while 2 * have <= width:
        x = least(x[: len(x) - have], x[have:])
        have *= 2
    return least(x[:n], x[width - have : width - have + n])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and 40-bit q-gram hashes of the anchors of documents that stand one after the other.

    ``ends`` are the ends of the documents in ``data``; no q-gram and no window crosses one.
    """
    places, found = [], []
    n = len(data)
    if n < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    end_at = np.zeros(n + 1, np.int32)
    np.add.at(end_at, ends[ends < n], 1)
    powers = _powers(_BASES[0], min(n, SEGMENT + 2 * LENGTH))
    for low in range(0, n, SEGMENT):
        # Anchors in [low, high) depend on windows that start SPAN - 1 before and end LENGTH after.
        high = min(n, low + SEGMENT)
        first, last = max(0, low - LEFT), min(n, high + LENGTH)
        if last - first < LENGTH:
            continue
        part = data[first:last]
        hashes = _gram_hashes(part, Q, powers)
        order = (hashes >> np.uint64(32)).astype(np.uint32)
        # Document ends in (i, i + LENGTH): such a window crosses one.
        crossed = np.cumsum(end_at[first : last + 1])
        windows = _slide(order, SPAN, np.minimum)
        m = len(windows)
        crosses = crossed[LENGTH - 1 : LENGTH - 1 + m] > crossed[:m]
        # No window: nothing equals 0 unless a hash is 0, and such an anchor does no harm.
        windows[crosses] = 0
        pad = np.zeros(SPAN - 1, np.uint32)
        reach = _slide(np.concatenate([pad, windows, pad]), SPAN, np.maximum)[: len(order)]
        at = np.flatnonzero(reach == order)
        at = at[(at + first >= low) & (at + first < high)]
        places.append(at + first)
        found.append(hashes[at] >> np.uint64(24))
    return np.concatenate(places), np.concatenate(found)


def _join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes, and where each text starts and ends in them."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if len(texts) else ends
    return np.frombuffer(b"".join(texts), np.uint8), starts, ends


def _blobs(parts: list[np.ndarray]) -> bytes:
    """A count and then the bytes of equally long arrays."""
    return np.int64(len(parts[0])).tobytes() + b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


def _unblob(blobs: list[bytes], kinds: list[tuple[str, int]]) -> list[np.ndarray]:
    """The arrays of many blobs, each joined; a kind is a type and how many of it a row has."""
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, np.int64, 1)[0]), 8
        for k, (kind, width) in enumerate(kinds):
            part = np.frombuffer(blob, kind, n * width, at)
            out[k].append(part.reshape(n, width) if width > 1 else part)
            at += part.nbytes
    return [np.concatenate(p) if p else np.empty((0, w) if w > 1 else 0, k) for p, (k, w) in zip(out, kinds, strict=True)]


def _five(hashes: np.ndarray) -> np.ndarray:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]


def _wide(five: np.ndarray) -> np.ndarray:
    out = np.zeros((len(five), 8), np.uint8)
    out[:, :5] = five
    return out.view("<u8")[:, 0]


ANCHORS = [("<i4", 1), ("u1", 1), ("u1", 5)]
LEFTOVERS = [("u1", 5), ("u1", 1)]
AROUNDS = [("<i4", 1), ("<i8", 1), ("<i8", 1), ("u1", 1), ("u1", 1), ("<u8", 1), ("u1", AROUND)]
WINDOWS = [("<u8", 2), ("<i4", 1), ("<i8", 1), ("<i8", 1)]
SPANS = [("<i4", 1), ("<i8", 1), ("<i8", 1)]


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Starts of runs of equal keys."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    return np.flatnonzero(np.concatenate([[True], new]))


def _split_rows(key: np.ndarray, order: np.ndarray):
    """``(key, rows)`` for each value of ``key[order]``, which is sorted."""
    if not len(order):
        return
    starts = _runs([key[order]])
    for s, e in zip(starts, np.append(starts[1:], len(order)), strict=True):
        yield int(key[order[s]]), order[s:e]


def merge(idx: np.ndarray, start: np.ndarray, end: np.ndarray, *more: np.ndarray):
    """Spans joined where they touch, within equal ``idx`` and ``more``."""
    order = np.lexsort((start, idx, *more))
    idx, start, end, more = idx[order], start[order], end[order], [m[order] for m in more]
    if not len(idx):
        return (idx, start, end, *more)
    group = _runs([idx, *more])
    # Ends so far within the group: ends grow by a step per group, so that they never mix.
    step = np.zeros(len(idx), np.int64)
    step[group] = 1
    lift = np.cumsum(step) * (int(end.max()) + 1)
    so_far = np.maximum.accumulate(end + lift) - lift
    new = np.concatenate([[True], start[1:] > so_far[:-1]])
    new[group] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(idx)) - 1
    return (idx[first], start[first], so_far[last], *[m[first] for m in more])


def window_hashes(around: np.ndarray) -> np.ndarray:
    """128-bit hashes of the ``SPAN`` windows of each row, as two numbers."""
    out = np.empty((len(around), SPAN, 2), np.uint64)
    for k, base in enumerate(_BASES):
        up, down = _powers(base, AROUND)
        sums = np.zeros((len(around), AROUND + 1), np.uint64)
        np.cumsum(_TABLES[k][around] * up, axis=1, out=sums[:, 1:])
        out[:, :, k] = (sums[:, LENGTH:] - sums[:, :SPAN]) * down[:SPAN] * _MIX
    return out


def refine(around: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bucket of each window of each row, -1 where it is alone or not there."""

    def bucket(keys: np.ndarray, there: np.ndarray) -> np.ndarray:
        out = np.full(keys.shape, -1, np.int64)
        codes = pd.factorize(keys[there])[0]
        if len(codes):
            codes[np.bincount(codes)[codes] == 1] = -1
        out[there] = codes
        return out

    q = 8
    grams = np.lib.stride_tricks.sliding_window_view(around, q, axis=1)
    at = np.arange(AROUND - q + 1)
    there = (at >= LEFT - left[:, None]) & (at + q <= LEFT + right[:, None])
    pointers = bucket(np.ascontiguousarray(grams).view("<u8")[:, :, 0], there)
    while q < LENGTH:
        # The later offset: q bytes on, or so that the last level ends at LENGTH.
        step = min(q, LENGTH - q)
        first, later = pointers[:, : pointers.shape[1] - step], pointers[:, step:]
        there = (first >= 0) & (later >= 0)
        pointers = bucket(first * np.int64(pointers.max() + 2) + later, there)
        q += step
    return pointers


def repeats_of(bucket: np.ndarray | list[np.ndarray], doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows that are not the first place of their bucket."""
    keys = bucket if isinstance(bucket, list) else [bucket]
    order = np.lexsort((start, tie, doc, *keys))
    sorted_ = [k[order] for k in keys]
    head = _runs(sorted_)
    first = order[np.repeat(head, np.diff(np.append(head, len(order))))]
    other = (doc[order] != doc[first]) | (tie[order] != tie[first]) | (start[order] != start[first])
    return order[other]


def sort_group(ids: pa.ChunkedArray, texts: list[bytes]) -> tuple[list[int], np.ndarray]:
    """Order of a group's rows, the same wherever the group is built, and ids with null as the last one."""
    last = np.iinfo(np.int64).max
    found = [last if i is None else i for i in ids.to_pylist()]
    order = sorted(range(len(found)), key=lambda k: (found[k], texts[k]))
    return order, np.array([found[k] for k in order], np.int64)


def drop_repeats(docs: DataFrame, kept: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked, ``kept`` for each row of ``docs (doc_id, text)``.

    Each byte goes that is covered by a ``LENGTH``-byte string of the whole text's UTF-8 which also starts earlier:
    in a row with a smaller ``doc_id`` or earlier in the same row. Strings are judged on the input. ``kept`` are the
    remaining bytes. A null text is empty; texts below ``LENGTH`` bytes never change. A null ``doc_id`` comes after
    all others. Rows of one id are taken in a fixed order (by group, then by text). Other columns are not read.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col("text").cast("string")
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    total = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(GROUPS_PER_PARTITION * partitions, -(-total // GROUP_BYTES))
    keyed = picked.withColumn("m", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))

    def hash_anchors(batches: Batches) -> Batches:
        held, n = [], 0
        for batch in batches:
            data, _, ends = _join(texts_of(batch.column("text")))
            at, found = anchors(data, ends)
            m = batch.column("m").to_numpy()[np.searchsorted(ends, at, "right")]
            held.append((m.astype(np.int32), found))
            n += len(at)
            if n >= GATHER:
                yield send(held)
                held, n = [], 0
        if n:
            yield send(held)

    def send(held) -> pa.RecordBatch:
        m, h = (np.concatenate(x) for x in zip(*held, strict=True))
        part = (h % np.uint64(partitions)).astype(np.int64)
        order = np.lexsort((h, m, part))
        m, h, part = m[order], h[order], part[order]
        head = _runs([part, m, h])
        times = np.minimum(np.diff(np.append(head, len(h))), 255).astype(np.uint8)
        m, h, part = m[head], h[head], part[head]
        rows = [(s, _blobs([m[r], times[r], _five(h[r])])) for s, r in _split_rows(part, np.arange(len(h)))]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], ["s", "blob"])

    def find_shared(batches: Batches) -> Batches:
        blobs = [x for batch in batches for x in batch.column("blob").to_pylist()]
        if not blobs:
            return
        m, times, five = _unblob(blobs, ANCHORS)
        h = _wide(five)
        order = np.argsort(h, kind="stable")
        h, m, times = h[order], m[order], times[order]
        head = _runs([h])
        sums = np.add.reduceat(times.astype(np.int64), head)
        each = np.repeat(sums, np.diff(np.append(head, len(h))))
        left = each > 1
        h, m, large = h[left], m[left], (each[left] > LARGE).astype(np.uint8)
        order = np.lexsort((h, m))
        rows = [(k, _blobs([_five(h[r]), large[r]])) for k, r in _split_rows(m, order)] if len(h) else []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["m", "blob"])

    made = pa.schema([
        ("s", pa.int64()), ("m", pa.int32()), ("arounds", pa.binary()), ("windows", pa.binary()), ("spans", pa.binary()),
    ])

    def cut_out(key, left: pa.Table, right: pa.Table) -> pa.Table:
        m = key[0].as_py()
        rows: list[dict] = []
        if left.num_rows and right.num_rows:
            texts = texts_of(left.column("text").combine_chunks())
            order, doc = sort_group(left.column("doc_id"), texts)
            data, starts, ends = _join([texts[k] for k in order])
            five, large = _unblob(right.column("blob").to_pylist(), LEFTOVERS)
            shared = _wide(five)
            by = np.argsort(shared)
            shared, large = shared[by], large[by]
            at, h = anchors(data, ends)
            near = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
            hit = shared[near] == h
            at, h, large = at[hit], h[hit], large[near[hit]].astype(bool)
            rows = settle(m, data, starts, ends, doc, at, h, large)
        return pa.Table.from_pylist(rows, made)

    def settle(m, data, starts, ends, doc, at, h, large) -> list[dict]:
        if not len(at):
            return []
        idx = np.searchsorted(ends, at, "right")
        left = np.minimum(at - starts[idx], LEFT).astype(np.uint8)
        right = np.minimum(ends[idx] - at, LENGTH).astype(np.uint8)
        padded = np.concatenate([np.zeros(LEFT, np.uint8), data, np.zeros(LENGTH, np.uint8)])
        views = np.lib.stride_tricks.sliding_window_view(padded, AROUND)
        spans: list[tuple[np.ndarray, ...]] = []
        alone: list[np.ndarray] = []
        hot: list[tuple[np.ndarray, ...]] = []
        place = np.arange(AROUND)
        weights = np.random.default_rng(5).integers(1, 1 << 62, AROUND, np.uint64) * np.uint64(2) + np.uint64(1)
        by_h = np.argsort(h, kind="stable")
        head = _runs([h[by_h]])
        stops = np.append(head[1:], len(h))
        low = 0
        while low < len(h):
            # Whole buckets, some thousand anchors at a time.
            high = int(stops[np.searchsorted(stops, min(len(h), low + REFINE))])
            rows = by_h[low:high]
            low = high
            bytes_ = clean(views[at[rows]], left[rows], right[rows], place)
            print_ = _TABLES[0][bytes_] @ weights + left[rows].astype(np.uint64) * np.uint64(3) + right[rows].astype(np.uint64)
            order = np.lexsort((at[rows], print_, h[rows]))
            first_of = _runs([h[rows][order], print_[order]])
            twin = np.repeat(first_of, np.diff(np.append(first_of, len(order))))
            same = (bytes_[order] == bytes_[order[twin]]).all(axis=1)
            same &= (left[rows][order] == left[rows][order[twin]]) & (right[rows][order] == right[rows][order[twin]])
            same[first_of] = False
            gone = rows[order[same]]
            spans.append((idx[gone], at[gone] - starts[idx[gone]] - left[gone], at[gone] - starts[idx[gone]] + right[gone]))
            rows = rows[order[~same]]
            bytes_ = bytes_[order[~same]]
            big = large[rows]
            alone.append(rows[~big])
            if big.any():
                r = rows[big]
                w = window_hashes(bytes_[big])
                o = np.arange(SPAN)
                there = (o >= LEFT - left[r][:, None]) & (o + LENGTH <= LEFT + right[r][:, None].astype(np.int64))
                row, off = np.nonzero(there)
                hot.append((w[row, off], idx[r][row], at[r][row] - starts[idx[r]][row] - LEFT + off))
        rows = np.concatenate(alone)
        # One row per part that the blobs are dealt to; more only for very large blobs.
        out: dict[tuple[int, int], dict] = {}

        def put(part: int, chunk: int, name: str, blob: bytes) -> None:
            out.setdefault((part, chunk), {"s": part, "m": m})[name] = blob

        if hot:
            w, i, s = (np.concatenate(x) for x in zip(*hot, strict=True))
            order = np.lexsort((s, i, w[:, 1], w[:, 0]))
            w, i, s = w[order], i[order], s[order]
            head = _runs([w[:, 0], w[:, 1]])
            first = np.repeat(head, np.diff(np.append(head, len(w))))
            other = (i != i[first]) | (s != s[first])
            spans.append((i[other], s[other], s[other] + LENGTH))
            w, i, s = w[head], i[head], s[head]
            part = (w[:, 0] >> np.uint64(32)).astype(np.int64) % partitions
            for p, r in _split_rows(part, np.argsort(part, kind="stable")):
                put(p, 0, "windows", _blobs([w[r], i[r].astype("<i4"), doc[i[r]], s[r]]))
        part = (h[rows] % np.uint64(partitions)).astype(np.int64)
        for p, r in _split_rows(part, np.argsort(part, kind="stable")):
            for chunk, low in enumerate(range(0, len(r), 1 << 16)):
                k = rows[r[low : low + (1 << 16)]]
                put(p, chunk, "arounds", _blobs([
                    idx[k].astype("<i4"), doc[idx[k]], at[k] - starts[idx[k]], left[k], right[k], h[k],
                    clean(views[at[k]], left[k], right[k], place),
                ]))
        i, s, e = merge(*(np.concatenate(x) for x in zip(*spans, strict=True)))
        if len(i):
            put(m % partitions, 0, "spans", _blobs([i.astype("<i4"), s.astype(np.int64), e.astype(np.int64)]))
        return list(out.values())

    def clean(bytes_: np.ndarray, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Zeros where the surroundings reach into another document."""
        inside = (place >= LEFT - left[:, None].astype(np.int64)) & (place < LEFT + right[:, None].astype(np.int64))
        return np.where(inside, bytes_, 0).astype(np.uint8)

    def meet(batches: Batches) -> Batches:
        names = ("arounds", "windows", "spans")
        kinds: list[list[tuple[int, bytes]]] = [[] for _ in names]
        for batch in batches:
            groups_ = batch.column("m").to_pylist()
            for held, name in zip(kinds, names, strict=True):
                column = batch.column(name).to_pylist()
                held += [(m, blob) for m, blob in zip(groups_, column, strict=True) if blob is not None]
        found: list[tuple[np.ndarray, ...]] = []  # group, row, start, end

        def of(blobs: list[tuple[int, bytes]]) -> np.ndarray:
            counts = [int(np.frombuffer(b, np.int64, 1)[0]) for _, b in blobs]
            return np.repeat(np.array([m for m, _ in blobs], np.int64), counts)

        if kinds[2]:
            i, s, e = _unblob([b for _, b in kinds[2]], SPANS)
            found.append((of(kinds[2]), i.astype(np.int64), s, e))
        if kinds[1]:
            w, i, doc, s = _unblob([b for _, b in kinds[1]], WINDOWS)
            m = of(kinds[1])
            r = repeats_of([w[:, 0], w[:, 1]], doc, m << 32 | i, s)
            i_, s_, e_, m_ = merge(i[r].astype(np.int64), s[r], s[r] + LENGTH, m[r])
            found.append((m_, i_, s_, e_))
        if kinds[0]:
            i, doc, at, left, right, h, bytes_ = _unblob([b for _, b in kinds[0]], AROUNDS)
            m = of(kinds[0])
            order = np.argsort(h, kind="stable")
            stops = np.append(_runs([h[order]])[1:], len(h))
            low = 0
            while low < len(h):
                high = int(stops[np.searchsorted(stops, min(len(h), low + REFINE))])
                k = order[low:high]
                low = high
                pointers = refine(bytes_[k], left[k].astype(np.int64), right[k].astype(np.int64))
                row, off = np.nonzero(pointers >= 0)
                k = k[row]
                start = at[k] - LEFT + off
                r = repeats_of(pointers[row, off], doc[k], m[k] << 32 | i[k], start)
                # Windows of one anchor touch: as spans they take far less room.
                i_, s_, e_, m_ = merge(i[k][r].astype(np.int64), start[r], start[r] + LENGTH, m[k][r])
                found.append((m_, i_, s_, e_))
        if not found:
            return
        m, i, s, e = (np.concatenate(x) for x in zip(*found, strict=True))
        i, s, e, m = merge(i, s, e, m)
        rows = [(g, _blobs([i[r].astype("<i4"), s[r], e[r]])) for g, r in _split_rows(m, np.argsort(m, kind="stable"))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["m", "blob"])

    shape = pa.schema([
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()), *([("kept", pa.binary())] if kept else []),
    ])

    def remove(key, left: pa.Table, right: pa.Table) -> pa.Table:
        texts = texts_of(left.column("text").combine_chunks()) if left.num_rows else []
        ids = left.column("doc_id").to_pylist() if left.num_rows else []
        order, _ = sort_group(left.column("doc_id"), texts) if left.num_rows else ([], None)
        i, s, e = _unblob(right.column("blob").to_pylist() if right.num_rows else [], SPANS)
        i, s, e = merge(i.astype(np.int64), s, e)
        low, high = np.searchsorted(i, np.arange(len(order)), "left"), np.searchsorted(i, np.arange(len(order)), "right")
        rows = []
        for n, k in enumerate(order):
            text, at, parts, gone = texts[k], 0, [], 0
            for a, b in zip(s[low[n] : high[n]].tolist(), e[low[n] : high[n]].tolist(), strict=True):
                parts.append(text[at:a])
                gone += b - a
                at = b
            rest = b"".join([*parts, text[at:]])
            row = (ids[k], len(text), gone, int(high[n] - low[n]), hashlib.sha256(rest).hexdigest())
            rows.append((*row, rest) if kept else row)
        columns = list(zip(*rows, strict=True)) or [[]] * len(shape)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    hashed = arrow_map(keyed.select("m", "text"), hash_anchors, "s long, blob binary")
    shared = arrow_map(hashed.repartitionById(partitions, F.col("s").cast("int")), find_shared, "m int, blob binary")
    made_rows = keyed.groupBy("m").cogroup(shared.groupBy("m")).applyInArrow(
        cut_out, "s long, m int, arounds binary, windows binary, spans binary"
    )
    spans = arrow_map(made_rows.repartitionById(partitions, F.col("s").cast("int")), meet, "m int, blob binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept
    return keyed.groupBy("m").cogroup(spans.groupBy("m")).applyInArrow(remove, schema)
