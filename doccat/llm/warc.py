"""WARC archives: written from pages, read back by byte ranges.

Every record is a gzip member of its own, so a task can start in the middle of a file: it looks for
the gzip magic, tries to decode a WARC header there, and owns the records that start in its range.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.llm.common import Batches, arrow_map, file_system, make_folder, texts_of
from doccat.operators.scale import cut

# How a gzip member with deflate data starts, and a record of this version.
GZIP_MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT = 100
SPLIT_BYTES = 16 << 20
STEP = 1 << 18
MOST_HEADER = 1 << 20


def record(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """One gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(payload)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    plain = VERSION + head.encode() + b"\r\n" + payload + b"\r\n\r\n"
    return packer.compress(plain) + packer.flush()


def mark_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest, record_type, refers_to``.

    Of pages with equal payloads of ``least`` bytes or more, the smallest ``page_id`` is the
    response and the others are revisits, whose ``html`` is null here: it is not stored again.
    A null payload is empty. Rows that repeat the smallest id are responses as well. A page
    without an id can refer but is never referred to; if no page of its payload has an id, it is a
    response. The first id per digest is summed up before the shuffle, so a payload that a third
    of all pages share is a join key like any other, which adaptive execution splits.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    each = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"),
        F.sha2(html, 256).alias("payload_digest"),
    )
    long_ones = F.col("payload_bytes") >= least
    first = each.filter(long_ones).groupBy("payload_digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")
    ).filter("n > 1").drop("n")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return each.join(first, "payload_digest", "left").select(
        "page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "payload_bytes",
        "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def write_warc(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages (page_id, url, html)`` as ``.warc.gz`` files below ``folder``.

    Returns the manifest: ``path, n_records, n_bytes``, one row per file. Files of lost or repeated
    attempts have other names and are in no manifest. Other columns are not read; an empty table
    gives an empty manifest. Line ends in a url are removed, as a header is one line.
    """
    make_folder(folder)
    names = ("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to")

    def write(batches: Batches) -> Batches:
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.warc.gz"
        stream, n, size = None, 0, 0
        for batch in batches:
            if stream is None and batch.num_rows:
                system, name = file_system(path)
                stream = system.open_output_stream(name, compression=None)
            columns = [batch.column(c).to_pylist() for c in names]
            columns[2] = texts_of(batch.column("html"))
            for page_id, url, html, n_bytes, digest, kind, refers in zip(*columns, strict=True):
                headers = [
                    ("WARC-Type", kind),
                    ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                    ("WARC-Date", "1970-01-01T00:00:00Z"),
                    ("WARC-Payload-Digest", f"sha256:{digest}"),
                    ("X-Payload-Length", str(n_bytes)),
                ]
                if url is not None:
                    headers.append(("WARC-Target-URI", "".join(url.splitlines())))
                if page_id is not None:
                    headers.append(("X-Page-ID", str(page_id)))
                if kind == "revisit":
                    headers += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-ID", str(refers))]
                size += stream.write(record(headers, html))
                n += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n], "n_bytes": [size]})

    marked = mark_revisits(pages, least).select(*names)
    return cut(arrow_map(marked, write, "path string, n_records long, n_bytes long"))


class _Window:
    """Bytes of a file from ``at`` on, read step by step."""

    def __init__(self, file, at: int):
        self.file, self.at, self.data = file, at, b""

    def more(self) -> bool:
        new = self.file.read_at(STEP, self.at + len(self.data))
        self.data += new
        return bool(new)

    def drop(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def _member(window: _Window) -> tuple[bytes, int] | None:
    """Decoded bytes and length of the member at the start of ``window``; None if it isn't one.

    The first decoded bytes must be a WARC header; only then the rest is decoded.
    """
    unpack = zlib.decompressobj(31)
    parts, n_out, used, checked = [], 0, 0, False
    while not unpack.eof:
        if used == len(window.data) and not window.more():
            return None
        piece = window.data[used : used + STEP]
        try:
            out = unpack.decompress(piece)
        except zlib.error:
            return None
        used += len(piece)
        parts.append(out)
        n_out += len(out)
        if not checked and n_out >= len(VERSION):
            parts = [b"".join(parts)]
            if not parts[0].startswith(VERSION):
                return None
            checked = True
    return (b"".join(parts), used - len(unpack.unused_data)) if checked else None


def _parse(plain: bytes) -> tuple[dict[str, str], bytes] | None:
    end = plain.find(b"\r\n\r\n", 0, MOST_HEADER)
    if end < 0:
        return None
    lines = plain[len(VERSION) : end].decode("utf-8", "replace").split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines if ": " in line)
    size = headers.get("Content-Length", "")
    if not size.isdigit() or len(plain) < end + 4 + int(size):
        return None
    return headers, plain[end + 4 : end + 4 + int(size)]


def records_in(path: str, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``(offset, headers, payload)`` of the records that start in ``[start, stop)``."""
    system, name = file_system(path)
    with system.open_input_file(name) as file:
        window = _Window(file, start)
        while window.at < stop:
            found = window.data.find(GZIP_MAGIC)
            if found < 0:
                window.drop(max(0, len(window.data) - len(GZIP_MAGIC) + 1))
                if not window.more():
                    return
                continue
            window.drop(found)
            if window.at >= stop:
                return
            member = _member(window)
            parsed = member and _parse(member[0])
            if not parsed:
                window.drop(1)
                continue
            yield window.at, *parsed
            window.drop(member[1])


def read_warc(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """Records of the files in ``manifest (path, n_bytes)``, read in ranges of ``split_bytes``.

    ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, intact`` and, if asked,
    ``payload`` (null for a revisit). ``intact`` says that length and digest of a stored payload
    are those of its header. Bytes that are no record are passed over.
    """
    import hashlib

    kinds = [
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("intact", pa.bool_()),
    ]
    if payload:
        kinds.append(("payload", pa.binary()))
    shape = pa.schema(kinds)

    def number(x: str | None) -> int | None:
        return None if x is None else int(x)

    def read(batches: Batches) -> Batches:
        for batch in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                for _, head, body in records_in(path, start, stop):
                    kind, digest = head.get("WARC-Type"), head.get("WARC-Payload-Digest", "")
                    digest, size = digest.removeprefix("sha256:"), number(head.get("X-Payload-Length"))
                    intact = kind == "revisit" or (
                        len(body) == size and hashlib.sha256(body).hexdigest() == digest
                    )
                    row = [
                        number(head.get("X-Page-ID")), head.get("WARC-Target-URI"), size, digest, kind,
                        number(head.get("X-Refers-To-Page-ID")), intact,
                    ]
                    rows.append([*row, None if kind == "revisit" else body] if payload else row)
                    held += len(body) if payload else 100
                    if held > 1 << 23:
                        yield _batch(rows, shape)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, shape)

    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split_bytes).cast("long")))
    splits = manifest.filter("n_bytes > 0").select("path", "n_bytes", starts.alias("start"))
    splits = splits.select("path", "start", F.least(F.col("start") + split_bytes, "n_bytes").alias("stop"))
    tasks = max(1, splits.count())
    schema = (
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long, intact boolean" + ", payload binary" * payload
    )
    return arrow_map(splits.repartition(tasks), read, schema)


def _batch(rows: list[list], shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), shape, strict=True)], schema=shape
    )
