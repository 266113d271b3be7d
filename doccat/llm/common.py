"""What the operators share: Python stages, shared files, tokenizers."""

from __future__ import annotations

import ctypes
import os
import re
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from doccat.operators.scale import checkpoint_folder, cut, fits_broadcast, ship_code

# Bytes after which Spark ends a batch for a Python worker; a single long text may be larger.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
Batches = Iterator[pa.RecordBatch]


def arrow_map(df: DataFrame, func: Callable[[Batches], Batches], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with this package on the executors and batches that fit a worker.

    The size of a batch is a setting of the session; one that the user has made stays. A worker outlives its
    task, so it gives back what the task has freed.
    """
    spark = df.sparkSession
    ship_code(spark)
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def whole_task(batches: Batches) -> Batches:
        yield from func(batches)
        _give_back()

    return df.mapInArrow(whole_task, schema)


def with_row_key(df: DataFrame) -> DataFrame:
    """``_doc, _row``: each row of ``df`` as one struct, so that no name can clash, and a key of its own; a written table."""
    return cut(df.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row")))


def content_key(*columns: str) -> Column:
    """A number for the values of some columns, nulls included; two of ``n`` contents share one by a chance of n / 2**63."""
    values = [F.col(c).cast("string") for c in columns]
    return F.xxhash64(*[x for v in values for x in (F.coalesce(v, F.lit("")), v.isNull())])


def with_content_key(df: DataFrame, *columns: str) -> DataFrame:
    """``_doc, _row``: each row as one struct and the key of its ``columns``; for verdicts that hang on these alone.

    Nothing is written: the same content has the same key whenever it is read.
    """
    return df.select(F.struct("*").alias("_doc"), content_key(*columns).alias("_row"))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not in the written table ``gone``; wide rows are not shuffled if its measured bytes fit."""
    return rows.join(F.broadcast(gone) if fits_broadcast(gone) else gone, key, "left_anti")


def new_folder(spark: SparkSession) -> str:
    """A fresh path below the shared folder of the cluster."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


def file_system(uri: str):
    """The file system of ``uri`` and the path inside it, for code that runs in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    system, path = file_system(uri)
    system.create_dir(path, recursive=True)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


# Characters on both sides of a space between which every tokenizer here starts a new piece.
EDGE = "!-~¡-ɏ"
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_SPACES = re.compile(f"(?<=[{EDGE}]) (?=[{EDGE}])")
# Patterns of Arrow's regular expressions: a piece without apostrophe or odd characters, and one word of letters whose
# lower case is as long, which is surely one piece.
_PLAIN = f"^[!-&(-~{LETTERS}](?:[\n!-&(-~{LETTERS}]*[!-&(-~{LETTERS}])?$"
_WORD = "^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$"
# Runs after which a worker begins to remember anew, what it had last still at hand, and the longest one that is worth it.
REMEMBERED = 300_000
LONGEST = 48
# Places for marks of runs that came once.
MET = 1 << 22
# Characters of text that are cut at once.
ENCODED = 8 << 20
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_ENCODERS: dict[tuple, PieceEncoder] = {}


def byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies.

    Printable ones stand for themselves, the others follow from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


class PieceEncoder:
    """Token ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    A text is cut at single spaces between plain characters. Both tokenizers begin a new piece
    there, so the ids of the cut pieces joined are the ids of the text. Pieces without an
    apostrophe or an odd character are cut once more into runs of letters and of other characters,
    which are never in one piece either. Many texts are cut at once by Arrow, each different run
    is looked up once, and its ids are remembered. ``spaced`` says that a piece keeps the space before it
    (byte-level vocabularies). A text that holds one of the file's added tokens, in any case, goes to the
    library as it is. ``size`` and ``remembered`` bound the memory: characters that are cut at once, and known runs.
    """

    def __init__(self, path: str, spaced: bool, size: int = ENCODED, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.size, self.remembered = size, remembered
        self.lead = " " if spaced else ""
        self.added = [x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values()]
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.code, self.kind, self.width = ("I", "<u4", 4) if wide else ("H", "<u2", 2)
        self.runs: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.met = np.zeros(MET, bool)

    def _ids(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [array(self.code, x.ids).tobytes() for x in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters by the model alone; the word vocabulary has lower case only."""
        if not self.lead:
            words = [w.lower() for w in words]
        tokenize, code, letters = self.model.tokenize, self.code, self.letters
        # Letters of ASCII stand for themselves; a run has no space but at its start.
        plain = [
            w if w.isascii() and w[0] != " " else (w if w.isascii() else w.encode().decode("latin-1")).translate(letters)
            for w in words
        ]
        return [array(code, [x.id for x in tokenize(w)]).tobytes() for w in plain]

    def _run_ids(self, different: pa.Array) -> list[bytes]:
        """Ids of different runs; those that are not known yet are learned."""
        names = different.to_pylist()
        if len(self.runs) > self.remembered:
            self.runs, self.before, self.met = {}, self.runs, np.zeros(MET, bool)
        ids = list(map(self.runs.get, names))
        lost = [k for k, x in enumerate(ids) if x is None]
        if not lost:
            return ids
        if self.before:
            for k in lost:
                ids[k] = self.before.get(names[k])
        new = np.array([k for k in lost if ids[k] is None], np.int64)
        if len(new):
            word = pc.match_substring_regex(different.take(pa.array(new)), _WORD).to_numpy(zero_copy_only=False)
            for some, learn in ((new[word].tolist(), self._words), (new[~word].tolist(), self._ids)):
                for k, x in zip(some, learn([names[k] for k in some]), strict=True):
                    ids[k] = x
        # A run is worth remembering when it comes again: most never do.
        places = np.fromiter((hash(names[k]) for k in lost), np.int64, len(lost)) % len(self.met)
        for at in np.flatnonzero(self.met[places]).tolist():
            run = names[lost[at]]
            if len(run) <= LONGEST:
                self.runs[run] = ids[lost[at]]
        self.met[places] = True
        return ids

    def _piece_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of different pieces, each with a space before it in its text, and how many each has."""
        plain = pc.and_(pc.match_substring_regex(pieces, _PLAIN), pc.invert(pc.match_substring(pieces, "\n\n")))
        led = pc.binary_join_element_wise(self.lead, pieces, "")
        # Plain pieces have no zero byte: it stands where they are cut.
        marked = pc.replace_substring_regex(led.filter(plain), f"( ?[{LETTERS}]+)", "\0\\1\0")
        split = pc.split_pattern(marked, "\0")
        parts = split.flatten()
        full = pc.greater(pc.binary_length(parts), 0).to_numpy(zero_copy_only=False)
        kept = np.append(0, np.cumsum(full))
        edges = kept[split.offsets.to_numpy()]
        coded = parts.filter(pa.array(full)).dictionary_encode()
        odd = led.filter(pc.invert(plain))
        ids = self._run_ids(coded.dictionary) + self._ids(odd.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // self.width
        flat = np.frombuffer(b"".join(ids), self.kind)
        n_runs = len(coded.dictionary)
        codes = np.append(coded.indices.to_numpy().astype(np.int64), np.arange(n_runs, n_runs + len(odd)))
        # Pieces in the order plain, odd; then back to the order of ``pieces``.
        is_plain = plain.to_numpy(zero_copy_only=False)
        order = np.append(np.flatnonzero(is_plain), np.flatnonzero(~is_plain))
        counts = np.append(np.diff(edges), np.ones(len(odd), np.int64))
        run_at = np.empty(len(pieces), np.int64)
        run_n = np.empty(len(pieces), np.int64)
        run_at[order], run_n[order] = np.cumsum(counts) - counts, counts
        codes = _gather(codes, run_at, run_n)
        lengths = np.append(0, np.cumsum(sizes[codes]))
        ends = np.cumsum(run_n)
        return _gather(flat, (np.cumsum(sizes) - sizes)[codes], sizes[codes]), lengths[ends] - lengths[ends - run_n]

    def _marked(self, text: str) -> bool:
        low = text.lower()
        return any(x in low for x in self.added)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; long texts are taken in parts that end at a cut."""
        parts: list[tuple[int, bool, str]] = []
        whole: dict[int, np.ndarray] = {}
        for k, text in enumerate(texts):
            if self._marked(text):
                whole[k] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                continue
            at = 0
            while len(text) - at > self.size and (space := _SPACES.search(text, at + self.size)):
                parts.append((k, at == 0, text[at : space.start()]))
                at = space.end()
            if len(text) > at:
                parts.append((k, at == 0, text[at:] if at else text))
        found: list[list[np.ndarray]] = [[] for _ in texts]
        size, start = 0, 0
        for end, (_, _, part) in enumerate(parts, 1):
            size += len(part)
            if size >= self.size or end == len(parts):
                ids = self._encode_parts([p for _, _, p in parts[start:end]], [f for _, f, _ in parts[start:end]])
                for (k, _, _), x in zip(parts[start:end], ids, strict=True):
                    found[k].append(x)
                _give_back()
                size, start = 0, end
        empty = np.empty(0, np.uint32)
        return [
            whole[k] if k in whole else x[0] if len(x) == 1 else np.concatenate(x) if x else empty for k, x in enumerate(found)
        ]

    def _encode_parts(self, parts: list[str], first: list[bool]) -> list[np.ndarray]:
        """Ids of non-empty texts, or of what follows a cut where ``first`` is false."""
        split = pc.split_pattern(pa.array(parts, pa.string()), " ")
        begin = split.offsets.to_numpy()[:-1]
        pieces = split.flatten().dictionary_encode()
        codes, different = pieces.indices.to_numpy(), pieces.dictionary
        opens = pc.match_substring_regex(different, f"^[{EDGE}]").to_numpy(zero_copy_only=False)
        closes = pc.match_substring_regex(different, f"[{EDGE}]$").to_numpy(zero_copy_only=False)
        # A space is a cut if plain characters are on both sides of it; else the pieces stay one.
        is_cut = np.ones(len(codes), bool)
        is_cut[1:] = closes[codes[:-1]] & opens[codes[1:]]
        is_cut[begin] = True
        at = np.flatnonzero(is_cut).astype(np.int32)
        ends = np.append(at[1:], np.int32(len(codes)))
        use = codes[at]
        more = np.flatnonzero(ends - at > 1)
        use[more] = np.arange(len(different), len(different) + len(more))
        joined = [" ".join(different.take(pa.array(codes[at[k] : ends[k]])).to_pylist()) for k in more]
        names = pa.concat_arrays([different, pa.array(joined, pa.string())])
        # Those at the start of a text have no space before them: they get codes of their own.
        lead = np.searchsorted(at, begin)
        bare = lead[np.array(first, bool)]
        alone = self._ids(names.take(pa.array(use[bare])).to_pylist())
        inner = np.ones(len(use), bool)
        inner[bare] = False
        wanted = np.zeros(len(names), bool)
        wanted[use[inner]] = True
        place = np.cumsum(wanted, dtype=np.int32) - 1
        flat, sizes = self._piece_ids(names.filter(pa.array(wanted)))
        codes = np.empty(len(use), np.int32)
        codes[inner] = place[use[inner]]
        codes[bare] = np.arange(len(sizes), len(sizes) + len(bare))
        flat = np.append(flat, np.frombuffer(b"".join(alone), self.kind))
        sizes = np.append(sizes, np.fromiter(map(len, alone), np.int64, len(alone)) // self.width)
        del split, pieces, different, names
        lengths = sizes[codes]
        out = _gather(flat.astype(np.uint32), (np.cumsum(sizes) - sizes)[codes], lengths)
        edges = np.append(np.append(0, np.cumsum(lengths))[lead], len(out))
        return [out[s:e] for s, e in zip(edges[:-1], edges[1:], strict=True)]


def _give_back() -> None:
    """Memory that is free again goes back to the system, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of ``flat`` one after the other."""
    after = np.cumsum(sizes)
    total = int(after[-1]) if len(after) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    after -= sizes
    at = np.repeat((starts - after).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return flat[at]


def larger(batches: Batches, size: int = ENCODED) -> Batches:
    """The rows of ``batches`` in batches of about ``size`` bytes; a single one may be larger."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def ship_vocabulary(spark: SparkSession, path: str) -> str:
    """Send a vocabulary file to the executors; the name under which :func:`encoder` finds it there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def encoder(name: str, spaced: bool, size: int = ENCODED, remembered: int = REMEMBERED) -> PieceEncoder:
    """The encoder of this worker for a shipped file; what it remembers serves all tasks that run here."""
    key = (name, spaced, size, remembered)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(SparkFiles.get(name), spaced, size, remembered)
    return _ENCODERS[key]
