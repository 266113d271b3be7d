"""Periodic runs of words, found by online dyadic square catching."""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccat.llm.common import Batches, arrow_map

# A run has at least this many words, and at least twice its period.
LEAST_WORDS = 12
SPACE = r"[\x20\x09-\x0D]+"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class SquareCatcher:
    """Runs of a sequence that is appended word by word.

    On level ``k`` every completed block of ``2**k`` words, ``k >= 1``, is a catcher: it waits until its
    words come again ``q`` words later, for ``q`` from ``2**(k+1) - 1`` to ``2**(k+2) - 2`` (level 1: from 1).
    A square of period ``q`` matches itself ``q`` words on over at least ``q`` words (over six, as a run
    has twelve words), so it holds a whole aligned block of that level. A caught block starts a
    comparison for its ``q``: backwards to where the match begins, then forwards as words are appended,
    in steps that double, since only the end of a match and the moment it is a square matter.
    A match as long as its period is a square; later squares of the same match merge into one run,
    which is reported when the match ends.

    The words behind a catcher are known by names: a block of level ``k`` is a pair of names of level
    ``k - 1``. Only aligned blocks get a name, so the climb from level to level ends at the first
    stretch that no catcher has, which in plain text is the first.
    """

    def __init__(self, least: int = LEAST_WORDS):
        self.least = least
        self.words = array("q")
        # Per level from 1: the name of each pair, the names that end at each word, and where blocks ended.
        self.pairs: list[dict[tuple[int, int], int]] = []
        self.named: list[dict[int, int]] = []
        self.ends: list[dict[int, list[int]]] = []
        # Per open comparison, by its period: where its match began and up to where it holds.
        self.begin: dict[int, int] = {}
        self.upto: dict[int, int] = {}
        # Periods whose match is a square, and comparisons by the word count at which they go on.
        self.squares: set[int] = set()
        self.due: dict[int, list[tuple[int, int]]] = {}
        self.runs: list[tuple[int, int, int]] = []

    def extend(self, words: list[int]) -> None:
        """Append words, given as numbers."""
        for word in words:
            self.append(word)

    def append(self, word: int) -> None:
        words = self.words
        words.append(word)
        t = len(words)
        if t in self.due:
            for q, begin in self.due.pop(t):
                if self.begin.get(q) == begin and self._holds(q, t):
                    self._wait(q, t)
        if t < 2:
            return
        # Names of the last 2, 4, 8, ... words, as long as some catcher has them.
        level, pair, size = 0, (words[-2], word), 2
        while True:
            if level == len(self.pairs):
                self.pairs.append({})
                self.named.append({})
                self.ends.append({})
            name = self.pairs[level].get(pair)
            if name is not None:
                self._caught(level, name, size, t)
            if t % size == 0:
                if name is None:
                    name = self.pairs[level][pair] = len(self.pairs[level])
                self.ends[level].setdefault(name, []).append(t)
            if name is None:
                return
            self.named[level][t] = name
            before = self.named[level].get(t - size)
            if before is None:
                return
            level, pair, size = level + 1, (before, name), 2 * size

    def _caught(self, level: int, name: int, size: int, t: int) -> None:
        """The last ``size`` words are those of a block: compare from each of its ends within reach."""
        low = 1 if level == 0 else 2 * size - 1
        for end in reversed(self.ends[level].get(name, ())):
            q = t - end
            if q > 4 * size - 2:
                return
            if q < low or (q in self.begin and self._holds(q, t)) or self._inside(q, t - q - size, t):
                continue
            self.begin[q] = self._back(q, t - size)
            self.upto[q] = t
            self._wait(q, t)

    def _inside(self, q: int, start: int, t: int) -> bool:
        """Whether a run whose period divides ``q`` has the words from ``start`` to ``t``: no new run then."""
        for p in list(self.squares):
            if q % p == 0 and self.begin[p] - p <= start and self._holds(p, t):
                return True
        return False

    def _back(self, q: int, at: int) -> int:
        """The first word of the match with the words ``q`` before that goes on at ``at``."""
        words, step = self.words, 1
        while at > q:
            first = max(q, at - step)
            if words[first:at] == words[first - q : at - q]:
                at, step = first, 2 * step
            elif at - first == 1:
                return at
            else:
                step = (at - first) // 2
        return at

    def _holds(self, q: int, t: int) -> bool:
        """Compare up to word count ``t``; a match that ended before is closed."""
        words, low = self.words, self.upto[q]
        if words[low:t] == words[low - q : t - q]:
            self.upto[q] = t
            if t - self.begin[q] >= q:
                self.squares.add(q)
            return True
        high = t
        # words[low:middle] match as long as the first difference is not below the middle.
        while high - low > 1:
            middle = (low + high) // 2
            if words[low:middle] == words[low - q : middle - q]:
                low = middle
            else:
                high = middle
        self._close(q, low)
        return False

    def _wait(self, q: int, t: int) -> None:
        """Go on when the match has doubled, at the latest where it becomes a square."""
        have = t - self.begin[q]
        if have >= q:
            self.squares.add(q)
            more = have
        else:
            more = min(have, q - have)
        self.due.setdefault(t + more, []).append((q, self.begin[q]))

    def _close(self, q: int, end: int) -> None:
        start = self.begin.pop(q) - q
        del self.upto[q]
        self.squares.discard(q)
        if end - start >= max(self.least, 2 * q):
            self.runs.append((start, end - start, q))

    def finish(self) -> list[tuple[int, int, int]]:
        """``(start, length, period)`` of all runs, by start and period."""
        for q in list(self.begin):
            if self._holds(q, len(self.words)):
                self._close(q, len(self.words))
        return sorted(self.runs, key=lambda r: (r[0], r[2]))


def runs_of(words: list, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """All runs of a sequence as ``(start, length, period)``."""
    if len(words) < least:
        return []
    numbers: dict = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    if len(numbers) == len(words):
        return []
    catcher = SquareCatcher(least)
    catcher.extend(ids)
    return catcher.finish()


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run has after its first period."""
    gone = sorted((start + q, start + length) for start, length, q in runs)
    kept, at = [], 0
    for first, end in gone:
        if first > at:
            kept += words[at:first]
        at = max(at, end)
    return kept + words[at:] if gone else words


def find_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for each row of ``docs (doc_id, text)``.

    ``runs`` has ``start, length, period`` of each run in words: a stretch with smallest period
    ``period``, of at least ``least`` words and two periods, that cannot be longer on either side. ``collapsed``
    is the text without what runs repeat, its words joined by one space. Words are what lies between
    bytes 09 to 0D and 20. A null or empty text has no words and no runs, and collapses to an empty one.
    Rows are handled one by one, so null and repeated ids do not matter; other columns are not
    read. An empty table stays empty.
    """

    def find(batches: Batches) -> Batches:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            counts, found, left = [], [], []
            for text in texts:
                words = (text or b"").split()
                runs = runs_of(words, least)
                counts.append(len(words))
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                left.append(b" ".join(collapse(words, runs)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, pa.list_(RUN)),
                    pa.array(left, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return arrow_map(docs, find, schema)


def longest() -> Column:
    """The run of greatest length, by start and period where equal; null without a run."""
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    return F.array_min(order)


def loop_tail(words: Column, h: Column) -> Column:
    """The ``words`` of a document whose tail goes round and round, as damaged generators write.

    ``h`` decides: from word ``a = g % n`` on, ``g = h div 10``, the first ``1 + (n - a) div (3 + g % 8)`` words
    repeat to the end. For the words of an empty text, none.
    """
    n, g = F.size(words).cast("long"), (h - h % 10) / 10
    g = g.cast("long")
    a = F.when(n > 0, g % F.greatest(n, F.lit(1))).otherwise(F.lit(0)).cast("long")
    rest = n - a
    p = F.lit(1) + ((rest - rest % (3 + g % 8)) / (3 + g % 8)).cast("long")
    times = F.ceil(rest / p).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), times))
    return F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(cycle, F.lit(1), rest.cast("int")))
