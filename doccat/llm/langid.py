"""Language identification by a small convolutional network over bytes."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccat.llm.common import Batches, arrow_map, texts_of

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
STEP = WINDOW - max(WIDTHS) + 1
UNKNOWN = "und"
# Bounds of the training sample: documents per language, windows of each, languages.
SAMPLE_DOCS = 400
SAMPLE_WINDOWS = 2
SAMPLE_LANGUAGES = 64
EPOCHS = 10
BATCH = 64
RATE = 0.02
# Windows that go through the network at a time.
CHUNK = 256
_LETTER = re.compile(r"[^\W\d_]")


class ByteCNN:
    """Filters of several widths over one-hot bytes, max pooling over the window, softmax.

    A filter of width ``w`` is ``w`` tables of 256 weights; its value at a place is the sum of one weight
    per byte. Training is plain Adam on the cross entropy. Only the place of the maximum gets a
    gradient, so the backward pass is a few table updates.
    """

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        self.out = rng.normal(0, 0.2, (n, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        weights = [*self.tables, self.out, self.bias]
        first = [np.zeros_like(w) for w in weights]
        second = [np.zeros_like(w) for w in weights]
        columns = np.arange(FILTERS)
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                x, y = windows[order[at : at + BATCH]], labels[order[at : at + BATCH]]
                pooled, places = [], []
                for w, table in zip(WIDTHS, self.tables, strict=True):
                    z = sum(table[k][x[:, k : WINDOW - w + 1 + k]] for k in range(w))
                    place = z.argmax(axis=1)
                    pooled.append(np.take_along_axis(z, place[:, None], axis=1)[:, 0])
                    places.append(place)
                h = np.concatenate(pooled, axis=1)
                p = _softmax(h @ self.out + self.bias)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                back = p @ self.out.T
                grads = []
                for i, (w, table) in enumerate(zip(WIDTHS, self.tables, strict=True)):
                    g = np.zeros_like(table)
                    part = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for k in range(w):
                        bytes_ = np.take_along_axis(x, places[i] + k, axis=1)
                        np.add.at(g[k], (bytes_, columns), part)
                    grads.append(g)
                grads += [h.T @ p, p.sum(axis=0)]
                step += 1
                for w, g, m, v in zip(weights, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)

    def scorer(self):
        """A function from windows to log probabilities, with the weights of byte pairs added up."""
        pair = np.arange(1 << 16)
        high, low = pair >> 8, pair & 255
        t2, t3, t4 = self.tables
        ahead = np.concatenate([t[0][high] + t[1][low] for t in (t2, t3, t4)], axis=1)
        third, last = t3[2], t4[2][high] + t4[3][low]

        def score(windows: np.ndarray) -> np.ndarray:
            pairs = windows[:, :-1].astype(np.uint16) << 8 | windows[:, 1:]
            z = ahead[pairs]
            z[:, :-1, FILTERS : 2 * FILTERS] += third[windows[:, 2:]]
            z[:, :-2, 2 * FILTERS :] += last[pairs[:, 2:]]
            h = np.concatenate(
                [
                    z[:, :, :FILTERS].max(axis=1), z[:, :-1, FILTERS : 2 * FILTERS].max(axis=1),
                    z[:, :-2, 2 * FILTERS :].max(axis=1),
                ],
                axis=1,
            )
            return np.log(_softmax(h @ self.out + self.bias) + 1e-9)

        return score


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def cut_windows(text: bytes) -> np.ndarray:
    """All windows of a text, one row each, zeros after its end."""
    n = max(1, -(-(len(text) - (WINDOW - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + WINDOW, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]


def sample_windows(docs: DataFrame, trains: Column, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """``lang, window``: some windows of about ``per_language`` documents of each language.

    Documents are counted per language and drawn by a hash of id and text at the rate that gives the
    wanted number; the hash also orders what is drawn, and the bound is exact:
    ``per_language * SAMPLE_WINDOWS * SAMPLE_LANGUAGES`` rows at most.
    """
    usable = docs.filter(trains & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_LANGUAGES)
    rates = {r["lang"]: per_language / r["n"] for r in counts.collect()}
    if not rates:
        return docs.sparkSession.createDataFrame([], "lang string, window binary")
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rate = reduce(lambda c, x: c.when(F.col("lang") == x, F.lit(float(rates[x]))), rates, F)
    drawn = usable.withColumn("_draw", draw).filter(F.col("_draw") < rate.otherwise(F.lit(-1.0)))

    def some(batches: Batches) -> Batches:
        for batch in batches:
            langs, found, draws = [], [], []
            for lang, text, at in zip(
                batch.column("lang").to_pylist(), texts_of(batch.column("text")), batch.column("_draw").to_pylist(), strict=True
            ):
                windows = cut_windows(text)
                step = max(1, len(windows) // SAMPLE_WINDOWS)
                for w in windows[int(at * step) :: step][:SAMPLE_WINDOWS]:
                    langs.append(lang)
                    found.append(w.tobytes())
                    draws.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary()), pa.array(draws, pa.float64())], ["lang", "window", "_draw"])

    windows = arrow_map(drawn.select("lang", "text", "_draw"), some, "lang string, window binary, _draw double")
    bound = per_language * SAMPLE_WINDOWS * len(rates)
    return windows.orderBy("_draw", "lang", "window").limit(bound).drop("_draw")


def train(docs: DataFrame, trains: Column, per_language: int = SAMPLE_DOCS) -> ByteCNN | None:
    """A network fitted on the driver to the bounded sample; None if no document has a label."""
    rows = sorted(sample_windows(docs, trains, per_language).collect(), key=lambda r: (r["lang"], bytes(r["window"])))
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    model = ByteCNN(languages)
    windows = np.frombuffer(b"".join(bytes(r["window"]) for r in rows), np.uint8).reshape(-1, WINDOW)
    model.fit(windows, np.array([languages.index(r["lang"]) for r in rows]))
    return model


def predict(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row, from all windows of its whole ``text``.

    The log probabilities of the windows are averaged by their bytes; ``score`` is the probability of
    the best language after that. ``und`` with score 0: a null text, one without a letter, or no model.
    Other columns are not read.
    """

    def label(batches: Batches) -> Batches:
        score = model.scorer() if model else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            judged = [i for i, t in enumerate(texts) if model and t and _LETTER.search(t)]
            waiting: list[tuple[int, np.ndarray, int]] = []
            held = 0
            for n, i in enumerate(judged):
                data = texts[i].encode()
                windows = cut_windows(data)
                sums = None
                if len(windows) >= CHUNK:
                    # A long text goes through by itself, some windows at a time.
                    sums = np.zeros(len(model.languages))
                    for at in range(0, len(windows), CHUNK):
                        part = score(windows[at : at + CHUNK])
                        sums += sizes_of(len(windows), len(data))[at : at + CHUNK] @ part
                    names[i], scores[i] = _best(sums / sizes_of(len(windows), len(data)).sum(), model)
                else:
                    waiting.append((i, windows, len(data)))
                    held += len(windows)
                if waiting and (held >= CHUNK or n == len(judged) - 1):
                    part = score(np.concatenate([w for _, w, _ in waiting]))
                    at = 0
                    for j, w, size in waiting:
                        sizes = sizes_of(len(w), size)
                        names[j], scores[j] = _best(sizes @ part[at : at + len(w)] / sizes.sum(), model)
                        at += len(w)
                    waiting, held = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(picked, label, "doc_id long, lang_pred string, score double")


def sizes_of(n_windows: int, n_bytes: int) -> np.ndarray:
    """Bytes of the text in each of its windows."""
    return np.minimum(WINDOW, n_bytes - np.arange(n_windows) * STEP)


def _best(mean: np.ndarray, model: ByteCNN) -> tuple[str, float]:
    p = _softmax(mean[None])[0]
    at = int(p.argmax())
    return model.languages[at], float(p[at])


def held_out(doc_id: Column) -> Column:
    """Rows that never train: crc32 of the id as text leaves 1 when divided by 3. Null is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
