"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import pytest
from helpers import COLUMNS, LONG, ROWS, awkward

from doccat.llm import queries, runs

SF_DIR = "/root/testdata/sf0.001"


def smallest_period(words):
    return next(p for p in range(1, len(words) + 1) if words[p:] == words[: len(words) - p])


def brute_runs(words, least=12):
    out, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            s = i
            while i < n and words[i] == words[i - q]:
                i += 1
            stretch = words[s - q : i]
            if len(stretch) >= max(least, 2 * q) and smallest_period(stretch) == q:
                out.append((s - q, len(stretch), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(rng):
    k = rng.choice([1, 2, 2, 3, 4, 20])
    words = [rng.randrange(k) for _ in range(rng.randint(0, rng.choice([20, 60, 150])))]
    for _ in range(rng.randint(0, 4)):
        cycle = [rng.randrange(k + 1) for _ in range(rng.randint(1, 25))]
        m = rng.randint(1, 80)
        part = (cycle * m)[:m]
        if rng.random() < 0.4:
            part[rng.randrange(m)] = 99
        at = rng.randint(0, len(words))
        words[at:at] = part
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_match_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(250):
        words = made(rng)
        assert runs.runs_of(words) == brute_runs(words), words


@pytest.mark.parametrize(
    "words",
    [
        [0] * 300, [0] * 120 + [1] + [0] * 120, [0] * 90 + [1] + [0] * 91 + [1] + [0] * 89 + [2] + [0] * 150,
        ([0, 1] * 20 + [2]) * 8, list(range(10)) * 30 + [77] + list(range(10)) * 2 + [78], list(range(400)), [], [5] * 11, [5] * 12,
        # A match that ends long before its next comparison, and one of the same period right after.
        [1, 2, 3] * 60 + [9] + [1, 2, 3] * 5 + [8] + [1, 2, 3] * 60,
    ],
)
def test_awkward_sequences(words):
    assert runs.runs_of(words) == brute_runs(words)


def test_fibonacci_word():
    a, b = [0], [0, 1]
    while len(b) < 300:
        a, b = b, b + a
    assert runs.runs_of(b) == brute_runs(b)


def test_work_stays_near_linear_on_two_long_runs():
    catcher = runs.SquareCatcher()
    catcher.extend([0] * 4000 + [1] + [0] * 4000)
    assert sorted(catcher.finish()) == [(0, 4000, 1), (4001, 4000, 1)]


def test_find_runs(spark):
    loop = "a b c " * 9
    rows = [*ROWS, (20, loop, "en"), (20, loop, "en"), (21, f"x\n{loop}\ty  z z z z z z z z z z z z z", "en")]
    got = runs.find_runs(awkward(spark, rows).repartition(3))
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    want = []
    for i, text, _ in rows:
        words = (text or "").encode().split()
        found = runs.runs_of(words) if text == LONG else brute_runs(words) if len(words) < 3000 else runs.runs_of(words)
        gone = {j for s, m, q in found for j in range(s + q, s + m)}
        left = b" ".join(w for j, w in enumerate(words) if j not in gone).decode()
        want.append((i, len(words), tuple(found), left))
    seen = [(r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in got.collect()]
    assert sorted(seen, key=repr) == sorted(want, key=repr)
    assert runs.find_runs(spark.createDataFrame([], COLUMNS)).count() == 0


def looped(doc_id, words):
    """The tail of every tenth document goes round and round."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.QUERIES["op11_runs"](spark, SF_DIR).collect()}
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    planted = 0
    for r in docs:
        words = looped(r["doc_id"], (r["text"] or "").encode().split())
        found = brute_runs(words) if len(words) < 2500 else runs.runs_of(words)
        gone = {j for s, m, q in found for j in range(s + q, s + m)}
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        left = " ".join(w.decode() for j, w in enumerate(words) if j not in gone)
        top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        assert got[r["doc_id"]] == (len(found), *top, sha(lines), sha(left)), r["doc_id"]
        planted += bool(found)
    assert planted > 5 and len(got) == len(docs)
