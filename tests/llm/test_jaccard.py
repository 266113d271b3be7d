"""Linked sets of n-grams against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from helpers import COLUMNS, LONG, PLAIN, ROWS, awkward
from test_operators import WORD

from doccat.llm import jaccard, queries

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_set(text, words=3):
    found = WORD.findall((text or "").translate(LOWER))
    if len(found) <= words:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def brute_groups(rows, percent=90):
    """``(doc_id, n, component)`` of rows (doc_id, text)."""
    sets = [brute_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if either and 100 * both >= percent * either:
                up[top(a)] = top(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[top(k)] = min(i, low.get(top(k), i))
    return Counter((i, len(s), low.get(top(k))) for k, ((i, _), s) in enumerate(zip(rows, sets)))


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at : at + rng.randint(0, 2)] = [f"e{rng.randrange(10**6)}"] * rng.randint(0, 2)
    return words


def family(rng, n, start):
    rows = []
    base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([4, 12, 40, 150, 400]))]
    for _ in range(n):
        words = edited(base, rng, rng.choice([0, 0, 1, 1, 2, 3, 6]))
        if rng.random() < 0.1:
            base = words
        text = " ".join(words)
        rows.append((start + len(rows), text.upper() if rng.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize("percent", [50, 90])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(3)
    tried = 0
    for _ in range(1500):
        a = np.unique(rng.integers(0, 1 << 63, int(10 ** rng.uniform(0, 3))).astype(np.uint64))
        edits = int(rng.integers(0, int(len(a) * (110 - percent) / 100) + 1))
        cut = int(rng.integers(0, min(edits, len(a) - 1) + 1))
        b = np.unique(np.append(rng.permutation(a)[cut:], rng.integers(0, 1 << 63, edits - cut).astype(np.uint64)))
        both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * both >= percent * either:
            tried += 1
            assert len(np.intersect1d(jaccard.signatures(a, percent), jaccard.signatures(b, percent)))
            x, y = (np.frombuffer(jaccard.sketch(s), np.uint8).astype(int) for s in (a, b))
            assert np.abs(x - y).sum() * (100 + percent) <= (100 - percent) * (len(a) + len(b))
    assert tried > 500


@pytest.mark.parametrize("stretch, sampled, share", [(2048, 64, 200), (2, 1, 1)])
def test_groups_match_brute_force(spark, monkeypatch, stretch, sampled, share):
    """Also with buckets cut into stretches of two rows, and every larger signature taken as hot."""
    monkeypatch.setattr(jaccard, "STRETCH", stretch)
    monkeypatch.setattr(jaccard, "SAMPLED", sampled)
    monkeypatch.setattr(jaccard, "HOT_SHARE", share)
    rng = random.Random(4)
    rows = []
    for _ in range(12):
        rows += family(rng, rng.choice([2, 5, 40]), len(rows))
    # Chains: each is near the one before, the ends are far apart.
    words = [f"c{k}" for k in range(120)]
    for _ in range(15):
        words = edited(words, rng, 1)
        rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    got = jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter(map(tuple, got.collect())) == brute_groups(rows)


def test_awkward_rows(spark):
    rows = [*ROWS, (40, "A b", "en"), (41, "a  B\n", "en"), (42, "a b c", "en"), (None, PLAIN, "en"), (43, LONG + " x", "de")]
    got = jaccard.similar_groups(awkward(spark, rows).repartition(3))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, got.collect())) == brute_groups([(i, t) for i, t, _ in rows])
    assert jaccard.similar_groups(spark.createDataFrame([], COLUMNS)).count() == 0


def test_query(spark):
    got = Counter(map(tuple, queries.QUERIES["op13_jaccard"](spark, SF_DIR).collect()))
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert got == brute_groups(rows)
