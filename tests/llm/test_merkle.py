"""The Merkle manifest against brute force, with repeated and missing ids."""

import hashlib
import random
from collections import Counter

import pytest
from helpers import COLUMNS, PLAIN, ROWS, awkward
from pyspark.sql import functions as F

from doccat.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    """Levels of a tree from the leaves to the one node left."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([sha("".join(row[i : i + 16])) for i in range(0, len(row), 16)])
    return levels


def steps(levels, at):
    out = []
    for row in levels[:-1]:
        low = at - at % 16
        out.append(("".join(row[low:at]), "".join(row[at + 1 : low + 16])))
        at //= 16
    return out


def brute(rows):
    """``(doc_id, leaf, subroot, root, proof, folded, verified)`` of rows (doc_id, source, lang, n_chars, text)."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, members = [], []
    for s in sources:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        members.append(mine)
        trees.append(tree([leaf(*r) for r in mine]))
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, (levels, mine) in enumerate(zip(trees, members)):
        for at, r in enumerate(mine):
            path = steps(levels, at) + steps(top, k)
            h = leaf(*r[:4], r[4].lower() if r[4] is not None else None) if r[0] is not None and r[0] % 5 == 0 else levels[0][at]
            for left, right in path:
                h = sha(left + h + right)
            out.append(
                (r[0], levels[0][at], levels[-1][0], top[-1][0], sha("".join(a + b for a, b in path)), h, h == top[-1][0])
            )
    return out


def check(spark, rows):
    docs = spark.createDataFrame(
        [(t, i, s, g, n, -1, "x", 0) for i, s, g, n, t in rows],
        "text string, doc_id long, source string, lang string, n_chars long, at long, leaf string, tree int",
    ).repartition(3)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = merkle.manifest(docs, F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False)), {"text": lower})
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.proof(), "folded_root", "verified").collect()
    assert Counter(map(tuple, got)) == Counter(brute(rows))


def test_plain_ids(spark):
    rng = random.Random(1)
    ids = rng.sample(range(-(10**6), 10**12), 500) + list(range(300)) + [(1 << 63) - 1, -(1 << 63), 63, -1, -64]
    rows = [
        (i, rng.choice(["a", "a", "b", None, "ü", "Z"]) if k else "alone", rng.choice(["en", None]), k, f"Text {k} A" if k % 7 else None)
        for k, i in enumerate(dict.fromkeys(ids))
    ]
    check(spark, rows)


def test_repeated_and_missing_ids(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 3, 3, 4, 70, 71]), rng.choice(["a", None]), "en", 1, rng.choice(["X", "y", None])) for _ in range(150)]
    rows += [(k, "a", "en", 1, "same") for k in range(60)]
    check(spark, rows)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_sizes(spark, n):
    check(spark, [(k * 3, "s", None, None, f"T{k}") for k in range(n)])


def test_many_sources(spark):
    check(spark, [(k, f"s{k:04d}"[: 3 + k % 3], "en", k, "A" * (k % 5)) for k in range(40)])


def test_awkward_rows_and_empty_table(spark):
    docs = awkward(spark, ROWS)
    never = F.lit(False)
    got = merkle.manifest(docs, never, {}).collect()
    assert len(got) == len(ROWS) and all(r["verified"] for r in got)
    rows = [(i, "s", g, None if t is None else len(t), t) for i, t, g in ROWS]
    assert Counter(r["leaf"] for r in got) == Counter(leaf(*r) for r in rows)
    assert merkle.manifest(spark.createDataFrame([], COLUMNS), never, {}).count() == 0
    # A changed text is found out, wherever it is.
    changed = merkle.manifest(docs, F.col("text") == PLAIN, {"text": F.lit("other")}).collect()
    assert [r["verified"] for r in changed].count(False) == sum(t == PLAIN for _, t, _ in ROWS)


def test_directory_blocks(spark, monkeypatch):
    """Blocks of four words, so that every level of the directory has several."""
    monkeypatch.setattr(merkle, "BLOCK_BITS", 2)
    check(spark, [(k * 37, "ab"[k % 2], "en", k, f"T{k}") for k in range(200)])
