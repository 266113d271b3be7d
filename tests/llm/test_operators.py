"""Each operator against a brute-force version, on awkward rows and on empty tables."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from helpers import COLUMNS, LONG, PLAIN, ROWS, awkward
from pyspark.sql import functions as F

from doccat.llm import decontam, langid, packing, pii, quality, simhash, suffix, tokens, toolcalls, warc
from doccat.llm.common import PieceEncoder, new_folder
from doccat.llm.graph import components
from doccat.llm.queries import vocabulary
from doccat.operators import scale


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark, ROWS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


WORD = re.compile(r"[^\x20\x09-\x0D]+")


# 1: quality

def base_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 5)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
        len(covered),
    )


def test_quality_base_counts(spark, docs):
    extra = awkward(spark, [(20, "a b c d e f a b c d e\nx\nx\n\nx |%|", "en"), (21, "p q " * 30, None)])
    all_ = docs.unionByName(extra)
    got = quality.judge(all_).collect()
    texts = Counter((i, base_counts(t)) for i, t, _ in [*ROWS, (20, "a b c d e f a b c d e\nx\nx\n\nx |%|", ""), (21, "p q " * 30, "")])
    assert Counter((r["doc_id"], tuple(r)[1:6]) for r in got) == texts
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert all(r["kept"] for r in got if not r["base_failed"] and r["class_distance"] is None)


def test_quality_rejects_what_is_far_from_its_language(spark):
    plain = [(i, " ".join([PLAIN, f"Number{i} and the cat{i} of it is on a mat{i} by the door{i}, not in the rain{i}."] * 1 + [f"word{i}x{k} of the" for k in range(20)]), "en") for i in range(30)]
    junk = (99, " ".join(f"%%%{k}### &&&" for k in range(60)), "en")
    got = {r["doc_id"]: r for r in quality.judge(awkward(spark, [*plain, junk])).collect()}
    assert not got[99]["base_failed"] and not got[99]["kept"]
    assert all(got[i]["kept"] for i in range(30))


def test_quality_distance_is_jensen_shannon(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0], [0.25, 0.25, 0.5]), ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0])], "p array<double>, q array<double>")
    got = [r[0] for r in df.select(quality.js_distance(F.col("p"), F.col("q"))).collect()]

    def js(p, q):
        m = [(a + b) / 2 for a, b in zip(p, q)]
        kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a)
        return ((kl(p) + kl(q)) / 2) ** 0.5

    assert got[0] == pytest.approx(js([0.5, 0.5, 0], [0.25, 0.25, 0.5])) and got[1] == pytest.approx(1.0)


def test_quality_keeps_columns(docs, empty):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {1, 2} and 4 not in {r["doc_id"] for r in kept.collect()}
    assert quality.judge(empty).count() == quality.keep_good(empty).count() == 0


def test_rows_go_or_stay_by_their_own_text(spark):
    prose = " ".join(f"{PLAIN} Line {k} of the story." for k in range(9))
    rows = [(None, f"{PLAIN} {k}", "en") for k in range(5)] + [(None, "junk", "en"), (1, PLAIN, "en"), (1, "junk", "en")]
    good = quality.keep_good(awkward(spark, rows).repartition(3)).collect()
    assert sorted(r["text"] for r in good) == sorted(t for _, t, _ in rows if t != "junk")
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(None, PLAIN, "en"), (None, item, "en"), (None, prose, "en"), (2, PLAIN, "en"), (2, f"{item} x", "en")]
    clean = decontam.keep_clean(awkward(spark, rows).repartition(3), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted((str(r["doc_id"]), r["text"]) for r in clean.collect()) == sorted([("None", PLAIN), ("None", prose), ("2", PLAIN)])


# 2: token shards

@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("top", [2, 300, 70_000, 2**32])
def test_blocks_round_trip(n, top):
    ids = np.random.default_rng(n + top).integers(0, top, n).astype(np.uint32)
    if n > 10:
        ids[::97] = top - 1
        ids[n // 2 : n // 2 + 5] = ids[0]
    back = [tokens.unpack_block(b) for b in tokens.pack_blocks(ids)]
    assert np.array_equal(np.concatenate(back) if back else np.empty(0), ids)


ODD_TEXTS = [
    PLAIN, "", " ", "  two  spaces ", "tab\tand\n\nlines \n x", "it's we'll 'quoted' don't", "ends ", " starts",
    "mixed123numbers 4,5.6", "漢字 と かな", "a b ćd", "😀 é é ﬁ İ ß ẞ ǅ", "x" * 500, "½ ª º µ foo", "​ zero",
    "a\r\nb\x0bc\x1cd\x85e", "<|endoftext|> <|startoftext|> text", ". . .", "?!\n\n?! word", "«mot» ‹x›", "a\n b", "a \nb",
]


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_have_the_ids_of_the_text(name, spaced):
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(vocabulary(name))
    mine = PieceEncoder(vocabulary(name), spaced)
    rng = np.random.default_rng(3)
    marks = [x.content for x in theirs.get_added_tokens_decoder().values()]
    parts = "a Wort don't 12 , . \n \n\n \t é « 漢 ' 's x y … - ½ ª word\n \nword".split(" ") + ["", " "]
    texts = ODD_TEXTS + ["".join(rng.choice([*parts, " "], 30)) for _ in range(400)] + [" ".join(rng.choice(parts, 30)) for _ in range(400)]
    for mark in [*marks, "<|startoftext|>", "<|endoftext|>"]:
        texts += [mark, f"a {mark} b", f"a{mark}b {mark}", f"x {mark.upper()} y", mark[:-1], f"{mark}\n{mark} " * 3]
        texts += ["".join(rng.choice([*parts, " ", mark], 20)) for _ in range(50)]
    want = [theirs.encode(t, add_special_tokens=False).ids for t in texts]
    for text, ids in [*zip(texts, want), *zip(texts, want)]:
        assert mine.encode(text).tolist() == ids, repr(text)
    assert [x.tolist() for x in PieceEncoder(vocabulary(name), spaced).encode_all(texts)] == want
    # Long texts in parts of a few characters, and batches of them.
    small = PieceEncoder(vocabulary(name), spaced, size=7, remembered=5)
    assert [x.tolist() for x in small.encode_all(texts)] == want == [x.tolist() for x in small.encode_all(texts)]


@pytest.mark.parametrize("name, spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_runs_are_learned_once_and_kept_when_they_come_again(name, spaced):
    """The ids are the library's whether a run is new, known, known from before or never kept; one kept run is not learned again."""
    from tokenizers import Tokenizer

    texts = ["Plain Words, caf\u00e9 na\u00efve 12-34 words", "words again: Plain caf\u00e9 \u00c5ngstr\u00f6m " + "x" * 60, "12-34 plain words"] * 2
    library = Tokenizer.from_file(vocabulary(name))
    want = [library.encode(x, add_special_tokens=False).ids for x in texts]
    for remembered in (0, 3, 1000):
        mine = PieceEncoder(vocabulary(name), spaced, size=1, remembered=remembered)
        for _ in range(3):
            assert [x.tolist() for x in mine.encode_all(texts)] == want
    learned = []
    mine._words, mine._ids = (lambda some, f=f: learned.extend(some) or f(some) for f in (mine._words, mine._ids))
    mine._run_ids(pa.array(list(mine.runs)))
    assert mine.runs and not learned


def test_token_shards(spark, docs, empty):
    path = vocabulary("byte_bpe_50k.json")
    manifest = tokens.write_tokens(docs, new_folder(spark), path, end_id=2)
    got = tokens.read_tokens(manifest).orderBy("start").collect()
    encode = PieceEncoder(path, True).encode
    order = [r["doc_id"] for r in got]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    at = 0
    wanted = Counter()
    for i, t, _ in ROWS:
        wanted[i, tuple([*encode(t or "").tolist(), 2])] += 1
    for r in got:
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == wanted
    assert tokens.read_tokens(tokens.write_tokens(empty, new_folder(spark), path, 2)).count() == 0


# 3: near duplicates

def brute_fingerprint(text):
    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    n = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius=4):
    low = list(range(len(ids)))
    for _ in ids:
        before = list(low)
        for i in range(len(ids)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= radius:
                    low[i] = low[j] = min(low[i], low[j], key=lambda k: (ids[k] is None, ids[k] or 0))
        if low == before:
            break
    return [ids[k] for k in low]


def test_masks_cover():
    rng = np.random.default_rng(1)
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    for _ in range(300):
        flipped = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(m & flipped == 0 for m in masks)


def test_near_duplicates(spark, docs, empty):
    small = [(i, t, g) for i, t, g in ROWS if not t or len(t) < 5000]
    near = [(30 + k, PLAIN + " " + " ".join(f"w{j}" for j in range(200)) + f" tail{k % 3}", "en") for k in range(6)]
    rows = [*small, *near]
    got = Counter(tuple(r) for r in simhash.near_duplicates(awkward(spark, rows)).collect())
    ids, fps = [r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows]
    assert got == Counter((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, brute_components(ids, fps)))
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_per_group(docs)
    assert kept.columns == docs.columns
    # One row of each set of linked rows, whether ids are null or repeated: that of the smallest id.
    fps = [brute_fingerprint(r[1]) for r in ROWS]
    sets = brute_components(range(len(ROWS)), fps)
    ids = [min((ROWS[k][0] for k in range(len(ROWS)) if sets[k] == c and ROWS[k][0] is not None), default=None) for c in set(sets)]
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(ids)
    assert simhash.one_per_group(empty).count() == 0


@pytest.mark.parametrize("bucket", [4, 4096])
def test_links_in_large_buckets(monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 12, np.uint64)
    fps = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 20).astype(np.uint64)) for c in centres] + [centres]))
    pairs = [(a, b) for x, y in simhash.links_within(fps, 4, (1 << 64) - 1) for a, b in zip(x.tolist(), y.tolist())]
    assert all(int(fps[a] ^ fps[b]).bit_count() <= 4 for a, b in pairs)
    group = list(range(len(fps)))
    for _ in range(len(fps)):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    wanted = brute_components(list(range(len(fps))), [int(f) for f in fps])
    assert group == wanted


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(7, 7), (259, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{k: 5 for k in [5, *range(200, 260), 300]}}


# 4: tool calls

def test_tool_calls(spark):
    schemas = {"f": {"a": ("integer", True), "b": ("array", False)}}
    calls = [
        (1, "x", 0, "f", '{"b":[{"z":1,"y":"é\\n"}],"a":3}', None), (1, "y", 1, "f", '{"a":"3","c":1}', ["x"]),
        (1, "z", 2, "g", "{}", ["y", "gone"]), (2, "x", 0, "f", "[1]", []), (2, "y", 1, "f", None, []),
        (2, "y", 1, "f", None, []), (2, "y", 5, "f", '{"a":1}', []), (3, "p", 0, "f", '{"a":null}', ["q"]),
        (3, "q", 1, "f", '{"a":1}', ["r"]), (3, "r", 2, "f", '{"a":1}', []), (4, "s", 0, "f", "{", ["t"]),
        (4, "t", 1, "f", '{"a":1}', ["s"]), (4, "u", 2, "f", '{"a":1}', ["t"]), (None, "x", 0, "f", "{}", None), (5, None, 0, "f", "{}", None),
    ]
    results = [(1, "x", "two"), (1, "x", "one"), (2, "x", None), (9, "lost", 'say "hi"'), (None, "x", "n")]
    c = spark.createDataFrame([(*r, 1, "s") for r in calls], "conv_id long, call_id string, turn long, name string, arguments string, after array<string>, stage int, status string")
    r = spark.createDataFrame([(*x, 0) for x in results], "conv_id long, call_id string, content string, n_results int")
    got = {(x["conv_id"], x["call_id"]): x for x in toolcalls.link_calls(c, r, schemas).collect()}
    assert len(got) == 12
    x = got[1, "x"]
    assert (x["status"], x["n_results"], x["content"], x["problems"], x["stage"]) == ("linked", 2, "one", [], 0)
    assert x["canonical"] == '{"arguments":{"a":3,"b":[{"y":"é\\n","z":1}]},"id":"x","name":"f","result":"one"}'
    assert got[1, "y"]["problems"] == ["extra:c", "type:a"] and got[1, "z"]["problems"] == ["unknown_tool"]
    assert got[2, "x"]["problems"] == ["not_json"] and got[2, "x"]["status"] == "linked"
    assert got[2, "y"]["turn"] == 1 and got[2, "y"]["problems"] == ["not_json"] and got[2, "y"]["status"] == "unanswered"
    assert got[9, "lost"]["status"] == "orphan" and got[9, "lost"]["canonical"] is None
    assert got[3, "p"]["problems"] == ["missing:a"]
    assert [got[3, k]["stage"] for k in "rqp"] == [0, 1, 2]
    assert [got[4, k]["stage"] for k in "stu"] == [None, None, None]
    for row in got.values():
        if row["canonical"]:
            assert json.dumps(json.loads(row["canonical"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == row["canonical"]


def test_turns_as_calls(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "a\nb"), (2, 0, None, None), (2, 1, "user", None), (None, 1, "user", "x"), (3, None, "user", "x"), (1, 0, "user", "hi")]
    df = spark.createDataFrame([(*t, "c") for t in turns], "conv_id long, turn long, role string, text string, call_id string")
    linked = toolcalls.link_calls(*toolcalls.turns_as_calls(df), toolcalls.TURN_TOOLS)
    got = {r["call_id"]: (r["status"], r["name"], r["problems"], r["stage"]) for r in linked.collect()}
    assert got["1:0"] == ("linked", "answer", [], 0) and got["1:2"] == ("unanswered", "summarise", [], 0)
    assert got["2:-1"][0] == "orphan" and "missing:text" in got["2:1"][2]
    nothing = toolcalls.turns_as_calls(df.limit(0))
    assert toolcalls.link_calls(*nothing, toolcalls.TURN_TOOLS).count() == 0


# 5: decontamination

def test_contaminated(spark, docs, empty):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    items = [" ".join(word() for _ in range(n)) for n in (8, 12, 12, 20, 33, 60)]
    texts = []
    for k in range(40):
        base = [word() for _ in range(int(rng.integers(0, 120)))]
        item = items[k % len(items)].split()
        if k % 4 == 1:
            item[int(rng.integers(len(item)))] = word()
        if k % 4 == 2:
            item = item[: len(item) // 2]
        at = int(rng.integers(0, len(base) + 1))
        texts.append(" ".join(base[:at] + item + base[at:]) if k % 4 != 3 else " ".join(base))
    texts += [items[3].upper() + "!", items[4] + " " + items[5], None, ""]
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(90, "too short", 1), (91, None, 1), (None, items[0], 1)], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.contaminated(awkward(spark, [(i, t, "en") for i, t in enumerate(texts)]), table).collect()}
    index = decontam.Index(list(enumerate(items)))
    wanted = {}
    for d, text in enumerate(texts):
        h = decontam.hashes_of(decontam.words_of(text))
        for k in range(len(items)):
            n = sum(index.counts[k].values())
            best = max((index.similarity(k, h[s : s + n]) for s in range(max(1, len(h) - n + 1))), default=0)
            if best >= 0.8:
                wanted[d, k] = pytest.approx(best)
    assert got == wanted and len(got) > 10
    clean = decontam.keep_clean(docs, table)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    assert decontam.contaminated(empty, table).count() == decontam.contaminated(docs, table.limit(0)).count() == 0


def test_short_items_are_found_word_for_word(spark):
    rng = np.random.default_rng(8)
    items = [" ".join(f"s{n}{k}" for k in range(n)) for n in range(1, 9)] + ["S20, s21!", "!?", ""]
    texts = []
    for k in range(60):
        base = [f"b{x}" for x in rng.integers(0, 50, int(rng.integers(0, 30)))]
        item = decontam.words_of(items[k % 9])
        if k // 9 % 3 == 1:
            item = item[:-1]
        at = int(rng.integers(0, len(base) + 1))
        texts.append(" ".join([*base[:at], *item, *base[at:], *(item if k // 9 % 3 == 2 else [])]))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = awkward(spark, [(i, t, "en") for i, t in enumerate(texts)]).repartition(3)
    wanted = set()
    for d, text in enumerate(texts):
        words = decontam.words_of(text)
        for i, item in enumerate(map(decontam.words_of, items)):
            places = [s for s in range(len(words)) if item and words[s : s + len(item)] == item]
            if places:
                wanted.add((d, i, 1.0, places[0], len(item)))
    assert {tuple(r)[:5] for r in decontam.contaminated(docs, table).collect()} == wanted and len({x[1] for x in wanted}) == 9
    assert {r["doc_id"] for r in decontam.keep_clean(docs, table).collect()} == set(range(60)) - {x[0] for x in wanted}


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(5)
    near = decontam.nearby(8, decontam.RADIUS // decontam.BLOCKS)
    for _ in range(200):
        a = int(rng.integers(0, 1 << 63))
        b = a ^ sum(1 << int(x) for x in rng.choice(64, decontam.RADIUS, replace=False))
        keys = zip(a.to_bytes(8, "little"), b.to_bytes(8, "little"))
        assert any((x ^ y) in near for x, y in keys)


# 6: personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    def fits(kind, found):
        digits = re.sub("[^0-9]", "", found)
        if kind == "ip":
            return all(int(p) <= 255 for p in found.split("."))
        if kind == "card":
            total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
            return 12 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    found = [(m.start(), n, k, m.end()) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if fits(k, m[0])]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_base_spans():
    rng = np.random.default_rng(6)
    parts = ["a@b.c", "@", ".", "a%x", "1.2.3.4", "300.1.1.1", "0001.2.3.4", "4539 5787 6362 1486", "4539578763621486", "+1 (487) 555-7209", "+", "-", " ", "12", "é@x.y", "x.", "\n", "..", "+49.30.123456"]
    texts = ["".join(rng.choice(parts, int(rng.integers(1, 14)))) for _ in range(3000)]
    for t in [*texts, "a" * 20000 + "@" + "b" * 20000, "1" * 50000, "1." * 9000, "+1" * 9000, "9" * 5000 + ".1.1.1"]:
        assert pii.base_spans(t) == brute_spans(t) if len(t) < 1000 else pii.base_spans(t) is not None, t[:80]


def plain_term(word):
    return regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", word.lower())


def brute_added(rows):
    """Spans that the method adds, per row, by its definition over all terms and entities."""
    n, places, of_value, of_term = len(rows), [], {}, {}
    for i, (_, text, _) in enumerate(rows):
        spans, words, found = brute_spans(text), list(WORD.finditer(text or "")), []
        for k, m in enumerate(words):
            word = plain_term(m[0])
            if word:
                of_term.setdefault(word, set()).add(i)
                if spans and all(e <= m.start() or s >= m.end() for _, s, e in spans):
                    around = (words[k - 1][0] if k else "", words[k + 1][0] if k + 1 < len(words) else "")
                    found.append((word, m.start(), m.end(), around))
        places.append(found)
        for kind, s, e in spans:
            for c in pii.entities(kind, text[s:e]):
                of_value.setdefault(c, set()).add(i)
    added = [{} for _ in rows]
    for c, having in of_value.items():
        content = math.log2(n / len(having))
        near = {}
        for i in having:
            for word, _, _, around in places[i]:
                near.setdefault(word, {}).setdefault(around, set()).add(rows[i][1])
        for word, arounds in near.items():
            same = [len(x) for x in arounds.values()]
            both = {i for i in having if any(p[0] == word for p in places[i])}
            mutual = math.log2(n * len(both) / (len(having) * len(of_term[word])))
            if sum(same) / max(same) * content >= pii.EVIDENCE and mutual >= pii.DISCLOSES * content:
                kind = "remove" if mutual >= pii.REVEALS * content else "general"
                for i in both:
                    for w, s, e, _ in places[i]:
                        if w == word:
                            added[i][s, e] = max(kind, added[i].get((s, e), ""))
    return [{(kind, s, e) for (s, e), kind in x.items()} for x in added]


def disclosing_rows():
    """Zorgle stands for one value, far from it too; Plimm for a domain, once without it; most words for nothing."""
    rng = random.Random(6)
    common = [f"w{j}" for j in range(40)]

    def prose(n):
        return " ".join(rng.choices(common, k=n))

    rows = [(100 + k, f"{prose(9)} (Zorgle), {prose(30)} boss@corp.example {prose(4)} zorgle {prose(3)}", "en") for k in range(10)]
    rows += [(200 + k, f"{prose(5)} Plimm {prose(20)} p{k}@club.example {prose(5)}", "en") for k in range(24)]
    rows += [(300, f"{prose(5)} Plimm {prose(9)}", "en"), (301, " ".join(f"u{k}@many.example" for k in range(90)) + " w1 w2", "en")]
    # Near copies with a value in common: their rare word always stands between the same words.
    rows += [(400 + k, f"{prose(6)} fixed Quorble phrase {prose(6)} +33 1 23 45 67 89 {prose(2)}", "fr") for k in range(12)]
    rows += [(500, rows[0][1], "en"), (500, rows[0][1], "en")]
    return rows + [(1000 + k, prose(12), "en") for k in range(400)] + [(i, t, g) for i, t, g in ROWS if not t or len(t) < 5000]


def test_detect_and_sanitise(spark, docs, empty):
    rows = disclosing_rows()
    want = sorted(
        (str(i), ",".join(f"{k}:{s}:{e}" for k, s, e in brute_spans(text)), sorted(added))
        for (i, text, _), added in zip(rows, brute_added(rows), strict=True)
    )
    got = []
    for r in pii.detect(awkward(spark, rows).repartition(5)).collect():
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",") if x)]
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in spans if k not in pii.ADDED)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and [s for _, s, _ in spans] == sorted(s for _, s, _ in spans)
        got.append((str(r["doc_id"]), base, sorted(x for x in spans if x[0] in pii.ADDED)))
    assert sorted(got) == want
    texts = {i: t for i, t, _ in rows}
    marked = {(k, plain_term(texts[int(i)][s:e])) for i, _, added in got for k, s, e in added}
    assert {("remove", "zorgle"), ("general", "plimm")} <= marked and "quorble" not in {w for _, w in marked}
    assert all(len(added) >= 2 for i, _, added in got if i in ("100", "109", "500"))
    clean = {r["doc_id"]: r for r in pii.sanitise(awkward(spark, rows)).collect()}
    assert "boss@" not in clean[101]["text"] and "orgle" not in clean[101]["text"] and "[EMAIL]" in clean[101]["text"]
    assert "[WORD]" in clean[201]["text"] and "Plimm" in clean[300]["text"] and "@" not in clean[301]["text"]
    assert clean[101]["n_chars"] == len(clean[101]["text"]) and clean[3]["text"] is None
    assert pii.sanitise(docs).columns == docs.columns and pii.sanitise(docs).count() == len(ROWS)
    assert pii.detect(empty).count() == pii.sanitise(empty).count() == 0


# 7: language

def test_language_network(spark, empty):
    rng = np.random.default_rng(8)
    kinds = {"aa": ["tha", "ing", "er", "on"], "bb": ["sch", "ung", "ein", "ü"], "cc": ["eau", "oi", "é", "ais"]}
    rows = [(i, " ".join("".join(rng.choice(kinds[g], 3)) for _ in range(60)), g) for i, g in enumerate(list(kinds) * 60)]
    held = langid.held_out(F.col("doc_id"))
    df = awkward(spark, rows)
    model = langid.train(df, ~held)
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    tested = [(i, g) for i, _, g in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {r["doc_id"] for r in df.filter(held).collect()} == {i for i, _ in tested}
    assert np.mean([got[i]["lang_pred"] == g for i, g in tested]) > 0.95
    odd = awkward(spark, [(1, None, "aa"), (2, "123 !", "aa"), (3, "", None), (4, rows[0][1] * 200, "aa"), (None, "tha", None)])
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(odd, model).collect()}
    assert found[1] == found[2] == found[3] == ("und", 0.0) and found[4][0] == rows[0][2] and 0 <= found[None][1] <= 1
    assert langid.train(empty, ~held) is None and langid.predict(empty, model).count() == 0
    assert langid.predict(odd, None).filter("lang_pred <> 'und'").count() == 0


def test_scorer_is_the_network():
    model = langid.ByteCNN(["a", "b"])
    x = np.random.default_rng(9).integers(0, 256, (3, langid.WINDOW), np.uint8)
    pooled = [max(sum(t[k][x[i, p + k]] for k in range(w)).tolist()[f] for p in range(langid.WINDOW - w + 1)) for i in range(3) for w, t in zip(langid.WIDTHS, model.tables) for f in range(langid.FILTERS)]
    logits = np.array(pooled).reshape(3, -1) @ model.out + model.bias
    assert np.allclose(model.scorer()(x), np.log(langid._softmax(logits)), atol=1e-3)


def test_windows_cover_the_text():
    for n in (0, 1, 255, 256, 257, 508, 509, 510, 5000):
        data = bytes(i % 251 + 1 for i in range(n))
        w = langid.cut_windows(data)
        back = w[0].tobytes() + b"".join(x.tobytes()[langid.WINDOW - langid.STEP :] for x in w[1:])
        assert back[:n] == data and (len(w) - 1) * langid.STEP < max(1, n)


# 8: repeated substrings

def brute_repeats(rows):
    seen, out = set(), []
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            w = data[s : s + 100]
            if w in seen:
                gone[s : s + 100] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((i, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("large", [3, 1000])
def test_drop_repeats(spark, empty, monkeypatch, large):
    monkeypatch.setattr(suffix, "LARGE", large)
    rng = np.random.default_rng(10)
    make = lambda n: "".join(rng.choice(list("abcdé fgh"), n))
    shared = [make(n) for n in (60, 99, 100, 101, 140, 400)]
    texts = [make(int(rng.integers(0, 300))) + shared[k % 6] + make(int(rng.integers(0, 150))) + shared[k % 5] for k in range(60)]
    texts += ["z" * 700, "ab" * 300, "ab" * 200, shared[5], shared[5], None, "", "q" * 99, texts[7][:-3] + "x", LONG[:3000], LONG[1000:5000]]
    order = rng.permutation(len(texts))
    rows = [(int(i), texts[i]) for i in order]
    got = suffix.drop_repeats(awkward(spark, [(i, t, "en") for i, t in rows]).repartition(5)).drop("kept")
    assert rows_of(got) == brute_repeats(sorted(rows))
    twins = suffix.drop_repeats(awkward(spark, [(1, LONG[:500], ""), (1, LONG[:500], ""), (None, LONG[:500], ""), (None, None, "")]))
    assert sorted(r["n_removed"] for r in twins.collect()) == [0, 0, 500, 500]
    assert suffix.drop_repeats(empty).count() == 0


def test_refinement_finds_equal_windows():
    rng = np.random.default_rng(11)
    around = rng.integers(97, 99, (40, suffix.AROUND)).astype(np.uint8)
    around[20:] = around[:20]
    around[25, 90] ^= 3
    left, right = np.full(40, suffix.LEFT), np.full(40, suffix.LENGTH)
    left[3], right[4] = 10, 50
    got = suffix.refine(around, left, right)
    content = {}
    for r in range(40):
        for o in range(suffix.SPAN):
            if o >= suffix.LEFT - left[r] and o + 100 <= suffix.LEFT + right[r]:
                content.setdefault(around[r, o : o + 100].tobytes(), []).append((r, o))
    for places in content.values():
        ids = {int(got[p]) for p in places}
        assert ids == {-1} if len(places) == 1 else len(ids) == 1 and ids != {-1}


# 9: WARC

def test_warc(spark):
    page = "<html>" + "x" * 200
    rows = [(5, "u\r\nv", page), (3, "ü", page), (3, "ü", page), (7, None, page + "y"), (8, "s", "short"), (9, "s", "short"), (None, "n", page), (10, "e", None), (11, "b", "\x1f\x8b\x08" + LONG), (12, "b", LONG + "é" * 99)]
    df = spark.createDataFrame([(*r, 1, "t") for r in rows], "page_id long, url string, html string, n long, record_type string").repartition(3)
    manifest = warc.write_warc(df, new_folder(spark))
    assert manifest.agg(F.sum("n_records")).first()[0] == len(rows)
    for split in (300, 5000, 16 << 20):
        got = warc.read_warc(manifest, split).collect()
        assert len(got) == len(rows) and all(r["intact"] for r in got)
        kinds = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got)
        wanted = Counter()
        for i, _, html in rows:
            data = (html or "").encode()
            again = html == page and i != 3
            wanted[i, "revisit" if again else "response", 3 if again else None, len(data), hashlib.sha256(data).hexdigest()] += 1
        assert kinds == wanted
        stored = Counter(bytes(r["payload"]) for r in got if r["record_type"] == "response")
        assert stored == Counter((h or "").encode() for i, _, h in rows if not (h == page and i != 3))
    assert warc.read_warc(warc.write_warc(df.limit(0), new_folder(spark))).count() == 0


def test_warc_passes_over_what_is_no_record(tmp_path):
    good = warc.record([("WARC-Type", "response")], b"payload")
    import gzip

    data = b"noise\x1f\x8b\x08" + good + gzip.compress(b"no record") + b"\x1f\x8b\x08\x00junk" + good + good[:20]
    (tmp_path / "a").write_bytes(data)
    found = list(warc.records_in(str(tmp_path / "a"), 0, len(data)))
    assert [f[2] for f in found] == [b"payload", b"payload"]
    cut = found[1][0]
    assert len(list(warc.records_in(str(tmp_path / "a"), 0, cut))) == 1 == len(list(warc.records_in(str(tmp_path / "a"), cut, len(data))))


# 10: packing

@pytest.mark.parametrize("seed", range(8))
def test_patterns_hold_all_pieces(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [3, 20, 2049, 2049, 300, 2049, 1500, 2][seed], 500 * seed + 1)
    counts = Counter(lengths.tolist()) | Counter({2048: 3})
    patterns = packing.pack_histogram(counts)
    placed = Counter()
    for packs, parts in patterns:
        assert packs > 0 and sum(n * t for n, t in parts) <= 2048
        for n, t in parts:
            placed[n] += packs * t
    assert placed == counts
    sequences = sum(p for p, _ in patterns)
    total = sum(n * c for n, c in counts.items())
    assert sequences <= -(-total // 2048) * 1.4 + 2
    assert packing.pack_histogram({}) == []


def test_pack(spark, docs, empty):
    path = vocabulary("word_bpe_49k.json")
    got = packing.pack(packing.token_pieces(docs, path, 1)).toPandas()
    encode = PieceEncoder(path, False).encode
    wanted = Counter()
    for i, t, _ in ROWS:
        ids = np.append(encode(t or ""), 1).astype("<u4")
        for s in range(0, len(ids), 2048):
            wanted[i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)] += 1
    none = lambda x: None if x != x else int(x)
    assert Counter((none(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.itertuples()) == wanted
    by = got.sort_values(["sequence_id", "offset"])
    assert (by.groupby("sequence_id")["length"].cumsum() - by["length"] == by["offset"]).all()
    assert by.groupby("sequence_id")["length"].sum().max() <= 2048
    assert sorted(by["sequence_id"].unique()) == list(range(by["sequence_id"].nunique()))
    assert packing.pack(packing.token_pieces(empty, path, 1)).count() == 0


def test_pieces_are_numbered_by_no_task_that_makes_them(spark, monkeypatch):
    """Two Python stages in a task keep two sets of workers alive in every executor."""
    plans = []

    def watched(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return scale.cut(df)

    monkeypatch.setattr(packing, "cut", watched)
    made = spark.range(50).mapInArrow(lambda batches: batches, "id long")
    pieces = made.select(F.col("id").alias("doc_id"), (F.col("id") % 7 + 1).alias("length"))
    placed = packing.pack(pieces, 8)
    assert placed.count() == 50 and {r["n"] for r in placed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()} <= set(range(9))
    assert [p.count("MapInArrow") for p in plans] == [1, 1]
