import pytest
from pyspark.sql import functions as F

from doccat.functions import text as tx
from doccat.functions.stopwords import AGENCY_WORDS, stopwords
from doccat.operators import analyze as an
from doccat.operators import scale
from doccat.operators import vectors as vc


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, tokens",
    [
        ("L'Eau-vive du LAC (2012), Dime", ["eau", "vive", "lac"]),
        ("abc123def «Sol» x1", ["abc", "def", "«sol»"]),
        ("12 a ,", []),
        ("", []),
    ],
)
def test_analyze(spark, text, tokens):
    stops = ["du", "la", "dime"]
    assert one(spark, tx.analyze(F.col("t"), stops), t=text) == tokens
    rows = an.token_rows(spark.createDataFrame([(1, text)], "doc_id long, text string"), stops)
    assert [r["term"] for r in rows.collect()] == tokens


def test_stopwords_include_both_lists():
    words = stopwords()
    assert set(AGENCY_WORDS) <= set(words) and "avec" in words and len(words) == len(set(words))
    assert stopwords(()) == sorted(set(words) - (set(AGENCY_WORDS) - {"du"}))


def test_stopwords_are_tested_after_the_splits(spark):
    assert one(spark, tx.analyze(F.col("t"), ["eau"]), t="l'eau eau-forte") == ["forte"]


def test_names(spark):
    assert one(spark, tx.class_label(F.col("t")), t="SIT.A.CLASSE_ONE") == "SIT.CLASSE ONE"
    assert one(spark, tx.text_name(F.col("t")), t="axml.xml") == "axml.txt"
    assert one(spark, tx.record_name(F.col("t")), t="/atxt/b.txt") == "atxt/b.xml"
    assert one(spark, tx.record_name(F.col("t")), t="atxtb") == "atxtb"
    assert one(spark, tx.safe_key(F.col("t")), t="a/b/") == "ab"


def test_display_rounding(spark):
    assert one(spark, tx.round2(F.col("v")), v=0.125) == 0.12
    assert one(spark, tx.show2(F.col("v")), v=1.0) == "1"
    assert one(spark, tx.show2(F.col("v")), v=0.5) == "0.5"


def test_ngrams_bridge_nothing_but_neighbours(spark):
    def grams(tokens, n):
        df = spark.createDataFrame([(tokens,)], "t array<string>")
        return [tuple(g) for g in df.select(tx.ngrams(F.col("t"), n).alias("g")).first()["g"]]

    assert grams(["a", "b", "c"], 2) == [("a", "b"), ("b", "c")]
    assert grams(["a", "b", "c"], 3) == [("a b", "c")]
    assert grams(["a"], 2) == [] and grams([], 2) == []


@pytest.mark.parametrize("cells, value", [((10, 0, 0, 90), 65.016595), ((5, 5, 5, 85), 12.533003)])
def test_llr(spark, cells, value):
    score = vc.llr(*[F.lit(c) for c in cells])
    assert one(spark, score) == pytest.approx(value, abs=1e-6)


def test_collocations_across_orders(spark):
    text = " ".join(["route cantonale"] * 30 + ["mur"] * 40 + ["pont", "quai", "lac"] * 10)
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    tf = {r["term"]: r["tf"] for r in vc.tf_vectors(docs, [], max_ngram=2).collect()}
    assert tf["route cantonale"] == 30 and tf["mur"] == 40
    assert "mur pont" not in tf


def test_content_words(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "La grande Maison, court vite."), (2, "xx")], "doc_id long, text string")
    lexicon = spark.createDataFrame(
        [("maison", "N"), ("grande", "A"), ("court", "V"), ("court", "A"), ("vite", "D")], "word string, tag string"
    )

    def kept(**options):
        return {r["doc_id"]: r["text"] for r in an.content_words(docs, lexicon, **options).collect()}

    assert kept() == {1: "grande Maison court", 2: ""}
    assert kept(tags=("N",)) == {1: "Maison", 2: ""}
    assert kept(tags=None, exclude=("V",)) == {1: "La grande Maison vite", 2: "xx"}
    assert kept(min_words=3) == {1: "grande Maison court"}
    monkeypatch.setattr("doccat.operators.scale.BROADCAST_BYTES", 0)
    assert kept(tags=None, exclude=("V",)) == {1: "La grande Maison vite", 2: "xx"}


def test_analysis_runs_on_a_stream(spark, tmp_path):
    source = spark.createDataFrame([("Le LAC bleu",), ("12 ab",)], "text string")
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    tokens = stream.select(tx.analyze(F.col("text"), ["le"]).alias("tokens"))
    query = tokens.writeStream.format("memory").queryName("tokens").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r["tokens"] for r in spark.table("tokens").collect()) == [[], ["lac", "bleu"]]


def test_words_stay_where_they_are_beyond_the_broadcast_limit(spark, monkeypatch):
    rows = [(1, "Le lac bleu"), (2, None), (3, ""), (1, "lac rive"), (None, "Rive et lac"), (4, "eau " * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = spark.createDataFrame([("lac", "N"), ("lac", "V"), ("rive", "N"), ("bleu", "A"), ("eau", None)], "word string, tag string")
    plain = an.content_words(docs, lexicon).filter("doc_id <> 1 OR doc_id IS NULL").collect()
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 0)
    far = an.content_words(docs, lexicon)
    assert sorted(far.filter("doc_id <> 1 OR doc_id IS NULL").collect(), key=str) == sorted(plain, key=str)
    assert far.filter("doc_id = 1").first()["n_words"] == 4
    # Texts travel by part and the lexicon's entries by word; no row of a single word is in a shuffle.
    laid = scale.LaidOut(docs, "doc_id", 8)
    laid.rows = an._words(laid.rows, scale.PART, "doc_id")
    marked = scale.cut(lexicon.select("word", F.lit(True).alias("listed")).distinct())
    with scale.by_part(spark):
        kept = an._kept_words(laid.shipped(marked, "word"), False, scale.PART, "doc_id")
        plan = kept._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sum("hashpartitioning(_part" in line for line in moved) == 2 and not any("doc_id#" in line for line in moved)


def expected_collocations(texts, n, min_support, min_llr):
    """Collocations by counting every n-gram of every text."""
    from collections import Counter
    from math import log

    pairs = Counter((" ".join(t[i : i + n - 1]), t[i + n - 1]) for t in texts for i in range(len(t) - n + 1))
    heads, tails, m = Counter(), Counter(), sum(pairs.values())
    for (h, t), c in pairs.items():
        heads[h] += c
        tails[t] += c

    def part(c, row, col):
        return c * log(c * m / (row * col)) if c else 0.0

    found = {}
    for (h, t), c in pairs.items():
        a, b, d = heads[h], tails[t], m
        ratio = 2 * (part(c, a, b) + part(a - c, a, d - b) + part(b - c, d - a, b) + part(d - a - b + c, d - a, d - b))
        if c >= min_support and ratio >= min_llr:
            found[f"{h} {t}"] = (c, pytest.approx(ratio, abs=1e-6))
    return found


@pytest.mark.parametrize("n, min_support, limit", [(2, 1, -1), (2, 2, 128 << 20), (3, 2, -1)])
def test_collocations_of_likely_ngrams_are_all_there_are(spark, monkeypatch, n, min_support, limit):
    """Frequent words that meet once, pairs that occur once and hashes that collide; n-grams of one occurrence are not shuffled."""
    import random

    from doccat.operators import scale

    monkeypatch.setattr(scale, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(vc, "HASH_BITS", 8 if min_support == 2 else 40)
    rng = random.Random(3)
    texts = [["aaa", "xxx"] * 150, ["bbb", "yyy"] * 150, ["aaa", "yyy"], ["bbb", "ccc", "yyy", "xxx"], []]
    texts += [[f"w{a}{b}" for a, b in zip(rng.choices("abcdefgh", k=12), rng.choices("ijkl", k=12))] for _ in range(30)]
    docs = spark.createDataFrame([(i % 33, " ".join(t)) for i, t in enumerate(texts)] + [(50, None)], "doc_id long, text string")
    grams = vc.ngram_rows(vc.laid_tokens(docs, [], n), n)
    likely = vc.likely_ngrams(grams, min_support, 20.0)
    found = vc.collocations(scale.cut(vc.ngram_counts(likely)), min_support, 20.0, grams).collect()
    expected = expected_collocations(texts, n, min_support, 20.0)
    assert {r["term"]: (r["count"], r["llr"]) for r in found} == expected and len(found) == len(expected) > 0
    if n == 2:
        assert ("aaa yyy" in expected) == (min_support == 1)
    if vc.HASH_BITS == 40:
        n_grams = sum(max(0, len(t) - n + 1) for t in texts)
        assert likely.groupBy().sum("tf").first()[0] < n_grams - 50
    tf = vc.tf_vectors(docs, [], min_support, n, 20.0)
    words = [r for r in tf.collect() if " " in r["term"]]
    assert {r["term"] for r in words} >= set(expected)
    plan = likely.laid.rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Exchange" not in tf._jdf.queryExecution().executedPlan().toString()
