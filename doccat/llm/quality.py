"""Quality rules: how far a document's histograms are from those of its language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doccat.llm.common import with_content_key, without
from doccat.operators.scale import cut, fits_broadcast

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
# Very common words of four languages, from the public Snowball stopword lists.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on are as with his they at be this have from or".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur pas au avec il ce".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más".split(),
}
# The classes of characters that are counted; what is left is a class of its own.
CLASSES = {
    "lower": "a-z", "space": r"\x20\x09-\x0D", "upper": "A-Z", "digit": "0-9", "stop": ".,;:?'",
    "mark": r"!\"#$%&()*+\-/<=>@\[\\\]^_`{|}~",
}
# The class before which only marks and odd characters are left, symbols among them.
SYMBOL_CLASS = 5
# A histogram of fewer counts than these says too little and is not judged.
LEAST_CHARS = 200
LEAST_WORDS = 40
# Greatest sum of both Jensen-Shannon distances (base 2, each from 0 to 1) of a kept document, and
# what is allowed above it for chance, over the square root of the number of words.
MOST_DISTANCE = 0.40
CHANCE = 0.6


def word_bins() -> list[str]:
    return sorted({w for words in COMMON_WORDS.values() for w in words})


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, bins, n_listed, guess``.

    One row per row of ``docs``, from the whole text; a null text has no words and no characters.
    ``classes`` counts characters per class, ``bins`` has ``at, n`` of the common words in the text, by their place in
    :func:`word_bins`; ``guess`` is the language whose list has most of them (none: null). Repeated windows are found by
    their 64-bit hashes, sorted within the row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    each = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text")
    )
    each = each.select(
        "doc_id", "lang", "text",
        F.filter(F.split("text", SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    names = word_bins()
    n = F.size("words")
    each = each.select(
        "doc_id", "lang", n.cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(names)).alias("listed"),
        F.length("text").cast("long").alias("left_0"), F.col("text").alias("text_0"),
    )
    # Classes go one after the other, so that each pass reads what the ones before have left.
    for k, chars in enumerate(CLASSES.values()):
        each = each.withColumn(f"text_{k + 1}", F.regexp_replace(f"text_{k}", f"[{chars}]+", ""))
        each = each.withColumn(f"left_{k + 1}", F.length(f"text_{k + 1}").cast("long"))
        if k != SYMBOL_CLASS:
            each = each.drop(f"text_{k}")
    symbols = F.col(f"left_{SYMBOL_CLASS}") - F.length(F.regexp_replace(f"text_{SYMBOL_CLASS}", r"[#*$%&|<>]+", ""))
    space = list(CLASSES).index("space")
    each = each.withColumn("n_symbols", symbols.cast("long")).drop(f"text_{SYMBOL_CLASS}", f"text_{len(CLASSES)}")
    # Hash and place of each window in order, only where some hash comes twice.
    n = F.size("hashes")
    windows = F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), n - WINDOW),
            lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    each = each.withColumn("windows", windows).drop("hashes")
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    each = each.withColumn("pairs", F.when(twice, pairs)).drop("windows")
    same = F.zip_with("pairs", F.slice("pairs", 2, F.size("pairs")), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))
    each = each.withColumn("same", same)
    before = F.concat(F.array(F.lit(False)), F.slice("same", 1, F.size("same") - 1))
    flags = F.zip_with("same", before, lambda a, b: a | b)
    places = F.zip_with("pairs", flags, lambda x, f: F.when(f, x["i"]))
    each = each.withColumn("places", F.sort_array(F.filter(places, lambda i: i.isNotNull()))).drop("pairs", "same")
    # Windows overlap: each adds what lies beyond the one before.
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(
        "places", start,
        lambda s, i: F.struct(
            (i + WINDOW).alias("end"), (s["n"] + i + WINDOW - F.greatest(i, s["end"])).alias("n")
        ),
        lambda s: s["n"],
    )
    known = F.array(*map(F.lit, names))
    bins = F.transform(
        F.array_distinct("listed"),
        lambda c: F.struct(
            (F.array_position(known, c) - 1).cast("int").alias("at"),
            (F.size("listed") - F.size(F.array_remove("listed", c))).cast("long").alias("n"),
        ),
    )

    def hits(lang: str) -> Column:
        found = F.filter("listed", lambda w: w.isin(COMMON_WORDS[lang]))
        return F.struct((-F.size(found)).alias("n"), F.lit(lang).alias("lang"))

    return each.select(
        "doc_id", "lang", "n_words", (F.col("left_0") - F.col(f"left_{space}") + F.col(f"left_{space + 1}")).alias("word_chars"),
        "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array(*[F.col(f"left_{k}") - F.col(f"left_{k + 1}") for k in range(len(CLASSES))], F.col(f"left_{len(CLASSES)}")).alias("classes"),
        bins.alias("bins"), F.size("listed").cast("long").alias("n_listed"),
        F.when(F.size("listed") > 0, F.least(*map(hits, sorted(COMMON_WORDS)))["lang"]).alias("guess"),
    )


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def _term(x: Column, y: Column) -> Column:
    return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence in base 2, for two arrays of shares."""
    terms = F.zip_with(p, q, lambda x, y: _term(x, y) + _term(y, x))
    return _root(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))


def _root(total: Column) -> Column:
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def word_distance(words: Column) -> Column:
    """:func:`js_distance` of ``bins`` and the other words to the shares ``word_shares``, which has the latter last.

    A common word that the text lacks adds its share in the reference, so only those in the text are looked up.
    """
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("met"))
    rest = F.struct(F.lit(len(word_bins())).alias("at"), (F.col("n_words") - F.col("n_listed")).alias("n"))
    found = F.aggregate(
        F.concat("bins", F.array(rest)), start,
        lambda s, x: F.struct(
            (s["sum"] + _both(F.when(words > 0, x["n"] / words).otherwise(F.lit(0.0)), F.get("word_shares", x["at"]))).alias("sum"),
            (s["met"] + F.get("word_shares", x["at"])).alias("met"),
        ),
    )
    all_ = F.aggregate("word_shares", F.lit(0.0), lambda s, x: s + x)
    return _root(found["sum"] + all_ - found["met"])


def _both(x: Column, y: Column) -> Column:
    return _term(x, y) + _term(y, x)


def references(found: DataFrame) -> DataFrame:
    """``lang, class_shares, word_shares``: mean shares per language, over all documents that count; a written table.

    Documents count that pass the base rules and the length guards, each as much as any other.
    """
    judged = found.filter(~base_failed() & long_enough() & F.col("lang").isNotNull())
    words = F.col("n_words")
    counts = F.concat(
        F.transform(F.col("bins"), lambda x: F.struct((x["at"] + len(CLASSES) + 1).alias("at"), (x["n"] / words).alias("x"))),
        F.array(F.struct(F.lit(len(word_bins()) + len(CLASSES) + 1).alias("at"), ((words - F.col("n_listed")) / words).alias("x"))),
        F.transform(shares(F.col("classes")), lambda x, i: F.struct(i.alias("at"), x.alias("x"))),
    )
    # One row per language and share, however many documents there are.
    sums = judged.select("lang", F.explode(counts).alias("c")).groupBy("lang", "c.at").agg(F.sum("c.x").alias("x"))
    sizes = judged.groupBy("lang").agg(F.count("*").alias("n"))
    places = F.map_from_entries(F.collect_list(F.struct("at", "x")))
    whole = sums.groupBy("lang").agg(places.alias("x")).join(sizes, "lang")

    def dense(first: int, n: int) -> Column:
        return F.transform(
            F.sequence(F.lit(first), F.lit(first + n - 1)), lambda i: F.coalesce(F.try_element_at("x", i), F.lit(0.0)) / F.col("n")
        )

    n_classes = len(CLASSES) + 1
    return cut(
        whole.select(
            "lang", dense(0, n_classes).alias("class_shares"), dense(n_classes, len(word_bins()) + 1).alias("word_shares")
        )
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def long_enough() -> Column:
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda s, x: s + x)
    return (chars >= LEAST_CHARS) & (F.col("n_words") >= LEAST_WORDS)


def judge(docs: DataFrame, most: float = MOST_DISTANCE, chance: float = CHANCE) -> DataFrame:
    """Base counts of each row, its distances from its language's reference, and the verdict.

    ``base_failed``: fewer than ten words, or over a fifth of them in repeated windows. ``kept`` is
    false for these and for documents whose character classes and common words are, added up,
    farther from the reference than ``most + chance / sqrt(n_words)``. Every language has a reference that has a document
    that counts. A document whose ``lang`` is null or has no reference is held against that of the language whose common words it
    has most of (by name where equal). Short documents, and those without a reference, have no
    distance (null) and are kept unless the base rules fail. Repeated rows and null ids are judged like
    others; other columns are not read; an empty table stays empty.
    """
    found = cut(features(docs))
    known = references(found)
    own = known.select("lang", F.col("lang").alias("ref"))
    small = fits_broadcast(known)
    held = found.join(F.broadcast(own) if small else own, "lang", "left").withColumn("ref", F.coalesce("ref", "guess"))
    known = known.withColumnRenamed("lang", "ref")
    held = held.join(F.broadcast(known) if small else known, "ref", "left")
    judged = held.withColumn(
        "class_distance", F.when(long_enough(), js_distance(shares(F.col("classes")), F.col("class_shares")))
    ).withColumn("word_distance", F.when(long_enough(), word_distance(F.col("n_words"))))
    limit = most + chance / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    good = F.coalesce(F.col("class_distance") + F.col("word_distance") <= limit, F.lit(True))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & good).alias("kept"),
        "class_distance", "word_distance",
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, all columns as they are.

    Each row goes or stays by its own text and language, also if it shares its ``doc_id`` with others or has none.
    """
    rows = with_content_key(docs, "lang", "text")
    bad = judge(rows.select(F.col("_row").alias("doc_id"), "_doc.lang", "_doc.text")).filter(~F.col("kept"))
    return without(rows, cut(bad.select(F.col("doc_id").alias("_row")).distinct()), "_row").select("_doc.*")
