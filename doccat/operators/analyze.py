"""Corpus-level text analysis."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.functions import text as tx
from doccat.operators.scale import PART, LaidOut, by_part, cut, fits_broadcast


def corpus(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Canonical ``(doc_id, text)``.

    An input of fewer partitions than cores (one small file, say) is spread over all of them;
    a larger one is left as it is.
    """
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def token_lists(docs: DataFrame, stops: Iterable[str], key: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``(doc_id, tokens)``: the analysed terms of each document in order."""
    return docs.select(*key, tx.analyze(F.col("text"), stops).alias("tokens"))


def token_rows(docs: DataFrame, stops: Iterable[str], key: Iterable[str] = ("doc_id",)) -> DataFrame:
    """``(doc_id, term)``: one row per analysed token, filtered after the explode."""
    words = list(stops)
    exploded = docs.select(*key, F.explode(tx.raw_tokens(F.col("text"))).alias("term"))
    return exploded.filter(tx.keeps(F.col("term"), words))


def content_words(
    docs: DataFrame,
    lexicon: DataFrame,
    tags: Iterable[str] | None = ("N", "A"),
    exclude: Iterable[str] = (),
    min_words: int = 0,
) -> DataFrame:
    """Keep the words of chosen parts of speech, in their order, as one text per document.

    ``lexicon`` is ``(word, tag)`` with lower-cased words; a word with several tags counts for
    each. ``tags=None`` keeps every word without a tag in ``exclude``, words the lexicon lacks
    included. ``min_words`` drops documents with fewer kept words.
    """
    # Texts are laid out by document, so that the words need no shuffle to meet again; a document without words keeps
    # one row. Words that the lexicon does not list need no entry.
    listed = list(exclude) if tags is None else list(tags)
    marked = cut(lexicon.filter(F.col("tag").isin(listed)).select("word").distinct().withColumn("listed", F.lit(True)))
    if fits_broadcast(marked):
        words = _words(docs.repartition("doc_id"), "doc_id")
        texts = _kept_words(words.join(F.broadcast(marked), "word", "left"), tags is None, "doc_id")
    else:
        laid = LaidOut(docs, "doc_id", int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        laid.rows = _words(laid.rows, PART, "doc_id")
        with by_part(docs.sparkSession):
            texts = cut(_kept_words(laid.shipped(marked, "word"), tags is None, PART, "doc_id"))
    return texts.filter(F.col("n_words") >= min_words) if min_words else texts


def _words(docs: DataFrame, *key: str) -> DataFrame:
    """``key, pos, token, word``: the words of each text in order, as they stand and in lower case."""
    parts = F.filter(F.split(tx.split_punct(F.col("text")), r"\s+"), lambda t: t != "")
    return docs.select(*key, F.posexplode_outer(parts).alias("pos", "token")).withColumn("word", F.lower("token"))


def _kept_words(tagged: DataFrame, others: bool, *key: str) -> DataFrame:
    """``(doc_id, text, n_words)``: the words that are ``listed``, or all ``others``, as one text per document."""
    is_listed = F.coalesce(F.col("listed"), F.lit(False))
    kept = (~is_listed if others else is_listed) & F.col("token").isNotNull()
    lists = tagged.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(kept, F.struct("pos", "token")))).alias("kept"))
    return lists.select("doc_id", F.array_join("kept.token", " ").alias("text"), F.size("kept").cast("long").alias("n_words"))
