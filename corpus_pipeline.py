"""From raw documents to packed training sequences: five stages, each over all rows that the one before kept.

A stage takes the session, the documents so far and the folder of the tables. All but the last return the
columns of ``documents``; each result is written as Parquet and read again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from doccat.llm import decontam, packing, pii, quality, simhash
from doccat.llm.queries import vocabulary
from doccat.operators.scale import cut, ship_code


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the distance from their language reject go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints of four words within four bits, the smallest ``doc_id`` stays."""
    return simhash.one_per_group(docs, words=4, radius=4)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an item of the benchmark go."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts becomes its kind in brackets; words that reveal it are taken out."""
    return pii.sanitise(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token ids of all documents, placed in sequences."""
    return packing.pack(packing.token_pieces(docs, vocabulary("word_bpe_49k.json"), end_id=1))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("remove_pii", remove_pii),
    ("pack_sequences", pack_sequences),
]

# Fingerprints and token ids are not in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
