"""Registry of queries: each name has a Spark callable and, where SQL can say it, its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from doccat.operators.analyze import corpus
from doccat.operators.scale import checkpoint_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text corpus as ``(doc_id, text)``."""
    return corpus(table(spark, sf_dir, "documents"))


def new_folder(spark: SparkSession) -> str:
    """A fresh path below the checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
