"""Writers. All replace earlier output, and none writes a file per record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doccat.operators import fields as fl
from doccat.operators.skos import PREFIXES, turtle_lines


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_lines(df: DataFrame, path: str, by: str | None = None) -> None:
    """One text column (besides ``by``) as lines."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).text(path)


def write_field_docs(entities: DataFrame, path: str) -> None:
    """One text per record and field, in a folder per field."""
    write_table(fl.field_documents(entities), path, by="field")


def write_field_lists(entities: DataFrame, path: str) -> None:
    """All values and all distinct values of each field, as text lines."""
    listed = fl.field_lists(entities)
    write_lines(listed.select("field", "value"), f"{path}/ALL", by="field")
    write_lines(listed.distinct().select("field", "value"), f"{path}/ALL_UNIQUE", by="field")


def write_unique_values(entities: DataFrame, path: str) -> None:
    """Distinct values under a file-safe key, in a folder per field."""
    write_table(fl.unique_values(entities), path, by="field")


def write_content_words(texts: DataFrame, path: str) -> None:
    write_table(texts.select("doc_id", "text"), path)


def write_intermediates(tables: dict[str, DataFrame], path: str) -> None:
    """Each named table below ``path``."""
    for name, table in tables.items():
        write_table(table, f"{path}/{name}")


def write_turtle(statements: DataFrame, path: str) -> None:
    """Turtle text. Every part file starts with the prefixes, so each is valid on its own."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    lines = turtle_lines(statements).select(
        F.when(first, F.concat(F.lit(PREFIXES), F.col("line"))).otherwise(F.col("line")).alias("line")
    )
    write_lines(lines, path)
