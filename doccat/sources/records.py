"""Readers: XML records and text corpora to DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doccat.functions import xml as xf
from doccat.functions.encoding import decode_xml
from doccat.operators.scale import BROADCAST_BYTES, cut, ship_code
from doccat.operators.vectors import dense_index


def read_record_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, name, content)``: one row per ``.xml`` file below ``folder``, its bytes as they are.

    The path is the key: files of one name in different folders stay apart.
    """
    files = spark.read.format("binaryFile").load(folder, recursiveFileLookup=True, pathGlobFilter="*.xml")
    return files.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), "content"
    )


def decode_records(records: DataFrame) -> DataFrame:
    """``content`` replaced by ``xml`` and ``problem``: the text, or why the bytes are none; a narrow step."""
    decoded = records.withColumn("_decoded", decode_xml(F.col("content")))
    kept = [c for c in records.columns if c != "content"]
    return decoded.select(*kept, F.col("_decoded.text").alias("xml"), F.col("_decoded.problem").alias("problem"))


def read_xml_records(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, name, xml, problem)``: one row per ``.xml`` file below ``folder``.

    Bytes become text by the record's byte-order mark or declared encoding. Where they cannot, ``xml`` is null and
    ``problem`` says why; no file ends the job, and none is left out but those of no bytes, which Spark does not list.
    """
    return decode_records(read_record_bytes(spark, folder))


def count_records(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("n_records"))


def read_text_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, text)``: one row per file, keyed by path. Bytes that are no UTF-8 become U+FFFD."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.make_valid_utf8("value").alias("text"))


def parse_records(records: DataFrame) -> DataFrame:
    """``path, reason`` and all catalogue fields of each of ``records (path, xml)``, parsed once. A narrow step.

    ``reason`` says why a record is no text (its ``problem``, where there is this column) or not
    well-formed XML, and is null if it is; only then the fields are filled. No record is left out.
    """
    ship_code(records.sparkSession)
    names = list(xf.FIELD_PATHS)
    texts, lists = list(xf.FIELD_PATHS.values()), [xf.THEME_PATH]
    pairs = [(xf.ATTRIBUTE_PATH, xf.ATTRIBUTE_LABEL, xf.ATTRIBUTE_DESCRIPTION)]
    pair = pa.struct([("label", pa.string()), ("description", pa.string())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [xf.read_record(x, texts, lists, pairs) for x in batch.column("xml").to_pylist()]
            known = batch.column("problem").to_pylist()
            read = [(p, [], []) if p else r for p, r in zip(known, read, strict=True)]
            good = [why is None for why, _, _ in read]
            columns = [batch.column("path"), pa.array([why for why, _, _ in read], pa.string())]
            for k in range(len(names)):
                columns.append(pa.array([t[k] if ok else None for ok, (_, t, _) in zip(good, read)], pa.string()))
            themes = [i[0] if ok else None for ok, (_, _, i) in zip(good, read)]
            rows = [
                [{"label": a, "description": b} for a, b in i[1]] if ok else None
                for ok, (_, _, i) in zip(good, read)
            ]
            columns += [pa.array(themes, pa.list_(pa.string())), pa.array(rows, pa.list_(pair))]
            yield pa.RecordBatch.from_arrays(columns, ["path", "reason", *names, "themes", "attributes"])

    fields = ", ".join(f"`{n}` string" for n in names)
    schema = (
        f"path string, reason string, {fields}, themes array<string>, "
        "attributes array<struct<label string, description string>>"
    )
    label = F.transform(
        "attributes",
        lambda x: F.struct(F.upper(x["label"]).alias("label"), x["description"].alias("description")),
    )
    problem = F.col("problem") if "problem" in records.columns else F.lit(None).cast("string")
    valid = F.try_validate_utf8("xml")
    broken = F.when(F.col("xml").isNotNull() & valid.isNull(), F.lit("not valid utf-8"))
    checked = records.select("path", valid.alias("xml"), F.coalesce(problem, broken).alias("problem"))
    return checked.mapInArrow(parse, schema).withColumn("attributes", label)


def rejected_records(records: DataFrame) -> DataFrame:
    """``path, reason`` of the records that are not well-formed XML."""
    return parse_records(records).filter("reason IS NOT NULL").select("path", "reason")


def extract_fields(records: DataFrame) -> DataFrame:
    """All catalogue fields of each well-formed record, next to its ``path``."""
    return parse_records(records).filter("reason IS NULL").drop("reason")


def number_entities(parsed: DataFrame) -> DataFrame:
    """Entities of :func:`parse_records` with an ``id`` from 1 in the order of the path.

    Only paths are sorted and numbered, by ranges; a rejected record keeps its number and so leaves a
    gap in the ids.
    """
    ids = cut(dense_index(parsed.select("path"), ["path"], "_at"))
    size = ids.agg(F.sum(F.octet_length("path") + 40)).first()[0] or 0
    ids = F.broadcast(ids) if size <= BROADCAST_BYTES else ids
    return parsed.filter("reason IS NULL").join(ids, "path").select(
        (F.col("_at") + 1).alias("id"),
        "path", "title", "class", "partner", "service", "themes", "abstract", "attributes",
    )


def build_entities(records: DataFrame) -> DataFrame:
    """Entities with an ``id`` from 1 in the order of the path; a rejected record leaves a gap."""
    return number_entities(cut(parse_records(records)))
