"""Helpers that keep joins and iterations safe on large and skewed data."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from copy import copy
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A side is broadcast only when its measured bytes stay below this.
BROADCAST_BYTES = 128 << 20
# A key is hot when it holds more than 1/HOT_SHARE of all rows: fewer than HOT_SHARE keys can.
HOT_SHARE = 200
# Number of pieces a hot key is split into.
SALTS = 64


# The number of a row's partition in a table that is laid out.
PART = "_part"

# Spark applications that have this package on their executors.
_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once per application.

    Functions that run in tasks are pickled by the name of their module, so each worker has to
    import it. The package is zipped on the driver and sent by ``addPyFile``.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="doccat-code-")) / "doccat.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="doccat-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` to the checkpoint folder, in a folder for each value of ``by``, and read it back.

    The lineage ends at a table that outlives any executor, later scans prune columns, and
    Spark knows the true size of the result when it picks joins.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    with shuffles_dropped(spark):
        (writer.partitionBy(by) if by else writer).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path = path
    return table


def drop_cut(table: DataFrame) -> None:
    """Delete the files of a table that :func:`cut` wrote, once nothing reads it any more."""
    path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table.cut_path)
    path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _bytes(name: str, kind: T.DataType) -> Column:
    value = F.col(f"`{name}`")
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType):
            return F.coalesce(F.aggregate(value, F.lit(24), lambda s, x: s + F.coalesce(F.octet_length(x), F.lit(0)) + 16), F.lit(8))
        return F.greatest(F.size(value), F.lit(0)) * 16 + 24
    if isinstance(kind, T.StructType | T.MapType):
        return F.octet_length(F.to_json(F.struct(value)))
    return F.lit(8)


def measured_bytes(df: DataFrame) -> int:
    """Bytes that the rows of ``df`` take in memory, texts by their true length; one aggregate.

    ``df`` should be cheap to read (a written table).
    """
    row = F.lit(16)
    for field in df.schema:
        row = row + _bytes(field.name, field.dataType)
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def fits_broadcast(df: DataFrame) -> bool:
    return measured_bytes(df) <= BROADCAST_BYTES


def checked_join(
    fact: DataFrame,
    dim: DataFrame,
    on: str | list[str],
    *,
    spread: str,
    weight: str,
    how: str = "inner",
) -> DataFrame:
    """Join a large table to one with unique keys, whatever the size and skew.

    ``dim`` must be cheap to read (a written table): its bytes are measured, and below
    ``BROADCAST_BYTES`` it is broadcast. Beyond that both sides shuffle, and keys that hold a large share of ``fact``
    (by the count in ``dim[weight]``) are salted on ``spread``.
    """
    if fits_broadcast(dim):
        return fact.join(F.broadcast(dim), on, how)
    return salted_join(fact, dim, on, spread=spread, weight=weight, how=how)


def salted_join(
    fact: DataFrame,
    dim: DataFrame,
    on: str | list[str],
    *,
    spread: str,
    weight: str,
    how: str = "inner",
    salts: int = SALTS,
    share: int = HOT_SHARE,
) -> DataFrame:
    """Equi-join in which hot keys of ``fact`` are split over ``salts`` tasks.

    Hot means ``weight > sum(weight) / share``. Fewer than ``share`` keys can satisfy that, so
    the list of hot keys is broadcast; ``dim`` is repeated for those keys only.
    """
    keys = [on] if isinstance(on, str) else list(on)
    total = dim.agg(F.sum(weight)).scalar()
    is_hot = F.col(weight) * share > total
    hot = dim.filter(is_hot).select(*keys, F.lit(True).alias("_hot"))
    piece = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    left = (
        fact.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.coalesce(piece, F.lit(0)))
        .drop("_hot")
    )
    pieces = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = dim.withColumn("_salt", F.explode(pieces))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def by_part(spark: SparkSession):
    """Joins that run inside leave rows where they are if these are laid out by some of the keys; set for this time only."""
    return _setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def shuffles_dropped(spark: SparkSession):
    """Shuffle files of what runs inside go when it ends, not when the driver collects its garbage; set for this time only."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


class LaidOut:
    """Rows dealt into ``parts`` partitions by a hash of ``key``, with the number of the partition in ``_part``.

    A table that is too large for a broadcast comes to the rows, not the other way round: each part is sent the
    entries that some row of it needs, once, however often the part has them. The rows are neither shuffled
    again nor salted if the result is written inside :func:`by_part`, and aggregates by ``_part`` and ``key`` need no
    shuffle either.
    """

    def __init__(self, rows: DataFrame, key: str, parts: int):
        self.key, self.parts = key, parts
        # Numbers of partitions are such that each has a hash of its own, so that Spark deals one to each task.
        tried = rows.sparkSession.range(64 * parts).select(F.col("id").cast("int").alias("n"))
        found = tried.groupBy(F.pmod(F.hash("n"), F.lit(parts))).agg(F.min("n").alias("n")).collect()
        self._numbers = sorted(r["n"] for r in found)
        self.rows = self.beside(rows)
        self._needs: dict[tuple[str, ...], DataFrame] = {}

    def written(self, rows: DataFrame) -> LaidOut:
        """``rows``, which lie as these do, written once in as many buckets: what is read back lies so too, unshuffled.

        The name that the table needs in the catalogue is given up at once; its files stay, as those of :func:`cut`.
        """
        spark, name = rows.sparkSession, f"doccat_{uuid.uuid4().hex}"
        path = f"{checkpoint_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"
        with shuffles_dropped(spark):
            rows.write.format("parquet").option("compression", "zstd").bucketBy(self.parts, PART).option("path", path).saveAsTable(name)
        new = self.over(spark.table(name))
        spark.sql(f"DROP TABLE {name}")
        return new

    def over(self, rows: DataFrame) -> LaidOut:
        """The same layout of ``rows``, which lie as these do."""
        new = copy(self)
        new.rows, new._needs = rows, {}
        return new

    def table(self, *columns: str) -> DataFrame:
        """``columns`` of the rows, with this layout as ``laid`` for steps that can use it (:func:`laid_rows`)."""
        table = self.rows.select(*columns)
        table.laid = self
        return table

    def beside(self, table: DataFrame) -> DataFrame:
        """``table``, which has the key, laid out in the same way."""
        nth = F.pmod(F.xxhash64(self.key), F.lit(len(self._numbers))).cast("int")
        part = F.get(F.array(*map(F.lit, self._numbers)), nth)
        return table.withColumn(PART, part).repartition(self.parts, PART)

    def shipped(self, dim: DataFrame, on: str | list[str], rows: DataFrame | None = None, how: str = "left") -> DataFrame:
        """All ``rows`` (or some of them, as they are laid out) with the entries of ``dim``, whose key ``on`` is unique."""
        on = [on] if isinstance(on, str) else on
        if tuple(on) not in self._needs:
            self._needs[tuple(on)] = cut(self.rows.select(PART, *on).distinct())
        sent = self._needs[tuple(on)].join(dim, on).repartition(self.parts, PART).hint("shuffle_hash")
        return (self.rows if rows is None else rows).join(sent, [PART, *on], how)

    def met(self, dim: DataFrame, on: str | list[str], rows: DataFrame | None = None, how: str = "inner") -> DataFrame:
        """The join of :meth:`shipped`, by a broadcast if the measured bytes of ``dim``, a written table, allow it."""
        if fits_broadcast(dim):
            return (self.rows if rows is None else rows).join(F.broadcast(dim), on, how)
        return self.shipped(dim, on, rows, how)


def laid_rows(table: DataFrame, key: str = "doc_id") -> tuple[DataFrame, list[str]]:
    """The rows of ``table`` and the columns by which its keys are grouped: without a shuffle if it has a layout by ``key``."""
    laid = getattr(table, "laid", None)
    return (table, [key]) if laid is None or laid.key != key else (laid.rows, [PART, key])
