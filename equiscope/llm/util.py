"""Shared folders and small column helpers of the training-data operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: ``[\x20\x09-\x0D]``: the six characters that separate words (fixed values of the contracts).
SPACES = " \t\n\x0b\x0c\r"


class Scratch:
    """Tables written in the session's shared checkpoint folder.

    Written tables cut lineage: a lost executor re-reads files instead of
    recomputing, and a generated id has one value for all readers. ``drop``
    frees a table once what was made from it is written.
    """

    #: Folders made in this process, for a caller that frees what a step of its own has left.
    made: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.made.append(self.root)
        self._n = 0
        self._held: list[str] = []

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
        path = self.path(name)
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        schema = df.schema if partition_by is None else df.drop(partition_by).schema.add(df.schema[partition_by])
        return self.spark.read.schema(schema).parquet(path), path

    def table(self, df: DataFrame, name: str) -> DataFrame:
        return self.write(df, name)[0]

    def hold(self, df: DataFrame) -> DataFrame:
        """A table written until ``release`` frees it; plans made from it begin anew at its files."""
        table, path = self.write(df, "held")
        self._held.append(path)
        return table

    def release(self) -> None:
        self.drop(*self._held)
        self._held.clear()

    def drop(self, *paths: str) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


#: Rows of a table of ids up to which it is broadcast (8 bytes each, counted before).
MOST_BROADCAST_IDS = 2_000_000


def rows_with_ids(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``column`` is in the one column of ``ids`` (null matches null): by broadcast when few are counted, else by a shuffle."""
    found = ids.distinct().toDF("_wanted")
    few = found.limit(MOST_BROADCAST_IDS + 1).count() <= MOST_BROADCAST_IDS
    return df.join(F.broadcast(found) if few else found, F.col(column).eqNullSafe(F.col("_wanted")), "left_semi")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for the jobs run inside (long rows)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def packed(df: DataFrame, keep: list[str] | None = None) -> Column:
    """All (or the named) input columns as one struct, so that an operator's own columns can't clash with them."""
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in (df.columns if keep is None else keep)])


def unpacked(struct: str, columns: list[str], new: list[str]) -> list[Column]:
    """The input columns again; one that has the name of an added column gives way to it."""
    return [F.col(struct).getField(c).alias(c) for c in columns if c not in new]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without_spaces(text: Column) -> Column:
    """Null as empty; every separator deleted."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-separators (null: 0), counted by the places where a run begins."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
