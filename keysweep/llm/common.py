"""Helpers shared by the corpus operators: tables, the shared folder, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysweep.session import shared_dir

#: Rows and bytes of one Arrow batch handed to Python; very long texts then travel in smaller batches.
BATCH_ROWS = 1000
BATCH_BYTES = 4 * 1024 * 1024
#: Rows of one part of a table of narrow rows, and the fewest parts of any.
PART_ROWS, LEAST_PARTS = 20_000, 8


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table; the path may belong to any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def narrow(df: DataFrame, id_col: str, text_col: str, more: dict[str, Column] | None = None) -> DataFrame:
    """Only the id (long) and the text (null: empty), and ``more`` under its names; other columns, whatever their names,
    play no part."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                     F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
                     *[column.alias(name) for name, column in (more or {}).items()])


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of a Python worker by the batch, not by the partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def broadcast_if_few(df: DataFrame, most: int = 1 << 16) -> DataFrame:
    """Broadcast if it has at most ``most`` rows, which are counted; else left to the planner. ``df`` should be a table."""
    return F.broadcast(df) if df.count() <= most else df


def in_parts(df: DataFrame, rows: int, each: int = PART_ROWS) -> DataFrame:
    """At most so many parts as ``rows`` (what df has or was made from) are worth, at ``each`` a part. To write a few rows in as
    many files as a shuffle has partitions takes longer than to make them, and on a local disk starts a process (chmod) a file."""
    return df.coalesce(max(LEAST_PARTS, rows // each))


def materialize(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again: lineage ends there, compressed, and a lost
    executor costs nothing that was finished before.  ``paths`` gets the folder, for ``remove``."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of ``materialize`` that nothing will read again."""
    for path in paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    paths.clear()


def flush(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One Arrow batch of collected tuples (none for no rows)."""
    if rows:
        columns = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
