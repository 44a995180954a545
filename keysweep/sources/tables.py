"""Readers for the given parquet tables and the tables derived from them."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysweep.sources import derived

GIVEN_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

FILES_SCHEMA = T.StructType([
    T.StructField("repository", T.StringType()),
    T.StructField("branch", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("size", T.LongType()),
])


#: Session setting by which a caller asks for the rows of text inputs to be dealt out over so many partitions (by hash of
#: their keys); unset or 0: they stay where the reader puts them.  Row groups that are too large for the cluster are better
#: split by ``spark.sql.files.maxPartitionBytes`` or by writing smaller ones.
SPREAD_CONF = "keysweep.input.spread"


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Deals the rows out if the session asks for it (``SPREAD_CONF``), those of a stream too: no state comes of it."""
    n = int(df.sparkSession.conf.get(SPREAD_CONF, "0"))
    return df.repartition(n, *keys) if n > 0 else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def derived_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input (see ``sources.derived``) as a lazily planned DataFrame."""
    text = derived.spark_sql_text(name)
    frames = {t: read_table(spark, sf_dir, t) for t in derived.TABLE_NAMES if "{" + t + "}" in text}
    return spark.sql(text, **frames)


def seeded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_table(spark, sf_dir, "seeded_documents")


def repo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_table(spark, sf_dir, "repo_files")


def relative_path(spark: SparkSession, root: str, path: Column, encoded: bool = False) -> Column:
    """``path`` of a file source without ``root``, which is taken as its file system writes it (scheme and authority included).
    ``encoded``: the path is a URI, as in the metadata of files."""
    there = spark._jvm.org.apache.hadoop.fs.Path(root)
    prefix = there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toString().rstrip("/") + "/"
    if encoded:  # a plus sign stands for itself there
        path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(path, "^" + _re_escape(prefix), "")


def in_spans(time: Column, spans: list[tuple[int, int]]) -> Column:
    """Whether a time lies in one of the spans; file sources test it on the status of a file."""
    found = F.lit(False)
    for low, high in spans:
        found = found | ((time >= F.timestamp_micros(F.lit(low))) & (time <= F.timestamp_micros(F.lit(high))))
    return found


def _tree(spark: SparkSession, root: str, glob: str | None, **options) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").options(**options)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(root)


def list_tree(spark: SparkSession, root: str, repository: str, branch: str = "main", glob: str | None = None) -> DataFrame:
    """Every file below ``root`` by its status: repository, branch, path, size and modified; no content is read."""
    return _tree(spark, root, glob).select(
        F.lit(repository).alias("repository"), F.lit(branch).alias("branch"), relative_path(spark, root, F.col("path")).alias("path"),
        F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_file_tree(spark: SparkSession, root: str, repository: str, branch: str = "main", glob: str | None = None,
                   max_size: int | None = None, max_bytes: int | None = None, skip_unreadable: bool = False,
                   changed: list[tuple[int, int]] | None = None) -> DataFrame:
    """S1 for a checked-out tree: every file below ``root`` as a ``files`` row.

    ``root`` may be on any file system that Spark reads; paths are relative to it.
    Bytes are decoded as UTF-8 with invalid sequences replaced by U+FFFD.  Files
    can be excluded before any byte is read: by name with ``glob``
    (``pathGlobFilter``), and by size, if ``max_size`` is given -- a file of more than 3 * ``max_size``
    bytes has more than ``max_size`` UTF-16 units, so F3 would drop it anyway -- or ``max_bytes``; the
    ``length`` filter is evaluated by the binaryFile source on the file status.  With ``skip_unreadable`` a file that can't be
    read, or is gone, is left out instead of ending the job (``plans.tree_scan`` then lists it).  ``changed``: only files whose
    time of change lies in one of these spans (microseconds, both ends included) are read.
    """
    skip = {"ignoreCorruptFiles": "true", "ignoreMissingFiles": "true"} if skip_unreadable else {}
    raw = _tree(spark, root, glob, **skip)
    if max_size is not None:
        raw = raw.where(F.col("length") <= 3 * max_size)
    if max_bytes is not None:
        raw = raw.where(F.col("length") <= max_bytes)
    if changed is not None:
        raw = raw.where(in_spans(F.col("modificationTime"), changed))
    return raw.select(
        F.lit(repository).alias("repository"),
        F.lit(branch).alias("branch"),
        relative_path(spark, root, F.col("path")).alias("path"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
        F.col("length").alias("size"),
    )


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)
