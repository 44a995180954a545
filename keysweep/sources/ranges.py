"""Files that are too large for one row, read as byte ranges.

The text reader cuts a file into ranges of ``spark.sql.files.maxPartitionBytes``, reads a line that crosses a border with the
range it begins in, and tells each row's file and range.  Rows keep their order within a range.  So a line's number is its place
in the range, plus the lines of the ranges before it: one count per range, and a prefix sum over the ranges of a file.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysweep.operators.detect import CONTEXT_WIDTH
from keysweep.operators.filters import utf16_length
from keysweep.sources.tables import in_spans

MIN_PARTITIONS = "spark.sql.files.minPartitionNum"


@contextmanager
def same_ranges(spark: SparkSession) -> Iterator[None]:
    """While this holds, the reader cuts the same files into the same ranges and tasks, however many executors there are."""
    before = spark.conf.get(MIN_PARTITIONS, None)
    spark.conf.set(MIN_PARTITIONS, before or str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(MIN_PARTITIONS)


def read_lines(spark: SparkSession, root: str, over_bytes: int, glob: str | None = None, most_bytes: int | None = None,
               changed: list[tuple[int, int]] | None = None) -> DataFrame:
    """The lines of all files below ``root`` of more than ``over_bytes`` (and at most ``most_bytes``) bytes: file, file_size,
    range_start, row (rising within a range), line_text without its end, and bytes and units (UTF-16) with it.

    Other files are left out by their status and not read.  Invalid UTF-8 is replaced by U+FFFD.  A line is a row of at most
    2 GB; a byte order mark is not part of the first one.  ``changed`` as for ``tables.read_file_tree``."""
    reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    size = F.col("_metadata.file_size")
    wanted = size > over_bytes if most_bytes is None else (size > over_bytes) & (size <= most_bytes)
    if changed is not None:
        wanted = wanted & in_spans(F.col("_metadata.file_modification_time"), changed)
    text = F.make_valid_utf8("value")
    line = F.when(F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    return (reader.text(root).where(wanted)
            .select(F.col("_metadata.file_path").alias("file"), size.alias("file_size"),
                    F.col("_metadata.file_block_start").alias("range_start"), F.monotonically_increasing_id().alias("row"),
                    (F.octet_length("value") + 1).cast("long").alias("bytes"), text.alias("value"))
            .select("file", "file_size", "range_start", "row", "bytes", (utf16_length(F.col("value")) + 1).alias("units"),
                    line.alias("line_text")))


def range_counts(lines: DataFrame) -> DataFrame:
    """From ``read_lines`` to a row per range: first (row), lines, before (lines of the file's earlier ranges), units (UTF-16, of
    the whole file) and mark (whether the file has a byte order mark, which stands before its first line)."""
    each = lines.groupBy("file", "file_size", "range_start").agg(
        F.min("row").alias("first"), F.count(F.lit(1)).alias("lines"), F.sum("bytes").alias("bytes"), F.sum("units").alias("units"))
    earlier = Window.partitionBy("file").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    missing = F.col("file_size") - F.sum("bytes").over(whole)  # 3: a byte order mark; 1 less: no line end at the end
    return each.select("file", "file_size", "range_start", "first", "lines",
                       F.coalesce(F.sum("lines").over(earlier), F.lit(0).cast("long")).alias("before"),
                       (F.sum("units").over(whole) + F.when(missing.isin(-1, 2), -1).otherwise(0)
                        + F.when(missing >= 2, 1).otherwise(0)).alias("units"),
                       (missing >= 2).alias("mark"))


def numbered(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` (file, range_start, row, column, ...) with line, and column behind a byte order mark."""
    rows = rows.join(counts.select("file", "range_start", "first", "lines", "before", "mark"), ["file", "range_start"], "left")
    line = F.col("row") - F.col("first") + F.col("before") + 1
    known = (F.col("row") >= F.col("first")) & (F.col("row") < F.col("first") + F.col("lines"))
    # both passes cut files alike (``same_ranges``); if they ever did not, a wrong number must not pass
    line = F.when(known, line).otherwise(F.raise_error(F.concat(F.lit("ranges have changed between two passes over "), "file")).cast("long"))
    rows = rows.withColumn("line", line).withColumn("_marked", F.col("mark") & (F.col("line") == 1))
    if "context" in rows.columns:
        seen = F.col("_marked") & (F.col("column") <= CONTEXT_WIDTH)
        rows = rows.withColumn("context", F.when(seen, F.concat(F.lit("\ufeff"), "context")).otherwise(F.col("context")))
    return rows.withColumn("column", (F.col("column") + F.col("_marked").cast("int")).cast("int")).drop(
        "first", "lines", "before", "mark", "_marked")
