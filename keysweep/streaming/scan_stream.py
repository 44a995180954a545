"""Row-level detection as a Structured Streaming query.

Filters, line split, matching, masking and the (static, broadcast) catalog join
are all stateless per row, so the batch plan runs unchanged on a stream in
append mode.  Roll-ups stay batch jobs over the appended detections table.
The checkpoint and the output live in the shared checkpoint folder, so a
restarted query resumes where it stopped.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from keysweep.operators import detect as D
from keysweep.session import shared_dir
from keysweep.sources import derived


def document_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int = 256) -> DataFrame:
    """New ``documents`` parquet files arriving in ``sf_dir`` as a stream, single files or parts in folders of that name; rows stay
    in the splits they are read in."""
    path = f"{sf_dir.rstrip('/')}/documents*.parquet"
    return (spark.readStream.schema(spark.read.parquet(path).schema)
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


def detection_stream(spark: SparkSession, docs: DataFrame) -> DataFrame:
    files = spark.sql(derived.spark_sql_text("seeded_documents"), documents=docs)
    return D.detections(files)


def start_detection_stream(spark: SparkSession, sf_dir: str, out: str, checkpoint: str, available_now: bool = True):
    q = (detection_stream(spark, document_stream(spark, sf_dir))
         .writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", out))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    return q.start()


def run_detection_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drain everything available, then return the appended detections."""
    base = shared_dir(spark, "scan-stream")
    out, ck = os.path.join(base, "out"), os.path.join(base, "checkpoint")
    q = start_detection_stream(spark, sf_dir, out, ck)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(out)


def files_stream_detections(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 256,
                            value_salt: str | None = None) -> DataFrame:
    """X1 over any directory of ``files`` parquet (repository, branch, path,
    content[, size]): F1-F4 and detection with context, all stateless per row.
    F5 (the per-repository cap) needs the whole repository and stays batch."""
    from keysweep.operators import filters as FL
    from keysweep.sources.tables import FILES_SCHEMA
    stream = (spark.readStream.schema(FILES_SCHEMA)
              .option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    return D.detections(FL.keep_files(stream), with_context=True, value_salt=value_salt)


def start_files_stream(spark: SparkSession, source_dir: str, out: str, checkpoint: str | None = None,
                       available_now: bool = False, value_salt: str | None = None):
    """Append detections of new files to ``out``.  The checkpoint defaults to a folder beside ``out``: the same output
    always meets the same checkpoint, so a query that is started again goes on where it stopped."""
    checkpoint = checkpoint or out.rstrip("/") + "-checkpoint"
    q = (files_stream_detections(spark, source_dir, value_salt=value_salt)
         .writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", out))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    return q.start()
