"""X1 with state: totals per repository that stay right when files arrive again, change or go.

Two queries.  The first detects, as the batch does, and keeps for each file (repository, branch, path) the version and the content
hash that it saw last, with the number of hits of each type.  A newer version with another content gives changes: what the old one
had is taken back, what the new one has is added.  The same content again, or an older version, changes nothing.  The second query
sums the changes by repository and writes the repositories that a batch touched; the latest row of each is its total.

Both have their checkpoint beside their output and go on where they stopped.  State is one small row per file, spread over
``spark.sql.shuffle.partitions`` stores; a repository with a third of all files is partial sums like any other.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keysweep import FILE_KEYS, REPO_KEYS
from keysweep import catalog as C
from keysweep.operators import detect as D
from keysweep.operators import filters as FL
from keysweep.operators import rollup as R

VERSIONS_SCHEMA = T.StructType([*[T.StructField(k, T.StringType()) for k in FILE_KEYS], T.StructField("version", T.LongType()),
                                T.StructField("content", T.StringType())])
CHANGES = ("repository string, branch string, path string, version long, files long, files_with_secrets long, type string, "
           "severity string, hits long")
STATE = "version long, hash string, hits string"


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Of one file: what its newest version in this batch changes against the last one seen."""
    hits: dict[tuple[int, str], Counter] = {}
    times: Counter = Counter()
    for frame in frames:
        for version, digest, kind, severity in zip(frame["version"], frame["hash"], frame["type"], frame["severity"]):
            # no hash: the file is gone, or one that isn't scanned
            one = (int(version), digest if isinstance(digest, str) else "")
            found = hits.setdefault(one, Counter())
            if isinstance(kind, str):
                found[f"{kind}\t{severity}"] += 1
            else:
                times[one] += 1  # the row of the file itself
    (version, digest), new = max(hits.items(), key=lambda x: x[0])
    new = Counter({k: n // times[version, digest] for k, n in new.items()})
    last, known, old = (*state.get[:2], Counter(json.loads(state.get[2]))) if state.exists else (None, "", Counter())
    if last is not None and version <= last:
        return
    state.update((version, digest, json.dumps(new if digest != known else old)))
    if digest == known:
        return
    rows = [(*key, version, int(digest != "") - int(known != ""), int(bool(new)) - int(bool(old)), None, None, 0)]
    rows += [(*key, version, 0, 0, *k.split("\t"), new[k] - old[k]) for k in sorted(new | old) if new[k] != old[k]]
    yield pd.DataFrame(rows, columns=[f.split()[0] for f in CHANGES.split(", ")])


def file_changes(versions: DataFrame) -> DataFrame:
    """From versions of files (repository, branch, path, version, content), a stream, to the changes of what they hold.

    Null content, and a version that F1, F2 or F4 leaves out, is a file that is gone.  Versions of a file may come in any order
    and repeatedly; of two contents of one version the one with the larger hash counts, if they come in one batch, else the first."""
    content = F.when(FL.skip_reason(F.col("path"), F.col("content")).isNull(), F.col("content"))
    marked = versions.select(*FILE_KEYS, "version", content.alias("content")).withColumn("hash", F.sha2(F.col("content"), 256))
    rows = D.detections(marked, keys=[*FILE_KEYS, "version", "hash"], file_rows=True)
    return (rows.select(*FILE_KEYS, "version", "hash", "type", "severity").groupBy(*FILE_KEYS)
            .applyInPandasWithState(_changes, CHANGES, STATE, "append", GroupStateTimeout.NoTimeout))


def totals(changes: DataFrame) -> DataFrame:
    """Per repository the sums of its changes: files, files_with_secrets, secrets and the four severity counts."""
    return changes.groupBy(*REPO_KEYS).agg(
        F.sum("files").alias("files"), F.sum("files_with_secrets").alias("files_with_secrets"), F.sum("hits").alias("secrets"),
        *[F.sum(F.when(F.col("severity") == s, F.col("hits")).otherwise(0)).alias(s) for s in C.SEVERITIES])


def start_changes(versions: DataFrame, out: str, available_now: bool = False):
    """The first query: changes appended to ``out``."""
    q = (file_changes(versions).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", out.rstrip("/") + "-checkpoint").option("path", out))
    return _triggered(q, available_now).start()


def start_totals(spark: SparkSession, changes: str, out: str, available_now: bool = False):
    """The second query: totals of the repositories that a batch touched, one folder per batch; a batch that is run again after
    a failure writes its folder again."""
    stream = spark.readStream.schema(CHANGES).parquet(changes)
    out = out.rstrip("/")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = totals(stream).writeStream.outputMode("update").option("checkpointLocation", out + "-checkpoint").foreachBatch(write)
    return _triggered(q, available_now).start()


def current_totals(spark: SparkSession, out: str) -> DataFrame:
    """The latest total of every repository, with risk score and compliance status; repositories without files are left out."""
    fields = ["files", "files_with_secrets", "secrets", *C.SEVERITIES]
    schema = ", ".join(f"{k} string" for k in REPO_KEYS) + ", " + ", ".join(f"{k} long" for k in fields) + ", batch long"
    rows = spark.read.schema(schema).parquet(out).groupBy(*REPO_KEYS).agg(F.max_by(F.struct(*fields), "batch").alias("t"))
    rows = rows.where("t.files > 0").select(*REPO_KEYS, "t.*")
    score = R.risk_score(*(F.col(s) for s in C.SEVERITIES))
    return rows.withColumn("risk_score", score).withColumn(
        "compliance_status", R.compliance(F.col("risk_score"), F.col("critical"), F.col("high")))


def drain(spark: SparkSession, versions: DataFrame, base: str) -> DataFrame:
    """Both queries over all that is there now, with their tables below ``base``; returns the totals."""
    for q in (lambda: start_changes(versions, f"{base}/changes", True), lambda: start_totals(spark, f"{base}/changes", f"{base}/totals", True)):
        running = q()
        running.awaitTermination()
        if running.exception() is not None:
            raise RuntimeError(str(running.exception()))
    return current_totals(spark, f"{base}/totals")


def _triggered(writer, available_now: bool):
    return writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
