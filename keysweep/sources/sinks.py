"""Report sinks (S7, S8) and the batch scan job.

Reports are one row per (repository, branch) holding only bounded nested values:
the severity map (one entry per severity) and the top-10 type list.  The per-file
results list is *not* nested into the repository row -- a repository can hold a
third of all files -- it is its own table (``file_results``), written next to it, and
a table of nested lists in pieces of bounded size (``results``, see ``result_chunks``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysweep import FILE_KEYS, REPO_KEYS
from keysweep import catalog as C
from keysweep.operators import rollup as R
from keysweep.operators.prefix import running_total

TOP_TYPES = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("count", T.LongType())]))
SUMMARY = T.StructType([
    T.StructField("total_files", T.LongType()),
    T.StructField("files_with_secrets", T.LongType()),
    T.StructField("total_secrets", T.LongType()),
    T.StructField("severity_breakdown", T.MapType(T.StringType(), T.LongType())),
    T.StructField("top_secret_types", TOP_TYPES),
])
REPORT_SCHEMA = T.StructType([
    T.StructField("repository", T.StringType()),
    T.StructField("branch", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("total_files_scanned", T.LongType()),
    T.StructField("files_with_secrets", T.LongType()),
    T.StructField("total_secrets_found", T.LongType()),
    T.StructField("summary", SUMMARY),
    T.StructField("files_skipped", T.LongType()),
])


def file_type_counts(dets: DataFrame, keys=FILE_KEYS) -> DataFrame:
    """The one aggregate every repository figure derives from: (file, type, severity) -> n.

    The report branches (files with hits, severity map, top types) all start from
    this partial aggregate of the (checkpointed) detections."""
    return dets.groupBy(*keys, "type", "severity").agg(F.count(F.lit(1)).alias("n"))


def scan_reports(kept: DataFrame, dets: DataFrame, path_label: str = C.DEFAULT_PATH_LABEL,
                 skipped: DataFrame | None = None, keys=REPO_KEYS) -> DataFrame:
    """One report per (repository, branch); with ``skipped`` also how many files were left out (``files_skipped``), and
    repositories of which nothing was scanned report zeros."""
    ftc = file_type_counts(dets, [*keys, "path"])
    files = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_files_scanned"))
    if skipped is not None:
        both = kept.select(*keys, F.lit(0).alias("s")).unionByName(skipped.select(*keys, F.lit(1).alias("s")))
        files = both.groupBy(*keys).agg(F.count_if(F.col("s") == 0).alias("total_files_scanned"),
                                             F.count_if(F.col("s") == 1).alias("files_skipped"))
    per_file = ftc.groupBy(*keys, "path").agg(F.sum("n").alias("n"))
    per_repo = per_file.groupBy(*keys).agg(F.count(F.lit(1)).alias("files_with_secrets"),
                                                 F.sum("n").cast("bigint").alias("total_secrets_found"))
    sev = ftc.groupBy(*keys, "severity").agg(F.sum("n").cast("bigint").alias("count"))
    fixed = sev.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("severity", "count"))).alias("seen"))
    zero = F.create_map(*[x for s in C.SEVERITIES for x in (F.lit(s), F.lit(0).cast("bigint"))])
    tc = ftc.groupBy(*keys, "type").agg(F.sum("n").cast("bigint").alias("count"))
    top = R.top_types_array(tc, 10, keys)
    j = files.join(per_repo, keys, "left").join(fixed, keys, "left").join(top, keys, "left")
    fw = F.coalesce("files_with_secrets", F.lit(0)).cast("bigint")
    ts = F.coalesce("total_secrets_found", F.lit(0)).cast("bigint")
    # zero defaults for the four severities, then whatever was seen (incl. unrecognised ones)
    breakdown = F.map_concat(F.map_filter(zero, lambda k, v: ~F.coalesce(F.map_contains_key(F.col("seen"), k), F.lit(False))),
                             F.coalesce("seen", F.create_map().cast("map<string,bigint>")))
    return j.select(*keys, F.lit(path_label).alias("path"), "total_files_scanned",
                    fw.alias("files_with_secrets"), ts.alias("total_secrets_found"),
                    F.struct(fw.alias("total_files"), fw.alias("files_with_secrets"), ts.alias("total_secrets"),
                             breakdown.alias("severity_breakdown"),
                             F.coalesce("top_types", F.array().cast(TOP_TYPES)).alias("top_secret_types")).alias("summary"),
                    *(["files_skipped"] if skipped is not None else []))


def analysis_reports(kept: DataFrame, dets: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """Report + ``analysis`` struct, with score, status and steps also at top level."""
    rep = scan_reports(kept, dets, skipped=skipped)
    files = kept.select(*REPO_KEYS) if skipped is None else kept.select(*REPO_KEYS).unionByName(skipped.select(*REPO_KEYS))
    a = R.analyze(dets, repos=files.distinct())
    analysis = F.struct("risk_score", "compliance_status", *C.SEVERITIES, "remediation_steps", "recommendations")
    return rep.join(a.select(*REPO_KEYS, analysis.alias("analysis")), REPO_KEYS, "left").select(
        "*", F.col("analysis.risk_score").alias("risk_score"),
        F.col("analysis.compliance_status").alias("compliance_status"),
        F.col("analysis.remediation_steps").alias("remediation_steps"))


def result_chunks(dets: DataFrame, chunk_bytes: int = 1 << 20, keys=REPO_KEYS) -> DataFrame:
    """The results of a report, nested as the report carries them, in pieces: (keys, chunk, results), where results is a list of
    files, each with its path, severity, number of detections and the detections themselves.

    A chunk holds about ``chunk_bytes`` of detections as JSON, in the order of path, line, column and type, and so at most that and
    one detection more; chunks are numbered from 0 in each repository, and a repository of any size is as many rows as it needs.  A
    file that crosses a border is in both chunks, each with its part of the detections."""
    keys = list(keys)
    fields = [c for c in dets.columns if c not in (*keys, "path")]
    order = ["line", "column", "type"] + [c for c in fields if c not in ("line", "column", "type")]
    size = F.octet_length(F.to_json(F.struct("path", *order))).cast("long") + 1
    rows = running_total(dets, keys, ["path", "line", "column", "type"], size, "_before")
    rows = rows.withColumn("chunk", F.floor(F.col("_before") / chunk_bytes).cast("long"))
    # a detection that is larger than a chunk leaves numbers out
    numbers = rows.select(*keys, "chunk").distinct()
    numbers = running_total(numbers, keys, ["chunk"], F.lit(1).cast("long"), "_number")
    files = rows.groupBy(*keys, "chunk", "path").agg(
        R.rank_label(F.max(R.severity_rank())).alias("severity"), F.count(F.lit(1)).alias("count"),
        F.sort_array(F.collect_list(F.struct(*order))).alias("detections"))
    chunks = files.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list(F.struct("path", "severity", "count", "detections"))).alias("results"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "chunk"]]
    numbers = numbers.select(*[F.col(k).alias(f"_{k}") for k in [*keys, "chunk"]], "_number")
    return chunks.join(numbers, same).select(*keys, F.col("_number").alias("chunk"), "results")


def chunked_detections(chunks: DataFrame, keys=REPO_KEYS) -> DataFrame:
    """The detections of ``result_chunks``, a row each."""
    files = chunks.select(*keys, F.explode("results").alias("f"))
    return files.select(*keys, F.col("f.path").alias("path"), F.explode("f.detections").alias("d")).select(*keys, "path", "d.*")


def write_reports(reports: DataFrame, path: str) -> None:
    """JSON lines, one report per line (what the tool returned as JSON text)."""
    reports.write.mode("overwrite").option("compression", "gzip").json(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT_SCHEMA).json(path)


def write_parquet_table(df: DataFrame, path: str, records_per_file: int = 1_000_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", records_per_file).parquet(path)


def read_parquet_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def run_scan_job(spark: SparkSession, files: DataFrame, out_dir: str, value_salt: str | None = None,
                 **options) -> dict[str, str]:
    """The batch job: one checkpointed content pass (F1-F4, detection with context, and blocks that span lines), then
    detections, file results, skipped files with their reasons, scan reports and analysis written to ``out_dir`` from the
    compact table.  ``options`` as for ``scan_corpus``: max_size, max_files, skip_comments, drop_false_positives,
    drop_invalid."""
    from keysweep.plans.corpus_scan import scan_corpus
    return write_scan(scan_corpus(files, with_context=True, value_salt=value_salt, blocks=True, verdicts=True, **options), out_dir)


def run_tree_job(spark: SparkSession, root: str, repository: str, out_dir: str, branch: str = C.DEFAULT_BRANCH,
                 value_salt: str | None = None, previous: str | None = None, max_files: int | None = None, **options) -> dict[str, str]:
    """``run_scan_job`` over a checked-out tree (``plans.tree_scan``), files of any size.  ``previous``: the folder of an earlier
    run, another one than ``out_dir``; files that have not changed since aren't read again.  A run with ``max_files`` reads all."""
    from keysweep.plans.tree_scan import rescan_tree, scan_tree
    options |= dict(with_context=True, value_salt=value_salt, verdicts=True)
    if max_files is not None:
        return write_scan(scan_tree(spark, root, repository, branch, max_files=max_files, **options), out_dir)
    if previous is not None:
        previous = (read_parquet_table(spark, os.path.join(previous, "manifest")), read_parquet_table(spark, os.path.join(previous, "detections")))
    scan, manifest = rescan_tree(spark, root, repository, previous, branch, **options)
    paths = write_scan(scan, out_dir) | {"manifest": os.path.join(out_dir, "manifest")}
    write_parquet_table(manifest, paths["manifest"])
    return paths


def write_scan(scan, out_dir: str) -> dict[str, str]:
    """The tables of a scan below ``out_dir``; returns their folders."""
    kept, dets, skipped = scan
    paths = {k: os.path.join(out_dir, k) for k in ("detections", "file_results", "skipped", "reports", "analysis", "results")}
    write_parquet_table(skipped, paths["skipped"])
    write_parquet_table(dets, paths["detections"])
    write_parquet_table(R.file_results(dets, nested=True), paths["file_results"])
    write_reports(scan_reports(kept, dets, skipped=skipped), paths["reports"])
    write_reports(result_chunks(dets), paths["results"])
    write_parquet_table(analysis_reports(kept, dets, skipped), paths["analysis"])
    return paths
