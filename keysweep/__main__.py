"""Batch scan job.

  python -m keysweep --files <parquet table: repository, branch, path, content> --out <dir>
      [--repository-col C --branch-col C --path-col C --content-col C]   (e.g. any text table)
  python -m keysweep --files <files table> --requests <requests table> --out <dir>
  python -m keysweep --tree <checked-out directory> --repository org/name [--branch main] --out <dir>
  python -m keysweep --stream <directory of files parquet> --out <dir> [--available-now]
  python -m keysweep --versions <directory of file versions parquet> --out <dir> [--available-now]

Files of a tree may be of any size: large ones are read as byte ranges by many tasks.

Writes ``detections`` (masked values and context, ``failed_check``, ``end_line`` of private-key blocks), ``file_results``, ``skipped`` (files left
out, with the reason),
``reports`` (JSON lines) and ``analysis`` under ``--out``.  Cluster settings (master,
``spark.checkpoint.dir``, shuffle partitions) come from spark-submit.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from keysweep.api import run_request_job
from keysweep.session import get_spark
from keysweep.sources.sinks import run_scan_job, run_tree_job


def main(argv=None):
    ap = argparse.ArgumentParser(prog="keysweep")
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--files", help="parquet table of files")
    src.add_argument("--tree", help="directory to scan recursively")
    src.add_argument("--stream", help="directory receiving files parquet: append detections as they arrive")
    src.add_argument("--versions", help="directory receiving parquet of file versions (repository, branch, path, version, content): "
                                        "keep totals per repository right as files change")
    ap.add_argument("--available-now", action="store_true", help="with --stream: drain what is there, then stop")
    ap.add_argument("--repository", default="local/tree", help="repository when the table has no such column")
    ap.add_argument("--repository-col", default="repository")
    ap.add_argument("--branch-col", default="branch")
    ap.add_argument("--path-col", default="path")
    ap.add_argument("--content-col", default="content")
    ap.add_argument("--branch", default="main")
    ap.add_argument("--out", required=True)
    ap.add_argument("--master", default=None)
    ap.add_argument("--salt", default=None, help="adds value_hash = sha256(salt + value) to detections")
    ap.add_argument("--max-files", type=int, default=None, help="scan at most so many files of a repository (default: all)")
    ap.add_argument("--max-size", type=int, default=None, help="skip files of more UTF-16 units (default: none)")
    ap.add_argument("--skip-comments", action="store_true", help="leave out blank and comment lines")
    ap.add_argument("--requests", default=None, help="with --files: parquet of scan requests (request_id, owner, repo, branch, path); "
                                                     "reports are those of the requests")
    ap.add_argument("--previous", default=None, help="with --tree: the folder of an earlier run; unchanged files are not read again")
    ap.add_argument("--no-overlaps", action="store_true", help="of overlapping matches report the most specific one only")
    ap.add_argument("--blank-comments", action="store_true", help="leave out comments by file type, also those over several lines")
    ap.add_argument("--drop-false-positives", action="store_true", help="leave out placeholder and example values")
    ap.add_argument("--drop-invalid", action="store_true", help="leave out matches that fail a check of their type (alphabet, checksum, ...)")
    ap.add_argument("--checkpoint", default=None, help="with --stream: the query's checkpoint (default: one for each --out)")
    a = ap.parse_args(argv)
    spark = get_spark(a.master, app="keysweep-scan")
    if a.stream:
        from keysweep.streaming.scan_stream import start_files_stream
        q = start_files_stream(spark, a.stream, a.out, a.checkpoint, available_now=a.available_now, value_salt=a.salt)
        print(json.dumps({"stream": q.id, "detections": a.out}))
        q.awaitTermination()
        return
    if a.versions:
        from keysweep.streaming import totals_stream as T
        versions = spark.readStream.schema(T.VERSIONS_SCHEMA).parquet(a.versions)
        q = T.start_changes(versions, f"{a.out}/changes", a.available_now)
        if a.available_now:
            q.awaitTermination()
        t = T.start_totals(spark, f"{a.out}/changes", f"{a.out}/totals", a.available_now)
        print(json.dumps({"streams": [q.id, t.id], "changes": f"{a.out}/changes", "totals": f"{a.out}/totals"}))
        t.awaitTermination()
        return
    if a.files:
        t = spark.read.parquet(a.files)
        col = lambda name, default: F.col(name) if name in t.columns else F.lit(default)
        files = t.select(col(a.repository_col, a.repository).cast("string").alias("repository"),
                         col(a.branch_col, a.branch).cast("string").alias("branch"),
                         F.col(a.path_col).cast("string").alias("path"),
                         F.col(a.content_col).cast("string").alias("content"))
        files = files.withColumn("size", F.octet_length("content").cast("bigint"))
        if a.requests:
            print(json.dumps(run_request_job(files, spark.read.parquet(a.requests), a.out, a.salt)))
            return
    options = dict(value_salt=a.salt, max_files=a.max_files, max_size=a.max_size, skip_comments=a.skip_comments,
                   drop_false_positives=a.drop_false_positives, drop_invalid=a.drop_invalid,
                   blank_comments=a.blank_comments, no_overlaps=a.no_overlaps)
    print(json.dumps(run_tree_job(spark, a.tree, a.repository, a.out, a.branch, previous=a.previous, **options) if a.tree
                     else run_scan_job(spark, files, a.out, **options)))


if __name__ == "__main__":
    main()
