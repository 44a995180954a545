"""The five tools as set-at-a-time DataFrame functions.

Each takes a table of requests or inputs (many repositories or snippets at once)
instead of one JSON call, and returns the tool's result shape as columns.

  scan_repository(files)         -> (reports, file results with nested detections)
  scan_code(snippets)            -> one row per valid snippet: path, count, detections[], severity, advice[]
  analyze_security(files)        -> report + analysis per repository
  get_secret_types(spark)        -> the catalog listing with totals
  validate_secret(requests)      -> offline verdict per (type, value)
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysweep import FILE_KEYS, REPO_KEYS
from keysweep import catalog as C
from keysweep.operators import detect as D
from keysweep.operators.blocks import with_blocks
from keysweep.operators import quality as QL
from keysweep.operators import rollup as R
from keysweep.plans.corpus_scan import scan_corpus
from keysweep.sources.files import snippet_files
from keysweep.session import checkpoint_root
from keysweep.sources.sinks import TOP_TYPES, analysis_reports, scan_reports, write_parquet_table, write_reports


def valid_requests(requests: DataFrame) -> DataFrame:
    """request_id, repository, branch and path (null: the whole repository) of the valid scan requests, each once."""
    from keysweep.functions.mask import repo_key
    return (QL.valid(QL.check_scan_requests(requests))
            .select("request_id", repo_key(F.col("owner"), F.col("repo")).alias("repository"), "branch",
                    F.nullif("path", F.lit("")).alias("path")).distinct())


def requested_files(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Files selected by valid scan requests (owner, repo, branch, path): a request without path selects its whole
    repository+branch, one with a path that file.  Content is joined with the two sets of keys only, each broadcast
    when its checked size allows."""
    from keysweep.operators.filters import broadcast_if_small
    req = valid_requests(requests)
    whole = req.where("path is null").select("repository", "branch").distinct().withColumn("_whole", F.lit(True))
    exact = req.where("path is not null").select("repository", "branch", "path").distinct().withColumn("_exact", F.lit(True))
    return (files.join(broadcast_if_small(whole), ["repository", "branch"], "left")
            .join(broadcast_if_small(exact), ["repository", "branch", "path"], "left")
            .where("_whole or _exact").select(files.columns))


def by_request(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows of files (repository, branch, path, ...) once for each valid request that selects them, with its request_id."""
    whole = requests.where("path is null").select("request_id", "repository", "branch")
    exact = requests.where("path is not null").select("request_id", "repository", "branch", "path")
    return (rows.join(whole, ["repository", "branch"]).select("request_id", *rows.columns)
            .unionByName(rows.join(exact, ["repository", "branch", "path"]).select("request_id", *rows.columns)))


def scan_repository(files: DataFrame, requests: DataFrame | None = None,
                    value_salt: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Files (repository, branch, path, content, size) -> (scan reports, file results).

    With ``requests`` only the requested files are scanned, and reports and results are those of each valid request by
    itself (request_id): of its repository, or of the one file that it names; zeros when nothing readable was found (J2)."""
    if requests is None:
        kept, dets, _ = scan_corpus(files, with_context=True, value_salt=value_salt, blocks=True)
        return scan_reports(kept, dets), R.file_results(dets, nested=True)
    from keysweep.functions.mask import default_path_label
    kept, dets, _ = scan_corpus(requested_files(files, requests), with_context=True, value_salt=value_salt, blocks=True)
    req = valid_requests(requests)
    keys = ["request_id", *REPO_KEYS]
    mine = by_request(dets, req)
    found = scan_reports(by_request(kept, req), mine, keys=keys).drop("path", "repository", "branch")
    zero = F.lit(0).cast("bigint")
    empty = F.struct(zero.alias("total_files"), zero.alias("files_with_secrets"), zero.alias("total_secrets"),
                     F.create_map(*[x for s in C.SEVERITIES for x in (F.lit(s), zero)]).alias("severity_breakdown"),
                     F.array().cast(TOP_TYPES).alias("top_secret_types"))
    reports = req.join(found, "request_id", "left").select(
        "request_id", "repository", "branch", default_path_label(F.col("path")).alias("path"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
          for c in ("total_files_scanned", "files_with_secrets", "total_secrets_found")],
        F.coalesce("summary", empty).alias("summary"))
    return reports, R.file_results(mine, keys=["request_id", *FILE_KEYS], nested=True)


def run_request_job(files: DataFrame, requests: DataFrame, out_dir: str, value_salt: str | None = None) -> dict[str, str]:
    """The scan of a table of requests (request_id, owner, repo, branch, path): the reports of the valid ones as JSON lines, their
    file results, and the others with what is wrong with them, below ``out_dir``."""
    reports, results = scan_repository(files, requests, value_salt)
    paths = {k: os.path.join(out_dir, k) for k in ("reports", "file_results", "rejected")}
    write_reports(reports, paths["reports"])
    write_parquet_table(results, paths["file_results"])
    write_parquet_table(QL.check_scan_requests(requests).where(F.size("violations") > 0), paths["rejected"])
    return paths


def scan_code(snippets: DataFrame) -> DataFrame:
    """Snippets (snippet_id, code, path) -> per valid snippet: path ('inline' when
    missing), detections_found, detections[], severity ('none' when clean) and
    recommendations[] (empty when clean).  Invalid rows are left out; see
    ``operators.quality.check_snippets`` for their violations."""
    snips = snippet_files(QL.valid(QL.check_snippets(snippets)))
    keys = ["snippet_id", "path"]
    checkpoint_root(snippets.sparkSession)
    dets = with_blocks(D.detections(snips, rules=[*C.RULES, *C.BLOCK_MARKERS], keys=keys, with_context=True).checkpoint(), keys)
    # one pass: the nested results carry all that the advice is made from
    per = R.file_results(dets, keys=keys, nested=True)
    first = F.array_distinct(F.transform("results", lambda d: d["recommendation"]))
    per = per.withColumn("recommendations", F.array_distinct(F.concat(first, F.array(*[F.lit(x) for x in C.SNIPPET_ADVICE]))))
    j = snips.select("snippet_id", "path").join(per.drop("path"), "snippet_id", "left")
    return j.select("snippet_id", "path",
                    F.coalesce("detections", F.lit(0)).cast("bigint").alias("detections_found"),
                    F.coalesce("results", F.array().cast(per.schema["results"].dataType)).alias("detections"),
                    F.coalesce("severity", F.lit("none")).alias("severity"),
                    F.coalesce("recommendations", F.array().cast("array<string>")).alias("recommendations"))


def analyze_security(files: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Files -> scan report plus ``analysis`` (score, status, counts, steps,
    recommendations), with score, status and steps also at top level.

    With ``requests`` (owner, repo, branch; any path is ignored: the analysis is
    always of the whole repository) only those repositories are scanned."""
    if requests is not None:
        files = requested_files(files, requests.withColumn("path", F.lit(None).cast("string")))
    kept, dets, _ = scan_corpus(files, blocks=True)
    return analysis_reports(kept, dets)


def get_secret_types(spark: SparkSession) -> DataFrame:
    """The catalog listing: name, category, description, severity, plus the
    number of types and the distinct categories (a fixed 37-row table)."""
    cat = D.catalog_df(spark)
    return cat.select(F.col("type").alias("name"), "category", "description", "severity",
                      F.lit(len(C.RULES)).alias("total_types"),
                      F.array(*[F.lit(c) for c in dict.fromkeys(r.category for r in C.RULES)]).alias("categories"))


def validate_secret(requests: DataFrame) -> DataFrame:
    """Requests (request_id, secret_type, value) -> status per valid request."""
    valid = QL.valid(QL.check_secret_requests(requests)).drop("violations")
    return D.validate_secrets(valid, D.catalog_df(requests.sparkSession))
