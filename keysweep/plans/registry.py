"""Registered queries: one per operator of the inventory, each a Spark plan over the
given tables plus (where SQL can say it) the equivalent DuckDB oracle query.

Spark side: ``SPARK[name](spark, sf_dir) -> DataFrame``.
Oracle side: ``ORACLE[name] -> str`` (views = the given tables).
Column names and types agree between the two; arrays are joined into strings so
the value hash is order-stable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysweep import FILE_KEYS, REPO_KEYS
from keysweep import catalog as C
from keysweep.operators import detect as D
from keysweep.operators import rollup as R
from keysweep.plans import sqlgen as Q
from keysweep.sources import tables as S
from keysweep.sources.derived import duckdb_sql as derived_sql

SPARK: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        SPARK[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# Flagship: risk per repository over the seeded documents.
# ---------------------------------------------------------------------------

def repo_risk_df(files: DataFrame) -> DataFrame:
    """(repository, branch, files, secrets, critical, high, medium, low, risk_score,
    compliance_status): every repository, clean ones with zeros."""
    dets = D.detections(files)
    counts = dets.groupBy(*REPO_KEYS).agg(F.count(F.lit(1)).alias("secrets"), *R._severity_counts())
    nfiles = files.groupBy(*REPO_KEYS).agg(F.count(F.lit(1)).alias("files"))
    j = nfiles.join(counts, REPO_KEYS, "left")
    c, h, m, low = (F.coalesce(F.col(s), F.lit(0)).cast("bigint") for s in C.SEVERITIES)
    score = R.risk_score(c, h, m, low)
    return j.select(*REPO_KEYS, "files", F.coalesce("secrets", F.lit(0)).cast("bigint").alias("secrets"),
                    c.alias("critical"), h.alias("high"), m.alias("medium"), low.alias("low"),
                    score.alias("risk_score"), R.compliance(score, c, h).alias("compliance_status"))


_REPO_RISK_SQL = f"""
WITH files AS ({Q.files()}),
det AS {Q.detections(Q.files())},
sev AS (SELECT repository, branch, count(*) AS secrets, {Q.severity_counts()} FROM det GROUP BY repository, branch),
fc AS (SELECT repository, branch, count(*) AS files FROM files GROUP BY repository, branch),
j AS (SELECT fc.repository, fc.branch, fc.files, CAST(coalesce(secrets, 0) AS BIGINT) AS secrets,
             CAST(coalesce(critical, 0) AS BIGINT) AS critical, CAST(coalesce(high, 0) AS BIGINT) AS high,
             CAST(coalesce(medium, 0) AS BIGINT) AS medium, CAST(coalesce(low, 0) AS BIGINT) AS low
      FROM fc LEFT JOIN sev ON fc.repository = sev.repository AND fc.branch = sev.branch)
SELECT repository, branch, files, secrets, critical, high, medium, low, {Q.risk_score()} AS risk_score,
       {Q.compliance(Q.risk_score())} AS compliance_status
FROM j
"""


@register("repo_risk", _REPO_RISK_SQL)
def q_repo_risk(spark, sf_dir):
    return repo_risk_df(S.seeded_documents(spark, sf_dir))


# ---------------------------------------------------------------------------
# Order 1: detection core.
# ---------------------------------------------------------------------------

@register("detect", f"SELECT repository, branch, path, type, line, \"column\", value FROM {Q.detections(Q.files())}")
def q_detect(spark, sf_dir):
    """Every match of every catalog rule, one row each (value masked)."""
    return D.detections(S.seeded_documents(spark, sf_dir)).select(*FILE_KEYS, "type", "line", "column", "value")


# Shared SQL pieces (oracle side).
def _det_sql(files_sql: str | None = None, **kw) -> str:
    return Q.detections(files_sql or Q.files(), **kw)


_RAW_SQL = f"""(SELECT h.repository, h.branch, h.path, h.line, h."column", h.raw, c.type, c.severity, c.pattern
  FROM {Q.raw_hits(Q.files())} h JOIN {Q.catalog_values()} c ON h.rule_id = c.rule_id)"""


def _with_raw(spark, sf_dir):
    files = S.seeded_documents(spark, sf_dir)
    return D.enrich(D.detect_raw(files), D.catalog_df(spark))


@register("line_column", f"""SELECT repository, branch, path, type, line, "column",
  CAST("column" + length(raw) - 1 AS INTEGER) AS end_column FROM {_RAW_SQL} r""")
def q_line_column(spark, sf_dir):
    """1-based line and column (code points) of each match, and its last column."""
    h = _with_raw(spark, sf_dir)
    return h.select(*FILE_KEYS, "type", F.col("line").cast("int").alias("line"),
                    F.col("column").cast("int").alias("column"),
                    (F.col("column") + F.length("raw") - 1).cast("int").alias("end_column"))


@register("mask_value", f"""SELECT repository, branch, path, type, line, "column", {Q.mask_value('raw')} AS value,
  CAST(length(raw) AS INTEGER) AS value_length FROM {_RAW_SQL} r""")
def q_mask_value(spark, sf_dir):
    """Masked value (ends only, by length) and the original length."""
    from keysweep.functions.mask import mask_value
    h = _with_raw(spark, sf_dir)
    return h.select(*FILE_KEYS, "type", F.col("line").cast("int").alias("line"),
                    F.col("column").cast("int").alias("column"), mask_value(F.col("raw")).alias("value"),
                    F.length("raw").alias("value_length"))


@register("enrich", f"SELECT * FROM {_det_sql()} d")
def q_enrich(spark, sf_dir):
    """The full detection record with catalog fields."""
    return D.detections(S.seeded_documents(spark, sf_dir))


@register("file_severity", f"""
WITH files AS ({Q.files()}), det AS {_det_sql()},
fr AS (SELECT repository, branch, path, count(*) AS n, max({Q.severity_rank()}) AS rk FROM det GROUP BY ALL)
SELECT f.repository, f.branch, f.path, CAST(coalesce(fr.n, 0) AS BIGINT) AS detections, {Q.rank_label('fr.rk')} AS severity
FROM files f LEFT JOIN fr ON f.repository = fr.repository AND f.branch = fr.branch AND f.path = fr.path""")
def q_file_severity(spark, sf_dir):
    """A1: max severity per file; files without hits are 'none'."""
    files = S.seeded_documents(spark, sf_dir)
    fr = (D.detections(files).groupBy(*FILE_KEYS)
          .agg(F.count(F.lit(1)).alias("n"), F.max(R.severity_rank()).alias("rk")))
    j = files.select(*FILE_KEYS).join(fr, FILE_KEYS, "left")
    return j.select(*FILE_KEYS, F.coalesce("n", F.lit(0)).cast("bigint").alias("detections"),
                    R.rank_label(F.col("rk")).alias("severity"))


@register("severity_counts", f"""SELECT repository, branch, {Q.severity_counts()} FROM {_det_sql()} d GROUP BY ALL""")
def q_severity_counts(spark, sf_dir):
    """A3: critical/high/medium/low counts per repository (repos with hits)."""
    return D.detections(S.seeded_documents(spark, sf_dir)).groupBy(*REPO_KEYS).agg(*R._severity_counts())


@register("risk_score", f"""SELECT repository, branch, critical, high, medium, low, {Q.risk_score()} AS risk_score
FROM (SELECT repository, branch, {Q.severity_counts()} FROM {_det_sql()} d GROUP BY ALL) s""")
def q_risk_score(spark, sf_dir):
    """min(100, 10c + 5h + 2m + l) per repository."""
    s = D.detections(S.seeded_documents(spark, sf_dir)).groupBy(*REPO_KEYS).agg(*R._severity_counts())
    return s.select(*REPO_KEYS, *C.SEVERITIES, R.risk_score(*(F.col(x) for x in C.SEVERITIES)).alias("risk_score"))


@register("compliance", f"""SELECT repository, branch, risk_score, {Q.compliance('risk_score')} AS compliance_status
FROM (SELECT repository, branch, critical, high, {Q.risk_score()} AS risk_score
      FROM (SELECT repository, branch, {Q.severity_counts()} FROM {_det_sql()} d GROUP BY ALL) s) t""")
def q_compliance(spark, sf_dir):
    """Compliance status from score and critical/high counts."""
    s = D.detections(S.seeded_documents(spark, sf_dir)).groupBy(*REPO_KEYS).agg(*R._severity_counts())
    score = R.risk_score(*(F.col(x) for x in C.SEVERITIES))
    return s.select(*REPO_KEYS, score.alias("risk_score"),
                    R.compliance(score, F.col("critical"), F.col("high")).alias("compliance_status"))


# ---------------------------------------------------------------------------
# Order 2: file filters, sources, coverage.
# ---------------------------------------------------------------------------

from keysweep.operators import filters as FL  # noqa: E402
from keysweep.operators import quality as QL  # noqa: E402
from keysweep.functions.regex import sql_string  # noqa: E402

DEMO_MAX_SIZE = 16384      # F3/F6 queries: a size limit that the test corpus crosses
DEMO_MAX_FILES = 5         # F5 query: a per-repository file cap that the test corpus crosses

_BIN = sql_string(FL.binary_regex())
_SKIP = sql_string(FL.skip_dir_regex())
_UTF16 = "(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"
_REPO_FILES = f"({Q.files('repo_files')})"


def _kept_sql(max_size: int | None = None) -> str:
    size = "" if max_size is None else f"AND {_UTF16.format('content')} <= {max_size}"
    return (f"(SELECT * FROM {_REPO_FILES} f WHERE NOT regexp_matches(lower(path), {_BIN}) "
            f"AND NOT regexp_matches(path, {_SKIP}) AND content IS NOT NULL AND content <> '' {size})")


def _capped_sql(max_files: int | None = None, max_size: int | None = None) -> str:
    if max_files is None:
        return f"(SELECT repository, branch, path, content, size FROM {_kept_sql(max_size)} k)"
    return (f"(SELECT repository, branch, path, content, size FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY repository, branch ORDER BY path) AS rn FROM {_kept_sql(max_size)} k) x "
            f"WHERE rn <= {max_files})")


@register("drop_binary", f"SELECT repository, branch, path FROM {_REPO_FILES} f WHERE NOT regexp_matches(lower(path), {_BIN})")
def q_drop_binary(spark, sf_dir):
    """files whose path has no binary suffix (case-insensitive)."""
    return S.repo_files(spark, sf_dir).where(~FL.is_binary(F.col("path"))).select(*FILE_KEYS)


@register("drop_skip_dirs", f"SELECT repository, branch, path FROM {_REPO_FILES} f WHERE NOT regexp_matches(path, {_SKIP})")
def q_drop_skip_dirs(spark, sf_dir):
    """files outside node_modules/.git/dist/build/.next/vendor/__pycache__."""
    return S.repo_files(spark, sf_dir).where(~FL.in_skip_dir(F.col("path"))).select(*FILE_KEYS)


@register("drop_large", f"""SELECT repository, branch, path, CAST({_UTF16.format('content')} AS BIGINT) AS units
FROM {_REPO_FILES} f WHERE {_UTF16.format('content')} <= {DEMO_MAX_SIZE}""")
def q_drop_large(spark, sf_dir):
    """files whose UTF-16 length is within the limit (equal stays)."""
    f = S.repo_files(spark, sf_dir)
    return f.where(FL.fits_size(F.col("content"), DEMO_MAX_SIZE)).select(
        *FILE_KEYS, FL.utf16_length(F.col("content")).alias("units"))


@register("drop_empty", f"SELECT repository, branch, path FROM {_REPO_FILES} f WHERE content IS NOT NULL AND content <> ''")
def q_drop_empty(spark, sf_dir):
    """files with non-empty content."""
    return S.repo_files(spark, sf_dir).where(FL.has_content(F.col("content"))).select(*FILE_KEYS)


@register("cap_files", f"SELECT repository, branch, path FROM {_capped_sql(DEMO_MAX_FILES)} c")
def q_cap_files(spark, sf_dir):
    """at most N kept files per repository+branch, first by path (skew-safe top-k)."""
    kept = FL.keep_files(S.repo_files(spark, sf_dir))
    return FL.cap_files(kept, DEMO_MAX_FILES).select(*FILE_KEYS)


@register("skip_reason", f"""SELECT repository, branch, path,
  CASE WHEN regexp_matches(lower(path), {_BIN}) THEN 'binary' WHEN regexp_matches(path, {_SKIP}) THEN 'skip_dir'
       WHEN content IS NULL OR content = '' THEN 'no_content'
       WHEN {_UTF16.format('content')} > {DEMO_MAX_SIZE} THEN 'too_large' END AS skip_reason
FROM {_REPO_FILES} f""")
def q_skip_reason(spark, sf_dir):
    """first skip reason per file (null = kept)."""
    f = S.repo_files(spark, sf_dir)
    return f.select(*FILE_KEYS, FL.skip_reason(F.col("path"), F.col("content"), DEMO_MAX_SIZE).alias("skip_reason"))


_SCAN_REQ = f"({derived_sql('scan_requests')})"


@register("scan_path", f"""SELECT f.repository, f.branch, f.path, f.size FROM ({Q.files()}) f
WHERE EXISTS (SELECT 1 FROM {_SCAN_REQ} r WHERE concat_ws('/', r.owner, r.repo) = f.repository
              AND coalesce(r.branch, 'main') = f.branch AND r.path = f.path)""")
def q_scan_path(spark, sf_dir):
    """Files named exactly by the (repository, branch, path) of scan requests."""
    from keysweep.functions.mask import default_branch, repo_key
    req = S.derived_table(spark, sf_dir, "scan_requests").select(
        repo_key(F.col("owner"), F.col("repo")).alias("repository"),
        default_branch(F.col("branch")).alias("branch"), "path")
    files = S.seeded_documents(spark, sf_dir)
    return FL.scan_path(files, req).select(*FILE_KEYS, "size")


@register("decode_content", f"""SELECT repository, branch, path, CAST(length(c) AS BIGINT) AS n_chars, md5(c) AS content_md5
FROM (SELECT repository, branch, path, decode(from_base64(content_b64)) AS c FROM ({derived_sql('files_encoded')}) e) d""")
def q_decode_content(spark, sf_dir):
    """S3: base64 -> UTF-8 text, invalid bytes -> U+FFFD."""
    from keysweep.sources.files import decode_content
    enc = S.derived_table(spark, sf_dir, "files_encoded")
    d = decode_content(enc)
    return d.select(*FILE_KEYS, F.length("content").cast("bigint").alias("n_chars"), F.md5("content").alias("content_md5"))


def _valid_snippets(spark, sf_dir):
    return QL.valid(QL.check_snippets(S.derived_table(spark, sf_dir, "snippets")))


_SNIP = f"({derived_sql('snippets')})"
_VALID_SNIP_SQL = (f"(SELECT snippet_id, coalesce(nullif(path, ''), 'inline') AS path, code AS content FROM {_SNIP} s "
                   f"WHERE code IS NOT NULL AND length(code) >= 1 AND {_UTF16.format('code')} <= {C.MAX_FILE_SIZE} "
                   f"AND (path IS NULL OR {_UTF16.format('path')} <= {C.MAX_PATH_LEN}))")
_SNIP_DET = Q.detections(_VALID_SNIP_SQL, keys=("snippet_id", "path"))


def _snippet_advice_sql(det: str) -> str:
    fixed = Q.str_list(C.SNIPPET_ADVICE)
    return f"""(SELECT snippet_id, list_concat(list(recommendation ORDER BY line, "column", type), {fixed}) AS recs
  FROM (SELECT snippet_id, recommendation, line, "column", type, row_number() OVER
          (PARTITION BY snippet_id, recommendation ORDER BY line, "column", type) AS rn FROM {det} d) x
  WHERE rn = 1 GROUP BY snippet_id)"""


@register("scan_snippets", f"""
WITH s AS {_VALID_SNIP_SQL}, det AS {_SNIP_DET},
agg AS (SELECT snippet_id, count(*) AS n, max({Q.severity_rank()}) AS rk FROM det GROUP BY snippet_id),
adv AS {_snippet_advice_sql('det')}
SELECT s.snippet_id, s.path, CAST(coalesce(agg.n, 0) AS BIGINT) AS detections_found, {Q.rank_label('agg.rk')} AS severity,
       coalesce(array_to_string(adv.recs, ' | '), '') AS recommendations
FROM s LEFT JOIN agg ON s.snippet_id = agg.snippet_id LEFT JOIN adv ON s.snippet_id = adv.snippet_id""")
def q_scan_snippets(spark, sf_dir):
    """Each valid snippet scanned; count, severity ('none' when clean) and advice."""
    from keysweep.sources.files import snippet_files
    snips = snippet_files(_valid_snippets(spark, sf_dir))
    dets = D.detections(snips, keys=["snippet_id", "path"])
    adv = R.snippet_advice(dets, ["snippet_id"])
    j = snips.select("snippet_id", "path").join(adv, "snippet_id", "left")
    return j.select("snippet_id", "path", F.coalesce("n", F.lit(0)).cast("bigint").alias("detections_found"),
                    R.rank_label(F.col("rk")).alias("severity"),
                    F.coalesce(F.array_join("recommendations", " | "), F.lit("")).alias("recommendations"))


@register("snippet_advice", f"""
WITH det AS {_SNIP_DET}, adv AS {_snippet_advice_sql('det')}
SELECT snippet_id, CAST(len(recs) AS INTEGER) AS n_recommendations, array_to_string(recs, ' | ') AS recommendations FROM adv""")
def q_snippet_advice(spark, sf_dir):
    """Distinct recommendations in first-seen order + three fixed lines (snippets with hits)."""
    from keysweep.sources.files import snippet_files
    dets = D.detections(snippet_files(_valid_snippets(spark, sf_dir)), keys=["snippet_id", "path"])
    adv = R.snippet_advice(dets, ["snippet_id"])
    return adv.select("snippet_id", F.size("recommendations").alias("n_recommendations"),
                      F.array_join("recommendations", " | ").alias("recommendations"))


def _valid_scan_requests(spark, sf_dir):
    from keysweep.functions.mask import repo_key
    chk = QL.valid(QL.check_scan_requests(S.derived_table(spark, sf_dir, "scan_requests")))
    return chk.select("request_id", repo_key(F.col("owner"), F.col("repo")).alias("repository"), "branch", "path")


_OWNER_OK = (f"owner IS NOT NULL AND length(owner) BETWEEN 1 AND {C.MAX_OWNER_LEN} AND regexp_matches(owner, {sql_string(C.OWNER_RE)})")
_REPO_OK = (f"repo IS NOT NULL AND length(repo) BETWEEN 1 AND {C.MAX_REPO_LEN} AND regexp_matches(repo, {sql_string(C.REPO_RE)})")
_BRANCH_OK = (f"(branch IS NULL OR (length(branch) BETWEEN 1 AND {C.MAX_BRANCH_LEN} AND regexp_matches(branch, {sql_string(C.BRANCH_RE)})))")
_VALID_SCAN_REQ = (f"(SELECT request_id, concat_ws('/', owner, repo) AS repository, coalesce(branch, 'main') AS branch, path "
                   f"FROM {_SCAN_REQ} r WHERE {_OWNER_OK} AND {_REPO_OK} AND {_BRANCH_OK} "
                   f"AND (path IS NULL OR length(path) <= {C.MAX_PATH_LEN}))")


@register("coverage", f"""
WITH k AS {_capped_sql()}, fc AS (SELECT repository, branch, count(*) AS n FROM k GROUP BY ALL)
SELECT r.request_id, r.repository, r.branch, CAST(coalesce(fc.n, 0) AS BIGINT) AS total_files_scanned,
       fc.n IS NOT NULL AS has_files
FROM {_VALID_SCAN_REQ} r LEFT JOIN fc ON r.repository = fc.repository AND r.branch = fc.branch""")
def q_coverage(spark, sf_dir):
    """Every valid request reports, repositories with nothing readable as zeros."""
    kept = _kept_files(spark, sf_dir)
    fc = kept.groupBy(*REPO_KEYS).agg(F.count(F.lit(1)).alias("n"))
    r = _valid_scan_requests(spark, sf_dir)
    j = r.join(fc, REPO_KEYS, "left")
    return j.select("request_id", *REPO_KEYS, F.coalesce("n", F.lit(0)).cast("bigint").alias("total_files_scanned"),
                    F.col("n").isNotNull().alias("has_files"))


# ---------------------------------------------------------------------------
# Order 3: roll-ups over the seeded documents.
# ---------------------------------------------------------------------------

@register("file_results", f"""SELECT repository, branch, path, count(*) AS detections, {Q.severity_counts()},
  {Q.rank_label(f'max({Q.severity_rank()})')} AS severity, min(line) AS first_line FROM {_det_sql()} d GROUP BY ALL""")
def q_file_results(spark, sf_dir):
    """A2: files with >= 1 detection, with counts and max severity."""
    return R.file_results(D.detections(S.seeded_documents(spark, sf_dir)))


@register("severity_breakdown", f"""
WITH det AS {_det_sql()},
per AS (SELECT repository, branch, severity, count(*) AS count FROM det GROUP BY ALL),
repos AS (SELECT DISTINCT repository, branch FROM per),
four AS (SELECT repository, branch, unnest(['critical', 'high', 'medium', 'low']) AS severity FROM repos),
fixed AS (SELECT f.repository, f.branch, f.severity, CAST(coalesce(p.count, 0) AS BIGINT) AS count
          FROM four f LEFT JOIN per p ON p.repository = f.repository AND p.branch = f.branch AND p.severity = f.severity)
SELECT * FROM fixed UNION ALL
SELECT repository, branch, severity, count FROM per WHERE severity NOT IN ('critical', 'high', 'medium', 'low') OR severity IS NULL""")
def q_severity_breakdown(spark, sf_dir):
    """A4: per repository, the four fixed severities (zero default) plus any other seen."""
    return R.severity_breakdown(D.detections(S.seeded_documents(spark, sf_dir)))


@register("type_counts", f"SELECT repository, branch, type, count(*) AS count FROM {_det_sql()} d GROUP BY ALL")
def q_type_counts(spark, sf_dir):
    """A5: detections per repository and secret type."""
    return R.type_counts(D.detections(S.seeded_documents(spark, sf_dir)))


def _kept_files(spark, sf_dir):
    """F1-F4 only (no detection): file listing and coverage need no regex work, and read the content once."""
    return FL.keep_files(S.repo_files(spark, sf_dir))


def _corpus_dets(spark, sf_dir):
    """The corpus scan (F1-F4 + detection) as one checkpointed pass."""
    from keysweep.plans.corpus_scan import scan_corpus
    return scan_corpus(S.repo_files(spark, sf_dir))[:2]


def _every_det(spark, sf_dir):
    """Detections in every file that has content, whatever its path."""
    from keysweep.plans.corpus_scan import scan_corpus
    return scan_corpus(S.repo_files(spark, sf_dir), every_file=True).detections


_CORPUS_DET = _det_sql(_capped_sql())
_EVERY_DET = _det_sql(f"(SELECT * FROM {_REPO_FILES} f WHERE content IS NOT NULL AND content <> '')")


@register("totals", f"""
WITH k AS {_capped_sql()}, det AS {_CORPUS_DET},
fc AS (SELECT repository, branch, count(*) AS n FROM k GROUP BY ALL),
dc AS (SELECT repository, branch, count(DISTINCT path) AS fw, count(*) AS ns FROM det GROUP BY ALL)
SELECT fc.repository, fc.branch, CAST(fc.n AS BIGINT) AS total_files_scanned,
       CAST(coalesce(dc.fw, 0) AS BIGINT) AS files_with_secrets, CAST(coalesce(dc.ns, 0) AS BIGINT) AS total_secrets_found
FROM fc LEFT JOIN dc ON fc.repository = dc.repository AND fc.branch = dc.branch""")
def q_totals(spark, sf_dir):
    """Files scanned (kept files), files with secrets, secrets found, per repository."""
    kept, dets = _corpus_dets(spark, sf_dir)
    fc = kept.groupBy(*REPO_KEYS).agg(F.count(F.lit(1)).alias("n"))
    fr = R.file_results(dets)
    dc = fr.groupBy(*REPO_KEYS).agg(F.count(F.lit(1)).alias("fw"), F.sum("detections").alias("ns"))
    j = fc.join(dc, REPO_KEYS, "left")
    return j.select(*REPO_KEYS, F.col("n").alias("total_files_scanned"),
                    F.coalesce("fw", F.lit(0)).cast("bigint").alias("files_with_secrets"),
                    F.coalesce("ns", F.lit(0)).cast("bigint").alias("total_secrets_found"))


@register("summary_totals", f"""
WITH k AS {_capped_sql()}, det AS {_CORPUS_DET},
repos AS (SELECT DISTINCT repository, branch FROM k),
fr AS (SELECT repository, branch, path, count(*) AS n FROM det GROUP BY ALL),
s AS (SELECT repository, branch, count(*) AS tf, count(*) FILTER (WHERE n > 0) AS fw, sum(n) AS ts FROM fr GROUP BY ALL)
SELECT r.repository, r.branch, CAST(coalesce(s.tf, 0) AS BIGINT) AS total_files,
       CAST(coalesce(s.fw, 0) AS BIGINT) AS files_with_secrets, CAST(coalesce(s.ts, 0) AS BIGINT) AS total_secrets
FROM repos r LEFT JOIN s ON r.repository = s.repository AND r.branch = s.branch""")
def q_summary_totals(spark, sf_dir):
    """Summary counts over result rows (files with hits), per scanned repository."""
    kept, dets = _corpus_dets(spark, sf_dir)
    repos = kept.select(*REPO_KEYS).distinct()
    fr = R.file_results(dets)
    s = fr.groupBy(*REPO_KEYS).agg(F.count(F.lit(1)).alias("tf"), F.count_if(F.col("detections") > 0).alias("fw"),
                                   F.sum("detections").alias("ts"))
    j = repos.join(s, REPO_KEYS, "left")
    return j.select(*REPO_KEYS, F.coalesce("tf", F.lit(0)).cast("bigint").alias("total_files"),
                    F.coalesce("fw", F.lit(0)).cast("bigint").alias("files_with_secrets"),
                    F.coalesce("ts", F.lit(0)).cast("bigint").alias("total_secrets"))


def _top_sql(k: int) -> str:
    return f"""SELECT repository, branch, CAST(rank AS INTEGER) AS rank, type, count FROM (
  SELECT repository, branch, type, count, row_number() OVER (PARTITION BY repository, branch ORDER BY count DESC, type) AS rank
  FROM (SELECT repository, branch, type, count(*) AS count FROM {_det_sql()} d GROUP BY ALL) c) x WHERE rank <= {k}"""


@register("top_types_10", _top_sql(10))
def q_top_types_10(spark, sf_dir):
    """K1: top 10 secret types per repository (count desc, type asc)."""
    return R.top_types(R.type_counts(D.detections(S.seeded_documents(spark, sf_dir))), 10).select(
        *REPO_KEYS, "rank", "type", "count")


@register("top_types_3", _top_sql(3))
def q_top_types_3(spark, sf_dir):
    """K2: top 3 secret types per repository."""
    return R.top_types(R.type_counts(D.detections(S.seeded_documents(spark, sf_dir))), 3).select(
        *REPO_KEYS, "rank", "type", "count")


def analysis_df(files: DataFrame, dets: DataFrame) -> DataFrame:
    """A10 for every repository of ``files`` (clean ones: score 0, compliant)."""
    repos = files.select(*REPO_KEYS).distinct()
    return R.analyze(dets, repos=repos)


_ANALYSIS_SQL = f"""
WITH files AS ({Q.files()}), det AS {_det_sql()},
repos AS (SELECT DISTINCT repository, branch FROM files),
sev AS (SELECT repository, branch, count(*) AS secrets, {Q.severity_counts()} FROM det GROUP BY ALL),
tc AS (SELECT repository, branch, type, count(*) AS cnt FROM det GROUP BY ALL),
top3 AS (SELECT repository, branch, list(type ORDER BY cnt DESC, type)[1:3] AS top3 FROM tc GROUP BY ALL),
a AS (SELECT r.repository, r.branch, CAST(coalesce(secrets, 0) AS BIGINT) AS secrets,
             CAST(coalesce(critical, 0) AS BIGINT) AS critical, CAST(coalesce(high, 0) AS BIGINT) AS high,
             CAST(coalesce(medium, 0) AS BIGINT) AS medium, CAST(coalesce(low, 0) AS BIGINT) AS low,
             coalesce(top3, []::VARCHAR[]) AS top3
      FROM repos r LEFT JOIN sev ON r.repository = sev.repository AND r.branch = sev.branch
      LEFT JOIN top3 t ON r.repository = t.repository AND r.branch = t.branch),
b AS (SELECT *, {Q.risk_score()} AS risk_score FROM a)
SELECT repository, branch, secrets, critical, high, medium, low, risk_score,
       {Q.compliance('risk_score')} AS compliance_status,
       {Q.remediation_steps()} AS remediation_steps,
       {Q.recommendations('top3', 'risk_score')} AS recommendations
FROM b"""


@register("analyze", f"""SELECT repository, branch, secrets, critical, high, medium, low, risk_score, compliance_status,
  CAST(len(remediation_steps) AS INTEGER) AS n_steps, array_to_string(remediation_steps, ' | ') AS remediation_steps,
  array_to_string(recommendations, ' | ') AS recommendations FROM ({_ANALYSIS_SQL}) z""")
def q_analyze(spark, sf_dir):
    """A10: score, status, counts, steps and recommendations for every repository."""
    files = S.seeded_documents(spark, sf_dir)
    a = analysis_df(files, D.detections(files))
    return a.select(*REPO_KEYS, "secrets", *C.SEVERITIES, "risk_score", "compliance_status",
                    F.size("remediation_steps").alias("n_steps"),
                    F.array_join("remediation_steps", " | ").alias("remediation_steps"),
                    F.array_join("recommendations", " | ").alias("recommendations"))


@register("remediation_steps", f"""SELECT repository, branch, CAST(generate_subscripts(remediation_steps, 1) AS INTEGER) AS step_no,
  unnest(remediation_steps) AS step FROM ({_ANALYSIS_SQL}) z""")
def q_remediation_steps(spark, sf_dir):
    """Remediation steps per repository, one row per step (3/2/7 rule)."""
    files = S.seeded_documents(spark, sf_dir)
    a = analysis_df(files, D.detections(files))
    return a.select(*REPO_KEYS, F.posexplode("remediation_steps").alias("step_no", "step")).select(
        *REPO_KEYS, (F.col("step_no") + 1).alias("step_no"), "step")


@register("recommendations", f"""SELECT repository, branch, CAST(generate_subscripts(recommendations, 1) AS INTEGER) AS rec_no,
  unnest(recommendations) AS recommendation FROM ({_ANALYSIS_SQL}) z""")
def q_recommendations(spark, sf_dir):
    """Repository recommendations, one row each (top-3 line, high-risk lines, fixed lines)."""
    files = S.seeded_documents(spark, sf_dir)
    a = analysis_df(files, D.detections(files))
    return a.select(*REPO_KEYS, F.posexplode("recommendations").alias("rec_no", "recommendation")).select(
        *REPO_KEYS, (F.col("rec_no") + 1).alias("rec_no"), "recommendation")


# ---------------------------------------------------------------------------
# Order 4: redaction, log filter, input cleaning and request checks.
# ---------------------------------------------------------------------------

from keysweep.functions import mask as M  # noqa: E402

_LOGS = f"({derived_sql('log_entries')})"
_KEY_RE = sql_string(M.secret_key_regex())


def _redact_map_value_sql(k: str, v: str) -> str:
    return (f"(CASE WHEN regexp_matches({k}, {_KEY_RE}) THEN (CASE WHEN {v} IS NULL OR length({v}) = 0 THEN '****' "
            f"ELSE {Q.mask_fixed(v)} END) ELSE {Q.redact_text(v)} END)")


@register("redact_text", f"SELECT repository, branch, path, {Q.redact_text('content')} AS redacted FROM ({Q.files()}) f")
def q_redact_text(spark, sf_dir):
    """Every document with the seven sanitizer patterns masked in sequence."""
    f = S.spread(S.seeded_documents(spark, sf_dir), FILE_KEYS)
    return f.select(*FILE_KEYS, F.expr(M.redact_text_sql("content")).alias("redacted"))


@register("redact_map", f"""SELECT event_id, e.key AS key, {_redact_map_value_sql('e.key', 'e.value')} AS value
FROM (SELECT event_id, unnest(map_entries(context)) AS e FROM {_LOGS} l) x""")
def q_redact_map(spark, sf_dir):
    """R2: log context maps with secret-named values masked and the rest sanitized."""
    logs = S.spread(S.derived_table(spark, sf_dir, "log_entries"), ["event_id"])
    return logs.select("event_id", F.explode(F.expr(M.redact_map_sql("context"))).alias("key", "value"))


def _ctx_string_sql(m: str) -> str:
    return (f"array_to_string(list_sort(list_transform(map_entries({m}), "
            f"lambda e: e.key || '=' || coalesce(e.value, 'null'))), ';')")


def _ctx_string(m):
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(
        e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))), ";")


_LEVEL_RANK_SQL = "(CASE level WHEN 'DEBUG' THEN 0 WHEN 'INFO' THEN 1 WHEN 'WARN' THEN 2 WHEN 'ERROR' THEN 3 END)"


@register("redact_log", f"""SELECT event_id, level, {Q.redact_text('message')} AS message,
  {_ctx_string_sql(f"map_from_entries(list_transform(map_entries(context), lambda e: {{'key': e.key, 'value': {_redact_map_value_sql('e.key', 'e.value')}}}))")} AS context,
  error.name AS error_name, {Q.redact_text('error.message')} AS error_message, CAST(NULL AS VARCHAR) AS error_stack
FROM {_LOGS} l WHERE {_LEVEL_RANK_SQL} >= 1""")
def q_redact_log(spark, sf_dir):
    """Production log view -- INFO and above, message/error/context redacted, no stack."""
    from keysweep.operators.logs import redact_log
    logs = S.spread(S.derived_table(spark, sf_dir, "log_entries"), ["event_id"])
    logs = redact_log(logs, threshold="INFO", production=True)
    return logs.select("event_id", "level", "message", _ctx_string(F.col("context")).alias("context"),
                       F.col("error.name").alias("error_name"), F.col("error.message").alias("error_message"),
                       F.col("error.stack").alias("error_stack"))


@register("log_level_filter", f"SELECT event_id, level FROM {_LOGS} l WHERE {_LEVEL_RANK_SQL} >= 2")
def q_log_level_filter(spark, sf_dir):
    """log entries at WARN or above."""
    logs = S.derived_table(spark, sf_dir, "log_entries")
    return FL.log_level_filter(logs, "WARN").select("event_id", "level")


_NAMES = f"({derived_sql('raw_names')})"
_CTRL_SQL = sql_string(M.CONTROL_CHARS_RE)
_TRIM_SQL = sql_string(M.JS_TRIM_RE)


@register("strip_control", f"SELECT doc_id, regexp_replace(name, {_CTRL_SQL}, '', 'g') AS name FROM {_NAMES} n")
def q_strip_control(spark, sf_dir):
    """Control characters removed (tab, LF, CR kept)."""
    n = S.derived_table(spark, sf_dir, "raw_names")
    return n.select("doc_id", M.strip_control(F.col("name")).alias("name"))


@register("clean_name", f"SELECT doc_id, regexp_replace(regexp_replace(name, {_TRIM_SQL}, '', 'g'), {_CTRL_SQL}, '', 'g') AS name FROM {_NAMES} n")
def q_clean_name(spark, sf_dir):
    """JS-style trim (Unicode spaces, BOM), then control characters removed."""
    n = S.derived_table(spark, sf_dir, "raw_names")
    return n.select("doc_id", M.clean_name(F.col("name")).alias("name"))


@register("repo_key", f"SELECT request_id, concat_ws('/', owner, repo) AS repository FROM {_SCAN_REQ} r")
def q_repo_key(spark, sf_dir):
    """owner/repo key of each request."""
    r = S.derived_table(spark, sf_dir, "scan_requests")
    return r.select("request_id", M.repo_key(F.col("owner"), F.col("repo")).alias("repository"))


@register("default_path", f"""SELECT request_id, coalesce(branch, 'main') AS branch,
  coalesce(nullif(path, ''), {sql_string(C.DEFAULT_PATH_LABEL)}) AS path_label FROM {_SCAN_REQ} r""")
def q_default_path(spark, sf_dir):
    """Branch defaults to main; an empty path reads 'entire repository'."""
    r = S.derived_table(spark, sf_dir, "scan_requests")
    return r.select("request_id", M.default_branch(F.col("branch")).alias("branch"),
                    M.default_path_label(F.col("path")).alias("path_label"))


def _viol_sql(pairs: list[tuple[str, str]]) -> str:
    items = ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for cond, code in pairs)
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ',')"


def _name_viol_sql(col: str, field: str, max_len: int, regex: str, required: bool = True) -> list:
    n = _UTF16.format(col)
    out = [(f"{col} IS NULL", f"{field}_required")] if required else []
    return out + [(f"{col} IS NOT NULL AND {n} < 1", f"{field}_empty"),
                  (f"{col} IS NOT NULL AND {n} > {max_len}", f"{field}_too_long"),
                  (f"{col} IS NOT NULL AND NOT regexp_matches({col}, {sql_string(QL.anchored(regex))})", f"{field}_format")]


_Q1_RULES = (_name_viol_sql("owner", "owner", C.MAX_OWNER_LEN, C.OWNER_RE)
             + _name_viol_sql("repo", "repo", C.MAX_REPO_LEN, C.REPO_RE)
             + _name_viol_sql("branch", "branch", C.MAX_BRANCH_LEN, C.BRANCH_RE, required=False))


def _checked(df: DataFrame, *cols) -> DataFrame:
    return df.select(*cols, F.array_join("violations", ",").alias("violations"),
                     (F.size("violations") == 0).alias("is_valid"))


@register("check_scan_requests", f"""SELECT request_id, owner, repo, coalesce(branch, 'main') AS branch, path, v AS violations, v = '' AS is_valid
FROM (SELECT *, {_viol_sql(_Q1_RULES + [(f"{_UTF16.format('path')} > {C.MAX_PATH_LEN}", 'path_too_long')])} AS v FROM {_SCAN_REQ} r) x""")
def q_check_scan_requests(spark, sf_dir):
    """Q1: owner/repo/branch/path rules; every violation listed."""
    chk = QL.check_scan_requests(S.derived_table(spark, sf_dir, "scan_requests"))
    return _checked(chk, "request_id", "owner", "repo", "branch", "path")


@register("check_analysis_requests", f"""SELECT request_id, owner, repo, coalesce(branch, 'main') AS branch, v AS violations, v = '' AS is_valid
FROM (SELECT *, {_viol_sql(_Q1_RULES)} AS v FROM {_SCAN_REQ} r) x""")
def q_check_analysis_requests(spark, sf_dir):
    """Q3: as Q1 without path."""
    chk = QL.check_analysis_requests(S.derived_table(spark, sf_dir, "scan_requests"))
    return _checked(chk, "request_id", "owner", "repo", "branch")


_ANY_RULE = __import__("keysweep.functions.regex", fromlist=["x"]).union_regex([r.pattern for r in C.RULES])


@register("check_snippets", f"""SELECT snippet_id, regexp_replace({Q.redact_text('code')}, {sql_string(_ANY_RULE)}, '****', 'g') AS code, path, v AS violations, v = '' AS is_valid FROM (SELECT *, {_viol_sql([
    ("code IS NULL", "code_required"), (f"code IS NOT NULL AND {_UTF16.format('code')} < 1", "code_empty"),
    (f"code IS NOT NULL AND {_UTF16.format('code')} > {C.MAX_FILE_SIZE}", "code_too_large"),
    (f"{_UTF16.format('path')} > {C.MAX_PATH_LEN}", "path_too_long")])} AS v FROM {_SNIP} s) x""")
def q_check_snippets(spark, sf_dir):
    """Q2: code 1..10 MiB, path <= 1000.  The report shows the code sanitized (R1) and without any rule's matches: a
    rejects table must not persist the secrets it is about.  The rules' regex runs only where a rule's literal stands."""
    chk = QL.check_snippets(S.derived_table(spark, sf_dir, "snippets"))
    chk = chk.withColumn("code", F.expr(M.redact_text_sql("code")))
    gate = F.expr(D.any_gate_sql(C.RULES, "code", "lower(code)"))
    masked = F.when(gate, F.regexp_replace("code", _ANY_RULE, "****")).otherwise(F.col("code"))
    return _checked(chk.withColumn("code", masked), "snippet_id", "code", "path")


_SECRET_REQ = f"({derived_sql('secret_requests')})"


@register("check_secret_requests", f"""SELECT request_id, secret_type, {Q.mask_value('value')} AS value, v AS violations, v = '' AS is_valid FROM (SELECT *, {_viol_sql([
    ("secret_type IS NULL", "secret_type_required"),
    (f"secret_type IS NOT NULL AND {_UTF16.format('secret_type')} < 1", "secret_type_empty"),
    (f"secret_type IS NOT NULL AND {_UTF16.format('secret_type')} > {C.MAX_SECRET_TYPE_LEN}", "secret_type_too_long"),
    ("value IS NULL", "value_required"),
    (f"value IS NOT NULL AND {_UTF16.format('value')} < 1", "value_empty"),
    (f"value IS NOT NULL AND {_UTF16.format('value')} > {C.MAX_SECRET_VALUE_LEN}", "value_too_long")])} AS v FROM {_SECRET_REQ} s) x""")
def q_check_secret_requests(spark, sf_dir):
    """Q4: secret type 1..100, value 1..10000; the report shows the value masked."""
    chk = QL.check_secret_requests(S.derived_table(spark, sf_dir, "secret_requests"))
    return _checked(chk.withColumn("value", D.mask_value(F.col("value"))), "request_id", "secret_type", "value")


# ---------------------------------------------------------------------------
# Order 5: the whole catalog, context, blocks, validation, line filters, catalog listings.
# ---------------------------------------------------------------------------

_DET_COLS = "repository, branch, path, type, line, \"column\", value"


@register("all_rules", f"SELECT {_DET_COLS} FROM {_EVERY_DET} d")
def q_all_rules(spark, sf_dir):
    """All 37 rules over every document, page and conversation."""
    return _every_det(spark, sf_dir).select(*FILE_KEYS, "type", "line", "column", "value")


@register("context", f"SELECT repository, branch, path, type, line, \"column\", context FROM {_det_sql(with_context=True)} d")
def q_context(spark, sf_dir):
    """D3: +-40 characters around each match; the match and any other secret in the window masked."""
    dets = D.detections(S.seeded_documents(spark, sf_dir), with_context=True)
    return dets.select(*FILE_KEYS, "type", "line", "column", "context")


_BLOCK_P = sql_string(__import__("keysweep.functions.regex", fromlist=["x"]).engine_regex(C.BLOCK_RULE.pattern))


@register("multiline_rules", f"""
WITH b AS (SELECT repository, branch, path, regexp_extract_all(content, {_BLOCK_P}) AS found,
                  string_split_regex(content, {_BLOCK_P}) AS pieces
           FROM ({Q.files()}) f WHERE content LIKE '%PRIVATE KEY%' AND regexp_matches(content, {_BLOCK_P})),
m AS (SELECT repository, branch, path, unnest(found) AS raw,
             unnest(list_transform(found, lambda v, i: string_split(array_to_string(list_transform(
                 list_zip(pieces[1:i], found[1:i-1]), lambda z: z[1] || coalesce(z[2], '')), ''), chr(10)))) AS before
      FROM b)
SELECT repository, branch, path, {sql_string(C.BLOCK_RULE.type)} AS type, {sql_string(C.BLOCK_RULE.category)} AS category,
       {sql_string(C.BLOCK_RULE.severity)} AS severity, {Q.mask_value('raw')} AS value, CAST(len(before) AS INTEGER) AS line,
       CAST(length(before[-1]) + 1 AS INTEGER) AS "column", CAST(len(string_split(raw, chr(10))) AS INTEGER) AS n_lines
FROM m""")
def q_multiline_rules(spark, sf_dir):
    """Private-key blocks spanning lines, any key label."""
    return D.detect_blocks(S.seeded_documents(spark, sf_dir))


_KEY_FILES = f"({derived_sql('key_files')})"


@register("scan_blocks", f"""
WITH f AS {_KEY_FILES}, d AS {Q.detections(_KEY_FILES)},
b AS (SELECT repository, branch, path, regexp_extract_all(content, {_BLOCK_P}) AS found,
             string_split_regex(content, {_BLOCK_P}) AS pieces FROM f),
m AS (SELECT repository, branch, path, unnest(found) AS raw,
             unnest(list_transform(found, lambda v, i: string_split(array_to_string(list_transform(
                 list_zip(pieces[1:i], found[1:i-1]), lambda z: z[1] || coalesce(z[2], '')), ''), chr(10)))) AS before FROM b),
p AS (SELECT repository, branch, path, {sql_string(C.BLOCK_RULE.type)} AS type, CAST(len(before) AS INTEGER) AS line,
             CAST(length(before[-1]) + 1 AS INTEGER) AS "column", {Q.mask_value('raw')} AS value,
             CAST(len(before) + len(string_split(raw, chr(10))) - 1 AS INTEGER) AS end_line FROM m)
SELECT repository, branch, path, type, line, "column", value, line AS end_line FROM d
UNION ALL SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.repository = p.repository AND d.branch = p.branch
  AND d.path = p.path AND d.line = p.line AND d."column" = p."column" AND contains(d.pattern, 'PRIVATE KEY'))""")
def q_scan_blocks(spark, sf_dir):
    """D1 + D6 out of one pass, as the scan job runs it: every rule's matches, and the private-key blocks of any label whose
    header isn't a rule's match already."""
    from keysweep.plans.corpus_scan import scan_corpus
    dets = scan_corpus(S.derived_table(spark, sf_dir, "key_files"), every_file=True, blocks=True).detections
    return dets.select(*FILE_KEYS, "type", "line", "column", "value", "end_line")


def _validate_sql() -> str:
    from keysweep.functions.regex import engine_regex
    full = " ".join(f"WHEN secret_type = {sql_string(r.type)} THEN regexp_matches(value, "
                    f"{sql_string('^(?:' + engine_regex(r.pattern) + ')' + chr(92) + 'z')})" for r in C.RULES)
    return f"""SELECT r.request_id, r.secret_type, {Q.mask_value('r.value')} AS value,
  CASE WHEN c.severity IS NULL THEN 'unknown_type'
       WHEN regexp_matches(r.value, {sql_string(C.PLACEHOLDER_RE)}) THEN 'placeholder'
       WHEN (CASE {full} END) THEN 'format_valid' ELSE 'format_invalid' END AS status,
  c.severity, coalesce(c.recommendation, 'Unknown secret type; no validation rule') AS recommendation
FROM (SELECT * FROM {_SECRET_REQ} s WHERE secret_type IS NOT NULL AND length(secret_type) BETWEEN 1 AND {C.MAX_SECRET_TYPE_LEN}
      AND value IS NOT NULL AND length(value) BETWEEN 1 AND {C.MAX_SECRET_VALUE_LEN}) r
LEFT JOIN {Q.catalog_values()} c ON r.secret_type = c.type"""


@register("validate_secrets", _validate_sql())
def q_validate_secrets(spark, sf_dir):
    """Offline verdict per valid (type, value) request."""
    req = QL.valid(QL.check_secret_requests(S.derived_table(spark, sf_dir, "secret_requests"))).drop("violations")
    return D.validate_secrets(req, D.catalog_df(spark))


_COMMENT_FILTER = f"trim(line_text) <> '' AND NOT regexp_matches(line_text, {sql_string(C.COMMENT_PREFIX_RE)})"


@register("skip_lines", f"""SELECT snippet_id, path, type, line, "column", value
FROM {Q.detections(_VALID_SNIP_SQL, keys=("snippet_id", "path"), line_filter=_COMMENT_FILTER)} d""")
def q_skip_lines(spark, sf_dir):
    """snippet detections with blank and comment lines skipped."""
    from keysweep.sources.files import snippet_files
    dets = D.detections(snippet_files(_valid_snippets(spark, sf_dir)), keys=["snippet_id", "path"], skip_comments=True)
    return dets.select("snippet_id", "path", "type", "line", "column", "value")


from keysweep.functions.comments import without_comments_sql  # noqa: E402

_CODE_FILES = (f"(SELECT repository, branch, path, {without_comments_sql('path', 'content', spark=False)} AS content "
               f"FROM ({derived_sql('code_files')}) c)")


@register("skip_comments", f"SELECT repository, branch, path, type, line, \"column\", value FROM {Q.detections(_CODE_FILES)} d")
def q_skip_comments(spark, sf_dir):
    """F7 by file type: matches outside of comments, which may span lines; strings that hold comment markers stay."""
    dets = D.detections(S.derived_table(spark, sf_dir, "code_files"), blank_comments=True)
    return dets.select(*FILE_KEYS, "type", "line", "column", "value")


_FP_VALUE = (f"(CASE WHEN contains(pattern, '[=:]') THEN regexp_replace(raw, {sql_string(FL.ASSIGNED)}, '') ELSE raw END)")
_FP_SQL = (f"(regexp_matches(raw, {sql_string(C.PLACEHOLDER_RE)}) OR regexp_matches(raw, {sql_string(C.TEST_TOKEN_RE)}) "
           f"OR length(replace({_FP_VALUE}, left({_FP_VALUE}, 1), '')) = 0 "
           f"OR len(list_distinct(string_split({_FP_VALUE}, ''))) < {C.MIN_DISTINCT_CHARS})")


@register("drop_false_positives", f"""SELECT repository, branch, path, type, line, "column", {Q.mask_value('raw')} AS value,
  regexp_matches(path, {sql_string(C.TEST_PATH_RE)}) AS is_test_path
FROM {_RAW_SQL} r WHERE NOT {_FP_SQL}""")
def q_drop_false_positives(spark, sf_dir):
    """F8: detections minus example/placeholder/test/one-character values; test paths flagged."""
    dets = D.detections(S.seeded_documents(spark, sf_dir), drop_false_positives=True)
    return dets.select(*FILE_KEYS, "type", "line", "column", "value", FL.is_test_path(F.col("path")).alias("is_test_path"))


from keysweep.functions import validators as V  # noqa: E402

_TOKEN_FILES = f"({derived_sql('token_files')})"


@register("validate_types", f"""SELECT h.repository, h.branch, h.path, c.type, h.line, h."column", {Q.mask_value('h.raw')} AS value,
  {V.failed_check_sql('c.type', 'h.raw', spark=False)} AS failed_check
FROM {Q.raw_hits(_TOKEN_FILES)} h JOIN {Q.catalog_values()} c ON h.rule_id = c.rule_id""")
def q_validate_types(spark, sf_dir):
    """F8 by type: every match with the first check of its type that it fails (alphabet, checksum, payload, entropy, ...)."""
    dets = D.detections(S.derived_table(spark, sf_dir, "token_files"), verdicts=True)
    return dets.select(*FILE_KEYS, "type", "line", "column", "value", "failed_check")


from keysweep.operators.overlaps import rank_sql  # noqa: E402

_OVERLAP_FILES = f"({derived_sql('overlap_files')})"


@register("no_overlaps", f"""
WITH RECURSIVE h AS (SELECT r.repository, r.branch, r.path, r.line, r."column" AS a, r."column" + length(r.raw) - 1 AS b, c.severity,
  row_number() OVER (PARTITION BY r.repository, r.branch, r.path, r.line ORDER BY {rank_sql('c.type')}, r."column") AS k
  FROM {Q.raw_hits(_OVERLAP_FILES)} r JOIN {Q.catalog_values()} c ON r.rule_id = c.rule_id),
walk AS (SELECT *, [struct_pack(a := a, b := b)] AS kept, true AS stays FROM h WHERE k = 1
  UNION ALL SELECT h.*, CASE WHEN len(list_filter(w.kept, lambda x: x.a <= h.b AND h.a <= x.b)) > 0 THEN w.kept
                             ELSE list_append(w.kept, struct_pack(a := h.a, b := h.b)) END,
       len(list_filter(w.kept, lambda x: x.a <= h.b AND h.a <= x.b)) = 0
  FROM walk w JOIN h ON h.repository = w.repository AND h.branch = w.branch AND h.path = w.path AND h.line = w.line AND h.k = w.k + 1),
e AS (SELECT repository, branch, count(*) AS matches, {Q.severity_counts()} FROM walk GROUP BY ALL),
s AS (SELECT repository, branch, count(*) AS secrets, {Q.severity_counts()} FROM walk WHERE stays GROUP BY ALL)
SELECT e.repository, e.branch, e.matches, s.secrets,
  {Q.risk_score(*(f'e.{x}' for x in C.SEVERITIES))} AS risk_of_matches, {Q.risk_score(*(f's.{x}' for x in C.SEVERITIES))} AS risk_score
FROM e JOIN s ON e.repository = s.repository AND e.branch = s.branch""")
def q_no_overlaps(spark, sf_dir):
    """D1 without double counts: matches and risk score per repository, with all matches and with the most specific of those that
    overlap."""
    from keysweep.operators.overlaps import most_specific
    dets = D.detections(S.derived_table(spark, sf_dir, "overlap_files"), spans=True)

    def risk(rows, n, score):
        counts = rows.groupBy(*REPO_KEYS).agg(F.count(F.lit(1)).alias(n), *R._severity_counts())
        return counts.select(*REPO_KEYS, n, R.risk_score(*(F.col(x) for x in C.SEVERITIES)).alias(score))

    from keysweep.session import checkpoint_root
    checkpoint_root(spark)
    dets = dets.checkpoint()
    return risk(dets, "matches", "risk_of_matches").join(risk(most_specific(dets), "secrets", "risk_score"), REPO_KEYS).select(
        *REPO_KEYS, "matches", "secrets", "risk_of_matches", "risk_score")


_N_CATEGORIES = len({r.category for r in C.RULES})


@register("secret_types", f"""
WITH det AS {_EVERY_DET}, h AS (SELECT type, count(*) AS hits FROM det GROUP BY type)
SELECT c.type, c.category, c.description, c.severity, CAST(coalesce(h.hits, 0) AS BIGINT) AS hits,
       {len(C.RULES)} AS total_types, {_N_CATEGORIES} AS total_categories
FROM {Q.catalog_values()} c LEFT JOIN h ON c.type = h.type""")
def q_secret_types(spark, sf_dir):
    """The catalog listing (type, category, description, severity, totals) with corpus hit counts."""
    hits = _every_det(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("hits"))
    cat = D.catalog_df(spark)
    return cat.join(hits, "type", "left").select(
        "type", "category", "description", "severity", F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"),
        F.lit(len(C.RULES)).alias("total_types"), F.lit(_N_CATEGORIES).alias("total_categories"))


@register("patterns", f"""
WITH det AS {_EVERY_DET}, h AS (SELECT type, count(DISTINCT (repository, branch, path)) AS files FROM det GROUP BY type)
SELECT c.type, c.pattern, CAST(coalesce(h.files, 0) AS BIGINT) AS files_with_hits
FROM {Q.catalog_values()} c LEFT JOIN h ON c.type = h.type""")
def q_patterns(spark, sf_dir):
    """Each rule's regex with the number of files it fires in."""
    files = _every_det(spark, sf_dir).select("type", *FILE_KEYS).distinct().groupBy("type").agg(F.count(F.lit(1)).alias("files"))
    return D.catalog_df(spark).join(files, "type", "left").select(
        "type", "pattern", F.coalesce("files", F.lit(0)).cast("bigint").alias("files_with_hits"))


# ---------------------------------------------------------------------------
# Order 6: full scan, report sinks, stream.
# ---------------------------------------------------------------------------

@register("scan_files", f"SELECT repository, branch, path, size FROM {_capped_sql()} c")
def q_scan_files(spark, sf_dir):
    """Every scannable file (F1-F4 applied) of documents, pages and conversations."""
    return _kept_files(spark, sf_dir).select(*FILE_KEYS, "size")


_REPORT_SQL = f"""
WITH k AS {_capped_sql()}, det AS {_CORPUS_DET},
fc AS (SELECT repository, branch, count(*) AS n FROM k GROUP BY ALL),
dc AS (SELECT repository, branch, count(DISTINCT path) AS fw, count(*) AS ns, {Q.severity_counts()} FROM det GROUP BY ALL),
tc AS (SELECT repository, branch, type, count(*) AS cnt FROM det GROUP BY ALL),
top AS (SELECT repository, branch, array_to_string(list(type || ':' || cnt ORDER BY cnt DESC, type)[1:10], ',') AS top_secret_types
        FROM tc GROUP BY ALL)
SELECT fc.repository, fc.branch, {sql_string(C.DEFAULT_PATH_LABEL)} AS path, CAST(fc.n AS BIGINT) AS total_files_scanned,
       CAST(coalesce(dc.fw, 0) AS BIGINT) AS files_with_secrets, CAST(coalesce(dc.ns, 0) AS BIGINT) AS total_secrets_found,
       'critical=' || coalesce(dc.critical, 0) || ';high=' || coalesce(dc.high, 0) || ';medium=' || coalesce(dc.medium, 0)
         || ';low=' || coalesce(dc.low, 0) AS severity_breakdown,
       coalesce(top.top_secret_types, '') AS top_secret_types
FROM fc LEFT JOIN dc ON fc.repository = dc.repository AND fc.branch = dc.branch
LEFT JOIN top ON fc.repository = top.repository AND fc.branch = top.branch"""


def _breakdown_string(m):
    fixed = [F.concat(F.lit(s + "="), F.coalesce(m[s], F.lit(0)).cast("string")) for s in C.SEVERITIES]
    extra = F.array_sort(F.transform(F.map_entries(F.map_filter(m, lambda k, v: ~k.isin(*C.SEVERITIES))),
                                     lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return F.array_join(F.concat(F.array(*fixed), extra), ";")


@register("report_sink", _REPORT_SQL)
def q_report_sink(spark, sf_dir):
    """Nested scan report per repository written as JSON to the shared folder and read back."""
    from keysweep.sources.sinks import read_reports, scan_reports, write_reports
    from keysweep.session import shared_dir
    kept, dets = _corpus_dets(spark, sf_dir)
    out = shared_dir(spark, "reports")
    write_reports(scan_reports(kept, dets), out)
    r = read_reports(spark, out)
    return r.select(*REPO_KEYS, "path", "total_files_scanned", "files_with_secrets", "total_secrets_found",
                    _breakdown_string(F.col("summary.severity_breakdown")).alias("severity_breakdown"),
                    F.array_join(F.transform("summary.top_secret_types",
                                             lambda t: F.concat(t["type"], F.lit(":"), t["count"].cast("string"))),
                                 ",").alias("top_secret_types"))


@register("analysis_sink", f"""
WITH r AS ({_REPORT_SQL}),
det AS {_CORPUS_DET},
sev AS (SELECT repository, branch, {Q.severity_counts()} FROM det GROUP BY ALL),
a AS (SELECT r.repository, r.branch, r.total_files_scanned, r.total_secrets_found,
             CAST(coalesce(critical, 0) AS BIGINT) AS critical, CAST(coalesce(high, 0) AS BIGINT) AS high,
             CAST(coalesce(medium, 0) AS BIGINT) AS medium, CAST(coalesce(low, 0) AS BIGINT) AS low
      FROM r LEFT JOIN sev ON r.repository = sev.repository AND r.branch = sev.branch),
b AS (SELECT *, {Q.risk_score()} AS risk_score FROM a)
SELECT repository, branch, total_files_scanned, total_secrets_found, critical, high, medium, low, risk_score,
       {Q.compliance('risk_score')} AS compliance_status,
       CAST(len({Q.remediation_steps()}) AS INTEGER) AS n_steps
FROM b""")
def q_analysis_sink(spark, sf_dir):
    """Report + analysis with score, status and steps lifted to the top level (parquet round trip)."""
    from keysweep.sources.sinks import analysis_reports, read_parquet_table, write_parquet_table
    from keysweep.session import shared_dir
    kept, dets = _corpus_dets(spark, sf_dir)
    out = shared_dir(spark, "analysis")
    write_parquet_table(analysis_reports(kept, dets), out)
    a = read_parquet_table(spark, out)
    return a.select(*REPO_KEYS, "total_files_scanned", "total_secrets_found",
                    *[F.col("analysis." + s).alias(s) for s in C.SEVERITIES], "risk_score", "compliance_status",
                    F.size("remediation_steps").alias("n_steps"))


@register("report_results", f"""
WITH det AS {_CORPUS_DET}
SELECT repository, branch, path, type, severity, line, "column", value,
  CASE max({Q.severity_rank()}) OVER (PARTITION BY repository, branch, path) WHEN 4 THEN 'critical' WHEN 3 THEN 'high'
       WHEN 2 THEN 'medium' ELSE 'low' END AS file_severity,
  count(*) OVER (PARTITION BY repository, branch, path) AS file_detections
FROM det""")
def q_report_results(spark, sf_dir):
    """Results nested as a report carries them, in chunks of bounded size, written as JSON, read back and flattened; figures
    of a file that two chunks share are put together again."""
    from pyspark.sql import Window
    from keysweep.session import shared_dir
    from keysweep.sources.sinks import chunked_detections, result_chunks, write_reports
    _, dets = _corpus_dets(spark, sf_dir)
    out = shared_dir(spark, "results")
    chunks = result_chunks(dets.select(*FILE_KEYS, "type", "severity", "line", "column", "value"), chunk_bytes=4096)
    write_reports(chunks, out)
    file = Window.partitionBy(*FILE_KEYS)
    return chunked_detections(spark.read.schema(chunks.schema).json(out)).select(
        *FILE_KEYS, "type", "severity", "line", "column", "value", R.rank_label(F.max(R.severity_rank()).over(file)).alias("file_severity"),
        F.count(F.lit(1)).over(file).alias("file_detections"))


@register("scan_stream", f"SELECT repository, branch, path, type, line, \"column\", value FROM {Q.detections(Q.files())}")
def q_scan_stream(spark, sf_dir):
    """The row-level detection as a Structured Streaming query (availableNow) over the
    documents directory; output appended to the shared folder and read back."""
    from keysweep.streaming.scan_stream import run_detection_stream
    return run_detection_stream(spark, sf_dir).select(*FILE_KEYS, "type", "line", "column", "value")


_LAST_VERSIONS = f"""(SELECT repository, branch, path, content FROM (SELECT *, row_number() OVER (PARTITION BY repository, branch, path
  ORDER BY version DESC) AS rn FROM ({derived_sql('file_versions')}) v) x WHERE rn = 1 AND content IS NOT NULL AND content <> '')"""


@register("stream_totals", f"""
WITH f AS {_LAST_VERSIONS}, d AS {Q.detections(_LAST_VERSIONS)},
n AS (SELECT repository, branch, count(*) AS files FROM f GROUP BY ALL),
s AS (SELECT repository, branch, count(DISTINCT path) AS fw, count(*) AS secrets, {Q.severity_counts()} FROM d GROUP BY ALL),
j AS (SELECT n.repository, n.branch, n.files, coalesce(fw, 0) AS files_with_secrets, coalesce(secrets, 0) AS secrets,
             coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low
      FROM n LEFT JOIN s ON n.repository = s.repository AND n.branch = s.branch)
SELECT *, {Q.risk_score()} AS risk_score, {Q.compliance(Q.risk_score())} AS compliance_status FROM j""")
def q_stream_totals(spark, sf_dir):
    """X1 with state: totals per repository as a stream, over files that come twice, change and go; equal to the batch totals
    of the last version of each file."""
    from keysweep.session import shared_dir
    from keysweep.streaming.scan_stream import document_stream
    from keysweep.streaming.totals_stream import drain
    from keysweep.sources import derived
    versions = spark.sql(derived.spark_sql_text("file_versions"), documents=document_stream(spark, sf_dir))
    return drain(spark, versions, shared_dir(spark, "stream-totals"))


# ---------------------------------------------------------------------------
# Order at the sink, flattening nested results, stacking sources.
# ---------------------------------------------------------------------------

@register("result_order", f"""SELECT repository, branch, path, CAST(row_number() OVER (PARTITION BY repository, branch, path
  ORDER BY line, "column", type) AS INTEGER) AS seq, type, line, "column" FROM {_det_sql()} d""")
def q_result_order(spark, sf_dir):
    """K3: detections in (path, line, column, type) order: a per-file sequence number
    (window over one file's hits, bounded by the file size) and a range-partitioned
    global sort -- never one task per repository."""
    from pyspark.sql import Window
    dets = D.detections(S.seeded_documents(spark, sf_dir))
    w = Window.partitionBy(*FILE_KEYS).orderBy("line", "column", "type")
    return (dets.select(*FILE_KEYS, F.row_number().over(w).alias("seq"), "type", "line", "column")
            .orderBy(*FILE_KEYS, "seq"))


@register("flatten", f"SELECT repository, branch, path, type, line, \"column\", value FROM {_det_sql()} d")
def q_flatten(spark, sf_dir):
    """Nested per-file results (file, severity, detections[]) -- the shape a
    report carries -- flattened back to one row per detection with explode."""
    dets = D.detections(S.seeded_documents(spark, sf_dir))
    nested = dets.groupBy(*FILE_KEYS).agg(
        F.max(R.severity_rank()).alias("rank"),
        F.collect_list(F.struct("type", "line", "column", "value")).alias("detections"))
    return nested.select(*FILE_KEYS, F.explode("detections").alias("d")).select(
        *FILE_KEYS, "d.type", "d.line", "d.column", "d.value")


@register("union_sources", f"""
SELECT 'documents' AS source, repository, branch, path, size FROM ({Q.files()}) a
UNION ALL SELECT 'pages' AS source, concat('web/', regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)),
  'main', concat('pages/', cast(page_id as string), '.html'), CAST(strlen(html) AS BIGINT) FROM pages
UNION ALL SELECT 'conversations', concat('chat/c', cast(conv_id as string)), 'main',
  concat('turns/', cast(turn as string), '-', role, '.txt'), CAST(strlen(text) AS BIGINT) FROM conversations""")
def q_union_sources(spark, sf_dir):
    """The three text tables stacked by name into one files input."""
    docs = S.seeded_documents(spark, sf_dir).select(F.lit("documents").alias("source"), *FILE_KEYS, "size")
    pages = S.read_table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("source"),
        F.concat(F.lit("web/"), F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)).alias("repository"),
        F.lit("main").alias("branch"), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"),
        F.octet_length("html").cast("bigint").alias("size"))
    conv = S.read_table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("source"),
        F.concat(F.lit("chat/c"), F.col("conv_id").cast("string")).alias("repository"), F.lit("main").alias("branch"),
        F.concat(F.lit("turns/"), F.col("turn").cast("string"), F.lit("-"), F.col("role"), F.lit(".txt")).alias("path"),
        F.octet_length("text").cast("bigint").alias("size"))
    return docs.unionByName(pages).unionByName(conv)
