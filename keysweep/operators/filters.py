"""File and line filters (F1-F9), the file cap (F5) and path requests.

The path tests (F1, F2) only touch ``path`` and run first; the content tests
(F3, F4) use a byte-length bound so the exact UTF-16 count is computed only for
files near the limit.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysweep import REPO_KEYS
from keysweep import catalog as C
from keysweep.operators.topk import top_k_per_group


def binary_regex() -> str:
    return r"\.(" + "|".join(re.escape(e[1:]) for e in C.BINARY_EXTENSIONS) + r")$"


def skip_dir_regex() -> str:
    return "(^|/)(" + "|".join(re.escape(d) for d in C.SKIP_DIRS) + ")/"


def is_binary(path: Column) -> Column:
    """case-insensitive binary suffix."""
    return F.lower(path).rlike(binary_regex())


def in_skip_dir(path: Column) -> Column:
    """a skipped directory as first or inner segment (case-sensitive)."""
    return path.rlike(skip_dir_regex())


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 code units, as JS ``String.length`` counts."""
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("bigint")


def fits_size(content: Column, max_size: int) -> Column:
    """UTF-16 length <= max.  Bytes >= units >= code points, so the exact (costly)
    count is only needed when the two cheap bounds disagree."""
    return (F.when(F.octet_length(content) <= max_size, F.lit(True))
            .when(F.length(content) > max_size, F.lit(False))
            .otherwise(utf16_length(content) <= max_size))


def has_content(content: Column) -> Column:
    """non-null, non-empty."""
    return content.isNotNull() & (content != "")


def skip_reason(path: Column, content: Column, max_size: int | None = None) -> Column:
    """first reason that applies, or null for a kept file; without ``max_size`` none is too large."""
    reason = (F.when(is_binary(path), F.lit("binary"))
              .when(in_skip_dir(path), F.lit("skip_dir"))
              .when(~has_content(content), F.lit("no_content")))
    return reason if max_size is None else reason.when(~fits_size(content, max_size), F.lit("too_large"))


def keep_files(files: DataFrame, max_size: int | None = None) -> DataFrame:
    """Path tests first, then content tests; the size test only if a limit is asked for."""
    kept = (files.where(~is_binary(F.col("path")) & ~in_skip_dir(F.col("path")))
            .where(has_content(F.col("content"))))
    return kept if max_size is None else kept.where(fits_size(F.col("content"), max_size))


def over_cap(keyed: DataFrame, max_files: int, keys=REPO_KEYS) -> DataFrame:
    """Repositories with more than ``max_files`` files (a partial aggregate on keys)."""
    k = list(keys)
    return keyed.groupBy(*k).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_files).select(*k)


def cap_cutoffs(keyed: DataFrame, max_files: int, keys=REPO_KEYS,
                salt_buckets: int = 64, big: DataFrame | None = None) -> DataFrame:
    """(keys, _cutoff): for each repository with more than ``max_files`` files, the
    path ranked ``max_files`` -- from (keys, path) rows only.  Counting is a partial
    aggregate; ranking is the skew-safe top-k, run only for over-cap repositories."""
    k = list(keys)
    big = over_cap(keyed, max_files, keys) if big is None else big
    over = keyed.join(big, k, "left_semi")
    top = top_k_per_group(over, k, [F.col("path").asc()], max_files, ["path"], salt_buckets)
    return top.groupBy(*k).agg(F.max("path").alias("_cutoff"))


def apply_cap(df: DataFrame, cutoffs: DataFrame, keys=REPO_KEYS) -> DataFrame:
    """Keep rows whose repository has no cutoff or whose path is <= it.
    Pass ``broadcast_if_small(cutoffs)`` to keep the content side unshuffled."""
    k = list(keys)
    j = df.join(cutoffs, k, "left")
    return j.where(F.col("_cutoff").isNull() | (F.col("path") <= F.col("_cutoff"))).drop("_cutoff")


def cap_files(files: DataFrame, max_files: int, keys=REPO_KEYS,
              salt_buckets: int = 64) -> DataFrame:
    """at most ``max_files`` files per (repository, branch), first by path.

    File content is never shuffled: the (keys, path) list is checkpointed (one
    pass, compact), cutoffs come from it, and the files are filtered through a
    size-checked broadcast of the cutoffs (one row per over-cap repository);
    beyond the bound the planner shuffles and AQE splits a skewed repository.
    Duplicate paths equal to a cutoff are all kept.  The scan job applies the
    same cutoffs to its one-pass output instead (``plans.corpus_scan``)."""
    from keysweep.session import checkpoint_root
    checkpoint_root(files.sparkSession)
    keyed = files.select(*keys, "path").checkpoint(eager=True)
    big = over_cap(keyed, max_files, keys)
    if big.count() == 0:  # no repository over the cap: nothing to rank or join
        return files
    cut = broadcast_if_small(cap_cutoffs(keyed, max_files, keys, salt_buckets, big=broadcast_if_small(big)))
    return apply_cap(files, cut, keys)


BROADCAST_MAX_ROWS = 100_000  # key rows of ~100-200 bytes: a 10-20 MB broadcast at most


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Materialise a small derived table once (reliable checkpoint), count it, and
    hint a broadcast only under ``max_rows``; bigger tables are left to the planner
    (shuffle join, AQE skew handling).  Every join of it then reads the stored
    rows instead of recomputing its lineage."""
    from keysweep.session import checkpoint_root
    checkpoint_root(df.sparkSession)
    df = df.checkpoint(eager=True)
    return F.broadcast(df) if df.count() <= max_rows else df


def scan_path(files: DataFrame, requests: DataFrame, prefix: bool = False) -> DataFrame:
    """The files named by (repository, branch, path) requests.

    Exact path by default: a semi join on the full file key, broadcast when the
    request list is small.  With ``prefix`` a request also selects every file
    below ``path/``: each file path is expanded into its own ancestor prefixes
    (bounded by the path depth) and matched by equality, so no group ever pairs
    all its files with all its requests."""
    keys = ["repository", "branch", "path"]
    req = requests.select(*keys).where(F.col("path").isNotNull()).distinct()
    if not prefix:
        return files.join(broadcast_if_small(req), keys, "left_semi")
    parts = F.split(F.col("path"), "/", -1)
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    expanded = files.select("repository", "branch", F.col("path").alias("_file"), F.explode(ancestors).alias("path"))
    matched = (expanded.join(broadcast_if_small(req), keys, "left_semi")
               .select("repository", "branch", F.col("_file").alias("path")).distinct())
    return files.join(broadcast_if_small(matched), keys, "left_semi")


def skip_comment_lines(line_text: Column) -> Column:
    """F7 predicate: True for lines to keep (non-blank and not a comment)."""
    return (F.trim(line_text) != "") & ~line_text.rlike(C.COMMENT_PREFIX_RE)


#: What stands before the value in a match of a rule for assignments: a name, the sign and an opening quote.
ASSIGNED = r"^[^=:]*[=:]\s*['\"]?"


def false_positive(raw: Column, pattern: Column) -> Column:
    """F8 predicate on the value of a match (of a rule for assignments what is assigned, else the whole match): placeholder,
    example or test values, one repeated character, or fewer than ``MIN_DISTINCT_CHARS`` distinct characters."""
    value = F.when(pattern.contains("[=:]"), F.regexp_replace(raw, ASSIGNED, "")).otherwise(raw)
    distinct = F.size(F.array_distinct(F.split(value, "", -1)))
    return (raw.rlike(C.PLACEHOLDER_RE) | raw.rlike(C.TEST_TOKEN_RE)
            | (F.length(F.replace(value, F.left(value, F.lit(1)), F.lit(""))) == 0)
            | (distinct < C.MIN_DISTINCT_CHARS))


def is_test_path(path: Column) -> Column:
    return path.rlike(C.TEST_PATH_RE)


def log_level_filter(logs: DataFrame, threshold: str = "INFO") -> DataFrame:
    """keep entries at or above the threshold; an unknown threshold means INFO."""
    order = {lvl: i for i, lvl in enumerate(C.LOG_LEVELS)}
    t = order.get((threshold or "").upper(), order["INFO"])
    rank = F.element_at(F.create_map(*[x for lvl, i in order.items() for x in (F.lit(lvl), F.lit(i))]),
                        F.col("level"))
    return logs.where(rank >= t)
