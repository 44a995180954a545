"""The scan of a checked-out tree: every file of it ends up scanned or skipped with a reason.

The listing (path, length, time of change) reads no content.  Files of up to ``whole_bytes`` are a row each and go through
``scan_corpus``; larger ones are read as byte ranges (``sources.ranges``), many tasks to a file, with the same rules on the same
lines.  A file over the size limit by its length alone is never opened.  What the listing has and no pass has returned could not
be read, and is listed as such.  ``rescan_tree`` reads only what has changed since an earlier scan.  Files of no bytes are in no listing of Spark's file sources, and so in neither table.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysweep import FILE_KEYS
from keysweep import catalog as C
from keysweep.operators import detect as D
from keysweep.operators import filters as FL
from keysweep.operators.blocks import with_blocks
from keysweep.operators.overlaps import most_specific
from keysweep.plans.corpus_scan import Scan, capped, scan_corpus
from keysweep.session import checkpoint_root
from keysweep.sources import ranges
from keysweep.sources.tables import list_tree, read_file_tree, relative_path

#: Larger files are read as ranges.
WHOLE_BYTES = 32 * 1024 * 1024
#: A file of so many bytes per allowed UTF-16 unit is over the limit, whatever it holds.
BYTES_PER_UNIT = 3
TOO_LARGE, UNREADABLE = "too_large", "unreadable"


def scan_ranges(spark: SparkSession, root: str, repository: str, branch: str = C.DEFAULT_BRANCH, over_bytes: int = WHOLE_BYTES,
                most_bytes: int | None = None, glob: str | None = None, max_size: int | None = None, with_context: bool = False,
                value_salt: str | None = None, skip_comments: bool = False, drop_false_positives: bool = False,
                blocks: bool = True, verdicts: bool = False, drop_invalid: bool = False, no_overlaps: bool = False, changed: list[tuple[int, int]] | None = None,
                only: DataFrame | None = None) -> Scan:
    """``scan_corpus`` for files of more than ``over_bytes``, line by line.  The same results but for one case: a carriage return
    that ends the file, with no line feed behind it, is not part of the last line.  ``changed``: spans of times of change that files
    to be read have; ``only``: the paths of those that are wanted among them."""
    checkpoint_root(spark)
    keys = ["file", "range_start"]
    rules = [*C.RULES, *C.BLOCK_MARKERS] if blocks else C.RULES
    path = relative_path(spark, root, F.col("file"), encoded=True)
    named = [F.lit(repository).alias("repository"), F.lit(branch).alias("branch"), path.alias("path")]
    lines = ranges.read_lines(spark, root, over_bytes, glob, most_bytes, changed)
    if only is not None:
        lines = lines.join(only, path == F.col("_path"), "left_semi")
    with ranges.same_ranges(spark):
        counts = FL.broadcast_if_small(ranges.range_counts(lines))
        open_lines = lines.where(~FL.is_binary(path) & ~FL.in_skip_dir(path)).select(*keys, "row", "line_text", F.lower("line_text").alias("line_lower"))
        kept_lines = open_lines.where(D.line_gate(rules, skip_comments)).withColumnRenamed("row", "line")
        hits = D.records(D.line_hits(kept_lines, rules, keys, with_context=with_context), rules, keys, with_context,
                         drop_false_positives, value_salt=value_salt, verdicts=verdicts or drop_invalid, spans=no_overlaps)
        if drop_invalid:
            hits = hits.where("failed_check is null")
        hits = ranges.numbered(hits.withColumnRenamed("line", "row"), counts).drop("row").checkpoint()
    files = counts.groupBy("file").agg(F.max("file_size").alias("size"), F.max("units").alias("units")).select(
        *named, "size", "units", "file")
    reason = F.when(FL.is_binary(F.col("path")), "binary").when(FL.in_skip_dir(F.col("path")), "skip_dir")
    if max_size is not None:
        reason = reason.when(F.col("units") > max_size, TOO_LARGE)
    files = files.withColumn("skip_reason", reason).drop("units").checkpoint()
    if blocks:
        hits = with_blocks(hits, ["file"], "range_start")
    if no_overlaps:
        hits = most_specific(hits, ["file"], rules).drop("end_column").checkpoint()
    dropped = files.where("skip_reason is not null").select("file")
    dets = hits.join(FL.broadcast_if_small(dropped), "file", "left_anti").select(*named, *[c for c in hits.columns if c not in keys])
    return Scan(files.where("skip_reason is null").select(*FILE_KEYS, "size"), dets,
                files.where("skip_reason is not null").select(*FILE_KEYS, "size", "skip_reason"))


def scan_tree(spark: SparkSession, root: str, repository: str, branch: str = C.DEFAULT_BRANCH, glob: str | None = None,
              whole_bytes: int = WHOLE_BYTES, max_size: int | None = None, max_files: int | None = None, **options) -> Scan:
    """S1, D1 and D6 over the files below ``root`` (those whose names match ``glob``): kept and skipped are all its files.
    ``options`` as for ``scan_corpus``; ``blank_comments`` is for files of one row: of files that are read as ranges, matches in
    comments are reported."""
    checkpoint_root(spark)
    found = list_tree(spark, root, repository, branch, glob).checkpoint()
    return capped(_scan_listed(spark, found, root, repository, branch, glob, whole_bytes, max_size, options), max_files)


def _scan_listed(spark: SparkSession, found: DataFrame, root: str, repository: str, branch: str, glob: str | None, whole_bytes: int,
                 max_size: int | None, options: dict, changed: list[tuple[int, int]] | None = None) -> Scan:
    """The scan of the files of ``found`` (a listing); with ``changed``, those are some of the tree's, in these spans."""
    most = None if max_size is None else BYTES_PER_UNIT * max_size
    files = read_file_tree(spark, root, repository, branch, glob, max_bytes=whole_bytes if most is None else min(whole_bytes, most),
                           skip_unreadable=True, changed=changed)
    only = None
    if changed is not None:
        only = FL.broadcast_if_small(found.select(F.col("path").alias("_path")))
        files = files.join(only, F.col("path") == F.col("_path"), "left_semi")
    kept, dets, skipped = scan_corpus(files, max_size=max_size, blocks=True, **options)
    dets = dets.withColumns({c: F.col(c).cast("long") for c in ("line", "end_line")})
    large = found.where(F.col("size") > whole_bytes)
    if not (large if most is None else large.where(F.col("size") <= most)).isEmpty():
        by_lines = {k: v for k, v in options.items() if k != "blank_comments"}
        more = scan_ranges(spark, root, repository, branch, whole_bytes, most, glob, max_size, changed=changed, only=only, **by_lines)
        kept, dets, skipped = (a.unionByName(b) for a, b in zip((kept, dets, skipped), more))
    seen = kept.select(*FILE_KEYS).unionByName(skipped.select(*FILE_KEYS))
    reason = F.lit(UNREADABLE)
    if most is not None:
        early = F.when(FL.is_binary(F.col("path")), "binary").when(FL.in_skip_dir(F.col("path")), "skip_dir")
        reason = F.coalesce(early, F.when(F.col("size") > most, F.lit(TOO_LARGE)).otherwise(reason))
    rest = found.select(*FILE_KEYS, "size").join(seen, FILE_KEYS, "left_anti").withColumn("skip_reason", reason)
    return Scan(kept, dets, skipped.unionByName(rest))


#: Spans of times into which the changed files of a tree are gathered.
SPANS = 64


def _spans(fresh: DataFrame) -> list[tuple[int, int]]:
    """At most ``SPANS`` + 1 spans of time that hold the times of change of all files of ``fresh``."""
    times = fresh.select(F.unix_micros("modified").alias("t"))
    low, high = times.agg(F.min("t"), F.max("t")).first()
    part = F.floor((F.col("t") - low) * SPANS / F.lit(max(1, high - low)))
    return [(r.low, r.high) for r in times.groupBy(part.alias("part")).agg(F.min("t").alias("low"), F.max("t").alias("high")).collect()]


def fingerprint(**options) -> str:
    """What a scan's results depend on besides the files: the rules, and the options that change detections."""
    rules = [(r.type, r.severity, r.pattern) for r in [*C.RULES, *C.BLOCK_MARKERS]]
    return hashlib.sha256(json.dumps([rules, sorted(options.items())], default=str).encode()).hexdigest()


def rescan_tree(spark: SparkSession, root: str, repository: str, previous: tuple[DataFrame, DataFrame] | None = None,
                branch: str = C.DEFAULT_BRANCH, glob: str | None = None, whole_bytes: int = WHOLE_BYTES, max_size: int | None = None,
                **options) -> tuple[Scan, DataFrame]:
    """``scan_tree`` that reads only what has changed: the scan of the whole tree, and the manifest for the next time.

    ``previous``: the manifest and the detections of an earlier scan.  A file of the same path, length and time of change that was
    scanned with the same rules and options isn't read again; its detections are taken over.  Files that are gone are gone, files
    that could not be read are tried again.  The reader leaves files out by their time of change: it reads those in the spans of
    time that hold a changed file, and an unchanged tree isn't read at all."""
    checkpoint_root(spark)
    mark = fingerprint(max_size=max_size, **options)
    found = list_tree(spark, root, repository, branch, glob).checkpoint()
    status = [*FILE_KEYS, "size", "modified"]
    if previous is None:
        scan = _scan_listed(spark, found, root, repository, branch, glob, whole_bytes, max_size, options)
    else:
        manifest, old = previous
        known = manifest.where((F.col("fingerprint") == mark) & (F.coalesce("skip_reason", F.lit("")) != UNREADABLE))
        same = found.join(known.select(*status, "skip_reason"), status).checkpoint()
        fresh = found.join(same, FILE_KEYS, "left_anti").checkpoint()
        kept = same.where("skip_reason is null").select(*FILE_KEYS, "size")
        scan = Scan(kept, old.join(kept, FILE_KEYS, "left_semi"), same.where("skip_reason is not null").select(*FILE_KEYS, "size", "skip_reason"))
        if not fresh.isEmpty():
            new = _scan_listed(spark, fresh, root, repository, branch, glob, whole_bytes, max_size, options, changed=_spans(fresh))
            scan = Scan(*(a.unionByName(b) for a, b in zip(scan, new)))
    state = scan.kept.withColumn("skip_reason", F.lit(None).cast("string")).unionByName(scan.skipped)
    return scan, found.join(state.select(*FILE_KEYS, "skip_reason"), FILE_KEYS).withColumn("fingerprint", F.lit(mark))
