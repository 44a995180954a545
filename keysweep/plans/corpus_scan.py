"""The batch scan plan shared by the corpus-level queries and the scan job.

One narrow pass over the content: F6 (why a file is skipped, if it is), then detection with one marker row per file.  Its
output is compact (a row per file plus a row per hit, values already masked -- no raw secret is ever persisted) and is
checkpointed to the shared folder: a reliable lineage cut, so a lost executor never re-runs the regex pass, and every
downstream branch (file cap, totals, roll-ups, reports) reads the small table instead of rescanning the content.

No file is left out unless the caller asks for a limit, and every file left out is listed with its reason.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysweep import FILE_KEYS
from keysweep import catalog as C
from keysweep.operators import detect as D
from keysweep.operators import filters as FL
from keysweep.operators.blocks import with_blocks
from keysweep.operators.overlaps import most_specific
from keysweep.session import checkpoint_root

OVER_CAP = "over_file_cap"


class Scan(NamedTuple):
    """kept: keys + size of the scanned files; detections; skipped: keys, size and skip_reason of all others."""

    kept: DataFrame
    detections: DataFrame
    skipped: DataFrame


def scan_corpus(files: DataFrame, max_size: int | None = None, max_files: int | None = None, with_context: bool = False,
                value_salt: str | None = None, skip_comments: bool = False, drop_false_positives: bool = False,
                every_file: bool = False, blocks: bool = False, verdicts: bool = False, drop_invalid: bool = False,
                blank_comments: bool = False, no_overlaps: bool = False) -> Scan:
    """F1-F4 and detection, F3 and F5 only with their limits given.  ``every_file``: F1 and F2 leave nothing out either.
    ``blocks``: D6 too, out of the same pass; detections then have end_line.  ``verdicts``: they have failed_check, the first check
    of their type that they fail; with ``drop_invalid`` those that fail one are left out.  ``blank_comments``: F7 by file type.
    ``no_overlaps``: of overlapping matches the most specific one only."""
    checkpoint_root(files.sparkSession)
    path, content = F.col("path"), F.col("content")
    reason = F.when(~FL.has_content(content), F.lit("no_content")) if every_file else FL.skip_reason(path, content, max_size)
    marked = files.withColumn("skip_reason", reason)
    marked = marked.withColumn("content", F.when(F.col("skip_reason").isNull(), content))
    rows = D.detections(marked, rules=[*C.RULES, *C.BLOCK_MARKERS] if blocks else None, keys=[*FILE_KEYS, "size", "skip_reason"], file_rows=True, with_context=with_context,
                        value_salt=value_salt, skip_comments=skip_comments, drop_false_positives=drop_false_positives,
                        verdicts=verdicts or drop_invalid, blank_comments=blank_comments, spans=no_overlaps)
    if drop_invalid:
        rows = rows.where("failed_check is null")
    rows = rows.checkpoint(eager=True)
    file_rows = rows.where(F.col("type").isNull()).select(*FILE_KEYS, "size", "skip_reason")
    kept = file_rows.where("skip_reason is null").drop("skip_reason")
    skipped = file_rows.where("skip_reason is not null")
    dets = rows.where(F.col("type").isNotNull()).drop("size", "skip_reason")
    if blocks:
        dets = with_blocks(dets)
    if no_overlaps:
        dets = most_specific(dets).drop("end_column").checkpoint()
    return capped(Scan(kept, dets, skipped), max_files)


def capped(scan: Scan, max_files: int | None) -> Scan:
    """F5 on the compact tables of a scan: files over the cap, and their detections, move to ``skipped``."""
    kept, dets, skipped = scan
    if max_files is None:
        return Scan(kept, dets, skipped)
    big = FL.over_cap(kept, max_files)
    if big.count() == 0:  # no repository over the cap, nothing to join
        return Scan(kept, dets, skipped)
    big = FL.broadcast_if_small(big)
    cut = FL.broadcast_if_small(FL.cap_cutoffs(kept.select(*FILE_KEYS), max_files, big=big))
    dropped = kept.join(cut, ["repository", "branch"]).where("path > _cutoff").drop("_cutoff")
    return Scan(FL.apply_cap(kept, cut), FL.apply_cap(dets, cut),
                skipped.unionByName(dropped.withColumn("skip_reason", F.lit(OVER_CAP)).select(skipped.columns)))
