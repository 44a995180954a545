"""D6 within the one pass of the scan: blocks that span lines, from the matches of their ends on single lines.

A block goes from a header to the first footer behind it; headers inside it and footers outside of any are nothing.  So a header
opens a block if what stands before it, among headers and footers, is a footer or nothing, and a footer closes one if what
stands before it is a header.  Only these few marks are ordered, file by file.  A file that is read in parts is ordered part by
part; of each part only its first and last mark meet those of the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keysweep import FILE_KEYS
from keysweep import catalog as C
from keysweep.session import checkpoint_root

BEGIN, END = (r.type for r in C.BLOCK_MARKERS)
PLACE = ["line", "column"]


def _neighbour(marks: DataFrame, value: Column, keys: list[str], part: str | None, name: str, after: bool) -> DataFrame:
    """``marks`` with the ``value`` of the mark before (or after) it in its file."""
    step, pick = (F.lead, F.min_by) if after else (F.lag, F.max_by)
    within = [*keys, part] if part else keys
    near = step(value).over(Window.partitionBy(*within).orderBy(*PLACE))
    if part is None:
        return marks.withColumn(name, near)
    edges = marks.groupBy(*within).agg(pick(value, F.struct(*PLACE)).alias("_edge"))
    far = step("_edge").over(Window.partitionBy(*keys).orderBy(part))
    edges = edges.select(*[F.col(k).alias(f"_{k}") for k in within], far.alias("_far"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in within]
    joined = marks.withColumn(name, near).join(edges, same)
    return joined.withColumn(name, F.coalesce(name, "_far")).drop("_far", *[f"_{k}" for k in within])


def paired(marks: DataFrame, keys=FILE_KEYS, part: str | None = None) -> DataFrame:
    """From the headers and footers of files (keys, type, line, column, ...) to the headers that open a block, with end_line."""
    keys = list(keys)
    marks = _neighbour(marks, F.col("type"), keys, part, "_before", after=False)
    opens = (F.col("type") == BEGIN) & (F.col("_before").isNull() | (F.col("_before") == END))
    ends = marks.where(opens | ((F.col("type") == END) & (F.col("_before") == BEGIN))).drop("_before")
    # openings and closings alternate from here on
    ends = _neighbour(ends, F.col("line"), keys, part, "end_line", after=True)
    return ends.where((F.col("type") == BEGIN) & F.col("end_line").isNotNull())


def with_blocks(rows: DataFrame, keys=FILE_KEYS, part: str | None = None) -> DataFrame:
    """Detection records of a pass whose rules included ``BLOCK_MARKERS``: with their matches replaced by the blocks that they
    make, and end_line (of other matches: their own line).  A block whose header is a rule's match already isn't counted again.

    ``rows`` should be a table: it is read three times.  Rows without a type pass as they are; an unclosed header is no block.
    """
    mark = F.col("pattern").isin(*[r.pattern for r in C.BLOCK_MARKERS])
    plain = rows.where(F.col("type").isNull() | ~mark).withColumn("end_line", F.col("line"))
    found = paired(rows.where(mark), keys, part).withColumn("pattern", F.lit(C.BLOCK_RULE.pattern)).withColumn(
        "value", F.lit(C.BLOCK_BEGIN[:6] + "****" + C.BLOCK_END[-6:]))
    headers = plain.where(F.col("pattern").contains("PRIVATE KEY")).select(*keys, *PLACE).distinct()
    there = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, *PLACE]]
    found = found.join(headers.select(*[F.col(k).alias(f"_{k}") for k in [*keys, *PLACE]]), there, "left_anti")
    checkpoint_root(rows.sparkSession)
    return plain.unionByName(found.checkpoint())
