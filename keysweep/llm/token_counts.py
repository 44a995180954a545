"""Operator 9, exact length histogram.

Documents are counted by encoded length; suffix sums over that histogram answer totals, quantiles and truncated totals
for every context limit without looking at a document again. The suffix sums run in blocks of lengths (each block a
window of its own, the blocks' totals a far smaller table), so no task holds the whole histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysweep.llm.common import narrow, read, small_batches
from keysweep.llm.wordbpe import default_path, words_of
from keysweep.session import checkpoint_root

#: Lengths in one block of the suffix sums.
BLOCK = 512


def lengths(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every row (null text: 0)."""
    path = tokenizer_path or default_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for batch in batches:
            counts = [len(words.encode(t)) // 4 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """From n_tokens to a row per distinct length: n_docs of it, docs_longer, tokens_longer (of all longer documents),
    docs_total, tokens_total, truncated_total (tokens that remain if every document is cut there) and quantile (share
    of documents that fit).

    Between two lengths L < c no document ends, so the truncated total at a limit c is the one at L plus
    (c - L) * docs_longer: ``at_limits`` uses that.

    Edge cases: rows with a null length play no part; documents of length 0 are a row of their own; an empty table
    gives no rows.
    """
    base = (counted.where("n_tokens is not null").groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
            .select(F.col("n_tokens").alias("length"), "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"),
                    F.floor(F.col("n_tokens") / BLOCK).alias("block")))
    checkpoint_root(base.sparkSession)
    base = base.checkpoint()  # far fewer rows than documents; both uses below would else encode all texts
    blocks = base.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select("block", F.coalesce(F.sum("b_docs").over(later), zero).alias("after_docs"),
                           F.coalesce(F.sum("b_tokens").over(later), zero).alias("after_tokens"),
                           F.sum("b_docs").over(whole).alias("docs_total"),
                           F.sum("b_tokens").over(whole).alias("tokens_total"))
    longer = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    out = (base.join(blocks, "block")
           .withColumn("docs_longer", F.coalesce(F.sum("n_docs").over(longer), zero) + F.col("after_docs"))
           .withColumn("tokens_longer", F.coalesce(F.sum("tokens").over(longer), zero) + F.col("after_tokens")))
    return out.select("length", "n_docs", "docs_longer", "tokens_longer", "docs_total", "tokens_total",
                      (F.col("tokens_total") - F.col("tokens_longer")
                       + F.col("length") * F.col("docs_longer")).alias("truncated_total"),
                      (1 - F.col("docs_longer") / F.col("docs_total")).alias("quantile"))


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: docs_total, docs_cut, tokens_total and truncated_total; limits below every length keep
    ``limit`` tokens of each document. Repeated limits give repeated rows; an empty histogram gives none."""
    below = F.when(F.col("length") <= F.col("context_limit"), F.struct("length", "truncated_total", "docs_longer"))
    return (hist.select("*", F.posexplode(F.array(*[F.lit(int(c)).cast("long") for c in limits])).alias("n", "context_limit"))
            .groupBy("n", "context_limit")
            .agg(F.max(below).alias("b"), F.max("docs_total").alias("docs_total"),
                 F.max("tokens_total").alias("tokens_total"))
            .select("context_limit", "docs_total", F.coalesce("b.docs_longer", "docs_total").alias("docs_cut"),
                    "tokens_total",
                    F.coalesce(F.col("b.truncated_total")
                               + (F.col("context_limit") - F.col("b.length")) * F.col("b.docs_longer"),
                               F.col("context_limit") * F.col("docs_total")).alias("truncated_total")))


def quantiles(hist: DataFrame, shares: list[float]) -> DataFrame:
    """For each share in (0, 1]: the least length that at least that share of the documents does not exceed."""
    need = F.ceil(F.col("share") * F.col("docs_total") - F.lit(1e-9))
    return (hist.select("*", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
            .where(F.col("docs_total") - F.col("docs_longer") >= need)
            .groupBy("share").agg(F.min("length").alias("length")))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole histogram of ``documents`` with its suffix sums."""
    return histogram(lengths(read(spark, sf_dir, "documents")))


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLE: dict[str, str] = {}
