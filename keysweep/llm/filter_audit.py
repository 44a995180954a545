"""Operator 12, an audit of how document filters interact, by forward-backward path counting.

A document fails a set of filters. The sets of filters applied so far are the states of the subset lattice, an order of
filters is a path from the empty state to the full one, and an edge adds one filter to a state: it removes the documents that
fail this filter and none of the state's. Forward counts say in how many orders a state can be reached, backward counts in how
many it can be left; their product over an edge is the number of orders that take it, and weighs its removals for the Shapley
sums. The steps of each order are read from the same edges.

The cluster reduces documents to one row per part: for each of the 2 ** 5 sets of failed filters, how many documents fail
exactly these. All later work depends on the number of parts only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysweep.llm.common import flush, narrow, read, small_batches

FILTERS = "ABCDE"
FEW_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 200, 50, 2, b"#$%&*|"
#: The filter that compares documents; the others look at one text.
COPY = FILTERS.index("E")
_NOT_CAPITAL = bytes(set(range(256)) - set(range(65, 91)))
_NOT_SIGN = bytes(set(range(256)) - set(SIGNS))
_CONTINUES = bytes(range(128, 192))
#: What is counted of the documents of a set of failed filters.
COUNTS = ("n", "n_good", "n_toxic")
_OUT = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()),
                  *[(c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")],
                  ("orders", pa.int64())])


def text_failures(text: bytes) -> int:
    """Bits of the filters A to D that a text (UTF-8) fails."""
    words = text.split()  # of bytes: at the white space of ASCII
    capitals = len(text.translate(None, _NOT_CAPITAL))
    fails = (len(words) < FEW_WORDS, 100 * len(set(words)) < DISTINCT_PERCENT * len(words),
             100 * capitals > CAPITAL_PERCENT * len(text.translate(None, _CONTINUES)), bool(text.translate(None, _NOT_SIGN)))
    return sum(1 << k for k, fail in enumerate(fails) if fail)


def _judged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """doc_id, part, the text's failures and digest: texts end here."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([text_failures(t) for t in texts], pa.int32()),
                 pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], ["doc_id", "part", "fails", "digest"])

    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit(""))
    rows = narrow(docs, id_col, text_col, {"part": part}).select("doc_id", "part", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, fails int, digest binary")


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   part_col: str = "source") -> DataFrame:
    """part, fails (the bits of the failed filters) and how many documents fail exactly these: n, n_good, n_toxic.

    Only ids, digests and bits are shuffled, three times: to the labels, to equal texts of a part, to equal texts. Rows of the
    same id, text and part count as one row with a number, and so do all but one of a part's equal texts, before they meet.
    """
    small_batches(docs.sparkSession)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = _judged(docs, id_col, text_col, part_col).groupBy("doc_id", "digest", "part", "fails").agg(F.count("*").alias("n"))
    rows = rows.join(marks, "doc_id", "left").select(
        "doc_id", "digest", "part", "fails", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    # Of equal texts of a part only those of the smallest id can be the first of the table; a row without id is no copy.
    same = rows.groupBy("digest", "part", "fails", "good", "toxic", F.col("doc_id").isNull().alias("no_id")).agg(
        F.sum("n").alias("n"), F.min(F.struct("doc_id", F.col("n").alias("n"))).alias("first"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))  # a few rows per part at most, however many documents
    firsts = F.when(F.col("no_id"), F.col("n")).when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    split = same.withColumn("least", least).select("part", "fails", "good", "toxic", "n", firsts.alias("firsts"))
    split = split.select("part", "good", "toxic", F.explode(F.array(
        F.struct("fails", F.col("firsts").alias("n")),
        F.struct((F.col("fails") + (1 << COPY)).alias("fails"), (F.col("n") - F.col("firsts")).alias("n")))).alias("x"))
    return split.groupBy("part", F.col("x.fails").alias("fails")).agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("n_good"), F.sum(F.col("x.n") * F.col("toxic")).alias("n_toxic"))


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """For every subset of n filters: in how many orders it is reached from none, and left towards all."""
    forward, backward = [1] + [0] * (2 ** n - 1), [0] * (2 ** n - 1) + [1]
    for state in range(2 ** n):
        for f in range(n):
            if not state >> f & 1:
                forward[state | 1 << f] += forward[state]
    for state in reversed(range(2 ** n)):
        for f in range(n):
            if not state >> f & 1:
                backward[state] += backward[state | 1 << f]
    return forward, backward


def audit_part(counts: np.ndarray) -> list[tuple]:
    """From a part's counts (a row per set of failed filters) to the steps of all orders: order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley and orders (how many take this step's edge)."""
    n = len(FILTERS)
    states = np.arange(2 ** n)
    alive = np.array([counts[(states & s) == 0].sum(axis=0) for s in states])  # what no filter of a state removes
    failing = [int(counts[(states >> f & 1) == 1, 0].sum()) for f in range(n)]
    forward, backward = path_counts(n)
    edges, shapley = {}, [0] * n
    for s in states.tolist():
        for f in range(n):
            if not s >> f & 1:
                after = s | 1 << f
                removed, good, toxic = (alive[s] - alive[after]).tolist()
                orders = forward[s] * backward[after]
                shapley[f] += orders * removed
                edges[s, f] = (int(alive[after][0]), removed, failing[f] - removed, int(counts[1 << f, 0]), good, toxic, orders)
    out = []
    for order in permutations(range(n)):
        s, name = 0, "".join(FILTERS[f] for f in order)
        for step, f in enumerate(order, 1):
            *found, orders = edges[s, f]
            out.append((name, step, *found, shapley[f], orders))
            s |= 1 << f
    return out


def audit(counts: DataFrame) -> DataFrame:
    """From ``failure_counts`` to a row per part, order of the filters and step: kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (the filter's removals summed over all orders) and orders (how many take this edge)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                whole = np.zeros((2 ** len(FILTERS), len(COUNTS)), dtype=np.int64)
                for x in row["counts"]:
                    whole[x["fails"]] = [x[c] for c in COUNTS]
                yield from flush([(row["part"], *step) for step in audit_part(whole)], _OUT)

    parts = counts.groupBy("part").agg(F.collect_list(F.struct("fails", *COUNTS)).alias("counts"))  # 32 at most
    return parts.mapInArrow(run, "part string, filter_order string, step int, kept long, removed long, redundant long, "
                                 "unique_fails long, good_lost long, toxic_lost long, shapley long, orders long")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 part_col: str = "source") -> DataFrame:
    """How the five filters interact on each part of ``docs``, in every order; ``labels``: doc_id, quality, toxic.

    Edge cases: a null text is empty (it fails A, and E if another such row has a smaller id); a null part is the empty string;
    rows that repeat a doc_id are documents of their own, and equal texts of one doc_id are no copies of each other; a row
    without doc_id is never a copy, makes none and has no label; of a doc_id's repeated labels any that is 1 counts; labels of
    no document and labels without doc_id play no part; a part of which nothing fails has rows of zeros; an empty table gives no
    rows; other columns are ignored.
    """
    return audit(failure_counts(docs, labels, id_col, text_col, part_col))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents, a part per source."""
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("orders")


QUERIES = {"op12_filter_audit": op12_filter_audit}
#: Every order applied to every document: the filters that it fails, as letters, against the letters before each step.
ORACLE = {"op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x,
             list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
firsts AS (SELECT x, min(doc_id) AS least FROM d GROUP BY x),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
        CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 2 * length(x) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
      FROM d JOIN firsts USING (x) LEFT JOIN l USING (doc_id)),
h AS (SELECT part, fails, count(*) AS n, sum(good) AS g, sum(toxic) AS t FROM f GROUP BY part, fails),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT p.c || q.c || r.c || s.c || t.c AS filter_order FROM c p, c q, c r, c s, c t
      WHERE len(list_distinct([p.c, q.c, r.c, s.c, t.c])) = 5),
steps AS (SELECT filter_order, step::INTEGER AS step, filter_order[step:step] AS k, filter_order[1:step - 1] AS before FROM o, range(1, 6) r(step)),
rows AS (SELECT part, filter_order, step, k,
    sum(CASE WHEN NOT contains(fails, k) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, k) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, k) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = k THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, k) AND translate(fails, before, '') = fails THEN g ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, k) AND translate(fails, before, '') = fails THEN t ELSE 0 END) AS toxic_lost
  FROM h, steps GROUP BY part, filter_order, step, k)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  sum(removed) OVER (PARTITION BY part, k)::BIGINT AS shapley FROM rows"""}
