"""Operator 4, approximate nearest neighbours with an adaptive dimension scan.

Vectors are scaled to length one, rotated by a random orthogonal matrix and dealt to the nearest of a fixed number of
centroids. A query probes its nearest lists. Inside a list, candidates are read in column blocks: after each block the
partial distance, scaled up to all dimensions, is tested against the query's present k-th distance, and candidates
that fail the hypothesis test leave the scan. Survivors get the exact cosine of the original vectors.

Lists are dealt out in chunks of bounded size, and so are the queries that probe a list, so one hot list (a vector
with many copies) is many tasks' work; every vector is indexed and no list is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysweep.llm.common import read

#: Candidates, and queries, that meet in one task.
CHUNK = 2048
#: Columns read between two tests, and the test's tolerance (a larger one abandons later and misses less).
STEP, TOLERANCE = 16, 2.1
#: About how many vectors k-means is fitted to (twice as many at most): the bound of what the driver sees.
SAMPLE = 8192
LISTS = 64

_FOUND = "query_id long, vec_id long, score double"


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors; fewer if there are fewer distinct points."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = np.argmax(points @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision, the same for equal rows wherever they stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def scan(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, turn: np.ndarray,
         k: int) -> list[tuple[int, int, float]]:
    """The k nearest of ``points`` for every query by the adaptive dimension scan."""
    unit = lambda x: (x / np.sqrt((x * x).sum(axis=1, keepdims=True))) @ turn
    rq, rp = unit(queries), unit(points)
    dims = rp.shape[1]
    found = []
    for q, qid, original in zip(rq, query_ids, queries):
        alive = np.flatnonzero(ids != qid)
        # the first candidates set the bar
        head, alive = alive[:max(2 * k, 32)], alive[max(2 * k, 32):]
        full = ((rp[head] - q) ** 2).sum(axis=1)
        bar = np.sort(full)[k - 1] if len(full) >= k else np.inf
        partial = np.zeros(len(alive))
        for d in range(0, dims, STEP):
            if not len(alive):
                break
            partial += ((rp[alive, d:d + STEP] - q[d:d + STEP]) ** 2).sum(axis=1)
            seen = min(d + STEP, dims)
            # at all dimensions the distance is known: only rounding is allowed for
            slack = (1 + TOLERANCE / np.sqrt(seen)) ** 2 if seen < dims else 1.0
            stay = partial * (dims / seen) <= bar * slack + 1e-9
            alive, partial = alive[stay], partial[stay]
        best = np.concatenate([head, alive])
        if not len(best):
            continue
        exact = cosine(np.broadcast_to(original, (len(best), dims)), points[best])
        order = np.lexsort((ids[best], -exact))[:k]
        found += [(int(qid), int(ids[best[j]]), float(exact[j])) for j in order]
    return found


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and v (array of double) of the rows that can take part: an id, a vector that is neither null, empty nor
    zero, and no null or non-finite component."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return rows.where(~F.exists("v", bad)).where(F.exists("v", lambda x: x != 0))


def search(table: DataFrame, is_query: str, k: int = 5, probes: int = 40, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """For each row that satisfies the SQL predicate ``is_query`` over vec_id, its ``k`` nearest other rows by cosine.

    query_id, rank (from 1), vec_id, score; nearest first, ties to the smaller vec_id.

    Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those of
    another length than most (ties: the longer); equal vectors are all candidates; of rows with one id each is a
    candidate, but an id is returned once and never to itself; with fewer candidates than k all come back; an empty
    table gives no rows; other columns are ignored.
    """
    spark = table.sparkSession
    rows = usable(table, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dims = int(sizes[0][0])
    rows = rows.where(F.size("v") == dims)
    # a bounded fit: a hash of the id deals out about SAMPLE vectors
    share = int((1 << 40) * min(1.0, SAMPLE / sizes[0][1]))
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < share).limit(2 * SAMPLE).select("vec_id", "v").toPandas()
    if not len(sample):
        sample = rows.limit(SAMPLE).select("vec_id", "v").toPandas()
    sample = sample.sort_values("vec_id", kind="stable")["v"]
    points = np.vstack(sample.to_numpy()).astype(float)
    turn = rotation(dims)
    centres = kmeans(points / np.linalg.norm(points, axis=1, keepdims=True), LISTS)
    n_lists = len(centres)
    probes = min(probes, n_lists)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            v = np.vstack([batch.column(1).flatten().to_numpy()]).reshape(len(batch), dims)
            near = (v / np.sqrt((v * v).sum(axis=1, keepdims=True))) @ centres.T
            first = np.argsort(-near, axis=1, kind="stable")[:, :probes].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * probes),
                                             pa.array(first.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["vec_id", "v", "lists"])

    placed = rows.mapInArrow(assign, "vec_id long, v array<double>, lists array<int>")
    points_at = placed.select("vec_id", "v", F.get("lists", F.lit(0)).alias("list"))
    asked = placed.where(F.expr(is_query)).select("vec_id", "v", F.explode("lists").alias("list"))

    def parts(df: DataFrame) -> np.ndarray:  # how many chunks each list needs; as many numbers as there are lists
        counts = dict(df.groupBy("list").count().collect())
        return np.array([-(-counts.get(i, 0) // CHUNK) or 1 for i in range(n_lists)])

    p_parts, q_parts = parts(points_at), parts(asked)
    of = lambda n: F.get(F.array(*[F.lit(int(x)) for x in n]), F.col("list"))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), of(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), of(n) - 1))
    points_at = points_at.select("vec_id", "v", "list", own(p_parts).alias("p"), every(q_parts).alias("q"))
    asked = asked.select("vec_id", "v", "list", own(q_parts).alias("q"), every(p_parts).alias("p"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=["query_id", "vec_id", "score"])
        right = right.sort_values("vec_id")
        found = scan(np.vstack(left["v"].to_numpy()), left["vec_id"].to_numpy(), np.vstack(right["v"].to_numpy()),
                     right["vec_id"].to_numpy(), turn, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    found = (asked.groupBy("list", "p", "q").cogroup(points_at.groupBy("list", "p", "q"))
             .applyInPandas(meet, _FOUND))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # rows of one id can stand in several chunks; the same id is returned once, with its best score
    top = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return top.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every vec_id divisible by 50 against all other rows."""
    return search(read(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


QUERIES = {"op4_ann": op4_ann}
ORACLE: dict[str, str] = {}
