"""Operator 11, near duplicates by circulant MinHash.

Two permutations make all coordinates of a signature. The first sends a shingle to a place on a circle of ``CIRCLE`` places,
the second is a shuffled circle of values; coordinate k of a set is the least value that its places have on the circle shifted
by k. A shingle's values for all coordinates are therefore neighbours on the circle, and a signature is the minimum over one
slice per shingle: no hash is computed per coordinate.

``BANDS`` bands of ``ROWS`` coordinates make a set's buckets: two sets of a similarity of 0.85 share none of them with a
probability of (1 - 0.85 ** 8) ** 64, about 1.5e-9. Candidates are verified on their whole sets, in three steps that keep a
group of near copies from being paired with itself: in the first few bands each set against its bucket's first set; then, in
buckets that still hold several components, one set of each component against the first one; then what remains, sets of
different components of a bucket that two lower bounds on their difference let through. Equal sets count as one throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysweep.llm.common import broadcast_if_few, materialize, narrow, read, remove, small_batches
from keysweep.llm.components import components
from keysweep.llm.shingles import mix, shingle_set

CIRCLE, BANDS, ROWS = 1 << 20, 64, 8
#: Bands of the first step: enough for most members of a group of near copies to meet one of its first sets.
FIRST_BANDS = 4
#: 64-bit words of the parity map: 2,048 cells, of which as many differ between two sets as these do in shingles, at most.
MAP_WORDS = 32
#: Shingles whose slices of the circle are in memory at once.
CHUNK = 2048
#: Up to so many documents (24 bytes each) are picked by broadcast; beyond, documents are shuffled to the sets asked for.
BROADCAST_KEYS = 1 << 18
_SCAN = "doc_id long, sid binary, n int, map array<long>, buckets array<long>"


@cache
def _circle() -> np.ndarray:
    """The second permutation, with its beginning repeated behind its end."""
    values = np.random.Generator(np.random.PCG64(20210907)).permutation(CIRCLE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((values, values[:BANDS * ROWS - 1])), BANDS * ROWS)


def signature(s: np.ndarray) -> np.ndarray:
    """All coordinates of a set of shingle hashes that isn't empty."""
    places = (mix(s ^ np.uint64(0x632BE59BD9B4E019)) & np.uint64(CIRCLE - 1)).astype(np.int64)
    least = None
    for k in range(0, len(places), CHUNK):
        part = _circle()[places[k:k + CHUNK]].min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least


def buckets(least: np.ndarray) -> np.ndarray:
    """A signed 64-bit name for each band of a signature."""
    rows = least.astype(np.uint64).reshape(BANDS, ROWS)
    total = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
    return total.view(np.int64)


def parity(s: np.ndarray) -> np.ndarray:
    """Which cells hold an odd number of the set's shingles."""
    odd = np.bincount((s & np.uint64(64 * MAP_WORDS - 1)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_name(s: np.ndarray) -> bytes:
    """128 bits, so that sets are told apart by their names however many there are."""
    return xxhash.xxh3_128_digest(s.tobytes())


def _scan(docs: DataFrame, size: int) -> DataFrame:
    """One row per document; the buckets of a set come with the first document of each task that has it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingle_set(text, size)
                if not len(s) or doc_id is None:
                    rows.append((doc_id, None, len(s), None, None))
                    continue
                name = set_name(s)
                new = name not in seen
                if new:
                    if len(seen) >= 200_000:
                        seen.clear()  # a set's buckets may then come twice
                    seen.add(name)
                rows.append((doc_id, name, len(s), parity(s), buckets(signature(s)) if new else None))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int32()),
                 pa.array(columns[3], pa.list_(pa.int64())), pa.array(columns[4], pa.list_(pa.int64()))],
                ["doc_id", "sid", "n", "map", "buckets"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, _SCAN)


def _may_link(a: str, b: str, percent: int) -> Column:
    """Necessary for a link: sizes within reach, and maps that differ in no more cells than the sets may in shingles."""
    m, n = F.col(f"{a}.n").cast("long"), F.col(f"{b}.n").cast("long")
    apart = sum((F.bit_count(F.get(f"{a}.map", F.lit(j)).bitwiseXOR(F.get(f"{b}.map", F.lit(j)))) for j in range(MAP_WORDS)), F.lit(0))
    return ((m * 100 >= n * percent) & (n * 100 >= m * percent)
            & (apart <= F.floor((m + n) * (100 - percent) / F.lit(100 + percent))))


class _Links:
    """The links found so far, as tables in the shared folder."""

    def __init__(self, docs: DataFrame, sets: DataFrame, size: int, percent: int, paths: list[str]):
        self.docs, self.sets, self.size, self.percent, self.paths = docs, sets, size, percent, paths
        self.found: DataFrame | None = None

    def add(self, pairs: DataFrame, checked: bool = False) -> bool:
        """Verifies pairs (a, b) of sets on all their shingles; whether any links. ``checked``: ``_may_link`` holds."""
        sets, paths, size, percent = self.sets, self.paths, self.size, self.percent
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if not checked:
            x, y = sets.alias("x"), sets.alias("y")
            pairs = (pairs.join(x, F.col("a") == F.col("x.sid")).join(y, (F.col("b") == F.col("y.sid")) & _may_link("x", "y", percent))
                     .select("a", "b"))
        pairs = materialize(pairs, "circulant-pairs", paths)
        if pairs.isEmpty():
            return False
        wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct().join(sets.select("sid", "doc_id"), "sid")
        wanted = broadcast_if_few(materialize(wanted, "circulant-wanted", paths), BROADCAST_KEYS)
        texts = self.docs.join(wanted, "doc_id").select("sid", F.col("text").cast("binary").alias("text"))

        def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(sid, shingle_set(text, size)) for sid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                rows = [(sid, s.tobytes()) for sid, s in rows if len(s) and set_name(s) == sid]  # a doc_id may have several texts
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in range(2)], ["sid", "s"])

        whole = materialize(texts.mapInArrow(shingles, "sid binary, s binary").dropDuplicates(["sid"]), "circulant-sets", paths)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                chosen = batch.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1)], ["a", "b"])

        both = (pairs.join(whole.select(F.col("sid").alias("b"), F.col("s").alias("y")), "b")
                .join(whole.select(F.col("sid").alias("a"), F.col("s").alias("x")), "a").select("a", "b", "x", "y"))
        links = materialize(both.mapInArrow(compare, "a binary, b binary"), "circulant-links", paths)
        if links.isEmpty():
            return False
        self.found = links if self.found is None else self.found.union(links)
        return True

    def labels(self) -> DataFrame:
        """sid and label of every set with a link."""
        if self.found is None:
            return self.sets.select("sid", F.col("sid").alias("label")).limit(0)
        found = components(self.found).select(F.col("node").alias("sid"), "label")
        return materialize(found, "circulant-labels", self.paths)


def _open(rows: DataFrame, labels: DataFrame, paths: list[str], name: str) -> DataFrame:
    """The rows (bucket, sid) of buckets that hold several components, with label."""
    here = Window.partitionBy("bucket")
    rows = rows.drop("label").join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    rows = rows.withColumn("low", F.min("label").over(here)).withColumn("high", F.max("label").over(here)).where("low < high")
    return materialize(rows.select("bucket", "sid", "label"), name, paths)


def near_duplicates(docs: DataFrame, size: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The components of all documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    A row per row: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included), kept (whether that
    is its own) and label, which names the component (null without shingles).

    Every link is confirmed on the whole sets; one between sets of exactly ``percent`` = 85 is overlooked with a probability of
    1.5e-9, and less above. Lower thresholds than 85 overlook more.

    Edge cases: a null or empty text, or one without words, has an empty set, is linked with nothing and kept; fewer words than
    ``size`` are one shingle; equal sets are one class, however many there are; rows that repeat a doc_id belong to each of
    their sets' components, and all rows of a component's smallest doc_id are kept; rows without a doc_id take no part
    (component_id null, kept); an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = narrow(docs, id_col, text_col)
    paths: list[str] = []
    scanned = materialize(_scan(docs, size), "circulant-scan", paths)
    sets = (scanned.where("sid is not null").groupBy("sid")
            .agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("map").alias("map")))
    sets = materialize(sets, "circulant-classes", paths)

    # Buckets of several sets; a bucket's first set is its least.
    here = Window.partitionBy("bucket")
    rows = scanned.where("buckets is not null").select("sid", F.posexplode("buckets").alias("band", "bucket"))
    rows = (rows.withColumn("first", F.min("sid").over(here)).withColumn("last", F.max("sid").over(here)).where("first < last")
            .groupBy("bucket", "sid").agg(F.min("band").alias("band"), F.min("first").alias("first")))
    rows = materialize(rows, "circulant-buckets", paths)

    links = _Links(docs, sets, size, percent, paths)
    links.add(rows.where((F.col("band") < FIRST_BANDS) & (F.col("sid") > F.col("first"))).select(
        F.col("first").alias("a"), F.col("sid").alias("b")))
    labels = links.labels()
    rows = _open(rows.select("bucket", "sid"), labels, paths, "circulant-open")

    first_of = Window.partitionBy("bucket")
    heads = rows.groupBy("bucket", "label").agg(F.min("sid").alias("sid")).withColumn("first", F.min("sid").over(first_of))
    if links.add(heads.where("sid > first").select(F.col("first").alias("a"), F.col("sid").alias("b"))):
        labels = links.labels()
        rows = _open(rows, labels, paths, "circulant-rest")

    at = rows.join(sets.select("sid", "n", "map"), "sid")
    x, y = at.alias("x"), at.alias("y")
    rest = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.label") < F.col("y.label")) & _may_link("x", "y", percent))
    if links.add(rest.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")), checked=True):
        labels = links.labels()

    named = scanned.select("doc_id", "sid", "n").join(labels, "sid", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("label", "sid").alias("label"))
    least = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    result = named.join(least, "label", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "label")
    result = materialize(result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "circulant-components")
    remove(spark, paths)
    return result


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: three words, 85 percent."""
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op11_minhash_dedup": op11_minhash_dedup}
#: Pairs that share a shingle, counted, and the least id that their links reach. A pair that links shares one of the first
#: sixth of either's shingles in any fixed order, so only these are joined to find pairs.
ORACLE = {"op11_minhash_dedup": r"""
WITH RECURSIVE
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
ranked AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY md5(g), g) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM s),
few AS (SELECT doc_id, g FROM ranked WHERE k <= n - ((85 * n + 99) // 100) + 1),
near AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM few a JOIN few b ON a.g = b.g AND a.doc_id < b.doc_id),
pairs AS (SELECT x, y, count(*) AS c FROM near JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y AND a.g = b.g GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN sides l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)"""}
