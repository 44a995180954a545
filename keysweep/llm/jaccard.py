"""Operator 3, an exact n-gram Jaccard join by universe partition.

Two sets of sizes a and b that reach the threshold differ in at most D(a, b) shingles. The universe of hashes is cut into
m segments, m - 1 being the most that two sets of a size band can differ in; so some segment differs in fewer shingles than
the votes it holds. A vote is an exact signature of the segment's subset; a second vote, in the segments set aside for it, is
its one-deletion neighbourhood. All sets are indexed under every signature, but each asks only where it costs least: it
needs D + 1 votes and takes them from the segments with the shortest expected lists (large subsets; empty ones last).
Sets are indexed in the band of their size and ask in their own band and the next smaller one.

Candidates are verified on the whole sets. Within one signature all sets are first verified against one of them, then one set
of each component against the first one; what that joins into one component isn't paired any more, and only sets of different
components that pass an exact lower bound on their difference are compared further. Equal sets count as one throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from keysweep.llm.common import in_parts, materialize, narrow, read, remove, small_batches
from keysweep.llm.components import components
from keysweep.llm.shingles import mix, shingle_set

#: Up to so many keys (16 bytes each) are broadcast to pick documents; beyond, documents are shuffled to them.
BROADCAST_KEYS = 1 << 18
#: Words of the parity map of a set: bits that tell apart sets which differ in about as many shingles.
MAP_WORDS = 32
#: Signature rows of one batch.
_ROWS = 50_000
#: Whole sets, or pairs of them, of one part.
_SETS = 128

PASSIVE, ASKING, DOCUMENT = 0, 1, 2
_SCHEMA = pa.schema([("sig", pa.int64()), ("sid", pa.int64()), ("kind", pa.int8()), ("doc_id", pa.int64()),
                     ("n", pa.int32()), ("map", pa.list_(pa.int64()))])
_SQL = "sig long, sid long, kind byte, doc_id long, n int, map array<long>"


def most_apart(a: int, b: int, percent: int) -> int:
    """The largest symmetric difference with which sets of these sizes still link."""
    return (a + b) * (100 - percent) // (100 + percent)


class Bands:
    """Size bands; a partner's size is in a set's own band or a neighbouring one."""

    def __init__(self, percent: int, most: int = 1 << 31):
        self.percent, self.high, low = percent, [], 1
        while low <= most:
            self.high.append(max(low, low * 100 // percent))
            low = self.high[-1] + 1
        self.high_array = np.array(self.high)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.high_array, n))

    def segments(self, band: int) -> int:
        high = self.high[band]
        return most_apart(high, high * 100 // self.percent, self.percent) + 1


_EDGES: dict[int, np.ndarray] = {}


def _edges(m: int) -> np.ndarray:
    if m not in _EDGES:
        if len(_EDGES) > 200:
            _EDGES.clear()
        _EDGES[m] = (np.arange(1, m, dtype=np.float64) * (2.0 ** 64 / m)).astype(np.uint64)
    return _EDGES[m]


def with_second_votes(m: int) -> int:
    """How many segments carry one-deletion neighbourhoods: all of a few, a small part of many."""
    return m if m <= 4 else max(1, m // 64)


def signatures(s: np.ndarray, sums: np.ndarray, mixed: np.ndarray, band: int, m: int, need: int,
               index: bool) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a sorted set in a band of m segments and which of them ask; ``index``: also those that don't ask."""
    at = np.concatenate(([0], np.searchsorted(s, _edges(m)), [len(s)]))
    sizes = np.diff(at)
    content = sums[at[1:]] - sums[at[:-1]]
    names = mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 32))
    d = with_second_votes(m)
    asks, second = np.zeros(m, dtype=bool), np.zeros(d, dtype=bool)
    if need > 1:  # a difference of 0 is the same set
        k = sizes[:d]
        cost = np.concatenate((np.exp(-np.minimum(sizes, 600.0)),
                               np.where(k >= 2, (k + 1) * np.exp(-np.minimum(k - 1.0, 600.0)), np.inf)))
        chosen = np.argsort(cost, kind="stable")[:need]
        asks[chosen[chosen < m]] = True
        second[chosen[chosen >= m] - m] = True
    keep = np.ones(m, dtype=bool) if index else asks
    sigs, flags = [mix(content[keep] + names[keep])], [asks[keep]]
    for i in np.flatnonzero(sizes[:d] >= 2 if index else second):
        sigs.append(mix(content[i] - mixed[at[i]:at[i + 1]] + names[i]))
        flags.append(np.full(sizes[i], second[i]))
    return np.concatenate(sigs), np.concatenate(flags)


def parity(s: np.ndarray) -> np.ndarray:
    """Which of 2,048 cells hold an odd number of the set's shingles: cells in which two maps differ hold a difference."""
    odd = np.bincount((s & np.uint64(64 * MAP_WORDS - 1)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_id(s: np.ndarray) -> int:
    """The name of a set: a signed 64-bit hash of its size and shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), seed=len(s))).view(np.int64))


def _scan(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row per document (kind 2) and the signatures of its set (each set once per task)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for batch in batches:
            documents, rows, waiting = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingle_set(text, size)
                if not len(s) or doc_id is None:
                    documents.append((len(documents), None, DOCUMENT, doc_id, len(s), None))
                    continue
                sid = set_id(s)
                documents.append((sid, sid, DOCUMENT, doc_id, len(s), parity(s)))
                if sid in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(sid)
                mixed = mix(s)
                sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mixed, dtype=np.uint64)))
                n, own = len(s), bands.of(len(s))
                for band in (own, own - 1):
                    if band < 0 or (m := bands.segments(band)) == 1:
                        continue
                    partner = min(bands.high[band], n * 100 // percent)
                    if band < own and partner * 100 < n * percent:
                        continue
                    need = most_apart(n, partner, percent) + 1
                    sigs, asks = signatures(s, sums, mixed, band, m, need, band == own)
                    rows.append((sigs, asks, sid))
                    waiting += len(sigs)
                if waiting >= _ROWS:
                    yield _signature_batch(rows)
                    rows, waiting = [], 0
            if rows:
                yield _signature_batch(rows)
            if documents:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*documents), _SCHEMA)], schema=_SCHEMA)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, _SQL)


def _signature_batch(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> pa.RecordBatch:
    sigs = np.concatenate([r[0] for r in rows]).view(np.int64)
    sids = np.repeat(np.array([r[2] for r in rows], dtype=np.int64), [len(r[0]) for r in rows])
    kinds = np.concatenate([r[1] for r in rows]).astype(np.int8)
    none = len(sigs)
    return pa.RecordBatch.from_arrays([pa.array(sigs), pa.array(sids), pa.array(kinds), pa.nulls(none, pa.int64()),
                                       pa.nulls(none, pa.int32()), pa.nulls(none, pa.list_(pa.int64()))], schema=_SCHEMA)


def _may_link(a: str, b: str, percent: int):
    """Necessary for a link: sizes within reach, and maps that differ in no more cells than the sets may in shingles. The maps are
    compared in a loop: written out, its code is longer than what the JVM compiles, and runs many times slower."""
    differ = F.aggregate(F.zip_with(f"{a}.map", f"{b}.map", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    n = (F.col(f"{a}.n") + F.col(f"{b}.n")).cast("long")
    return ((F.col(f"{a}.n") * 100 >= F.col(f"{b}.n") * percent) & (F.col(f"{b}.n") * 100 >= F.col(f"{a}.n") * percent)
            & (differ.cast("long") * (100 + percent) <= n * (100 - percent)))


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int, percent: int, paths: list[str]) -> DataFrame:
    """The pairs (a, b) whose whole sets link. ``sets``: sid and the smallest doc_id of each set. Both should be tables, as they
    are counted."""
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct().join(sets.select("sid", "doc_id"), "sid")
    asked = pairs.count()
    wanted = materialize(in_parts(wanted, sets.count() + 2 * asked), "jaccard-wanted", paths)
    wholes = wanted.count()
    if wholes <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, "doc_id").select("sid", F.col("text").cast("binary").alias("text"))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for sid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingle_set(text, size)
                if len(s) and set_id(s) == sid:  # another text may stand under the same doc_id
                    found.append((sid, s.tobytes()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.binary()))],
                                                 ["sid", "s"])

    whole = texts.mapInArrow(shingles, "sid long, s binary").dropDuplicates(["sid"])
    whole = materialize(in_parts(whole, wholes, _SETS), "jaccard-sets", paths)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            chosen = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1)], ["a", "b"])

    both = (pairs.join(whole.select(F.col("sid").alias("a"), F.col("s").alias("x")), "a")
            .join(whole.select(F.col("sid").alias("b"), F.col("s").alias("y")), "b").select("a", "b", "x", "y"))
    return materialize(in_parts(both.mapInArrow(compare, "a long, b long"), asked, _SETS), "jaccard-links", paths)


def join(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The components of all documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    A row per row: doc_id, n_shingles, set_id (equal for equal sets, null without shingles), component_id, the smallest
    doc_id that links reach, and label, which names the component (null without shingles): where a doc_id repeats, two
    components can have the same smallest doc_id.

    Edge cases: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer words than
    ``size`` are one shingle; equal sets are one class, however many there are; rows that repeat a doc_id belong to each of
    their sets' components; rows without a doc_id take no part (component_id null); an empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = narrow(docs, id_col, text_col)
    paths: list[str] = []
    here = Window.partitionBy("sig")
    signed = F.when(F.col("kind") != DOCUMENT, F.col("sid"))
    asking = F.when(F.col("kind") == ASKING, F.col("sid"))
    rows = (_scan(docs, size, percent)
            .withColumn("lo", F.min(signed).over(here)).withColumn("hi", F.max(signed).over(here))
            .withColumn("hub", F.min(asking).over(here))
            .where((F.col("kind") == DOCUMENT) | ((F.col("lo") < F.col("hi")) & F.col("hub").isNotNull())).drop("lo", "hi"))
    kept = materialize(rows, "jaccard-signatures", paths)
    n = kept.count()  # what all tables of ids are made from
    documents = kept.where(F.col("kind") == DOCUMENT).select("doc_id", "sid", "n", "map")
    sets = (documents.where("sid is not null").groupBy("sid")
            .agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("map").alias("map")))
    sets = materialize(in_parts(sets, n), "jaccard-classes", paths)
    lists = kept.where(F.col("kind") != DOCUMENT).groupBy("sig", "sid").agg(F.max("kind").alias("kind"), F.min("hub").alias("hub"))

    # Every set of a list against the list's first.
    stars = lists.where("sid <> hub").select(F.col("hub").alias("a"), F.col("sid").alias("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    stars = _near(stars, sets, percent)
    links = _verified(materialize(in_parts(stars, n), "jaccard-stars", paths), sets, docs, size, percent, paths)
    joined = components(links)

    # What the lists still hold of different components: first one set of each component against the least of them (all have
    # been compared with the hub).
    at = _several(lists, joined, n, paths, "jaccard-open")
    heads = at.where("sid <> hub").groupBy("sig", "label").agg(F.min("sid").alias("sid")).withColumn("first", F.min("sid").over(here))
    heads = _near(heads.where("sid > first").select(F.col("first").alias("a"), F.col("sid").alias("b")).distinct(), sets, percent)
    more = _verified(materialize(in_parts(heads, n), "jaccard-heads", paths), sets, docs, size, percent, paths)
    if not more.isEmpty():
        links = links.union(more)
        joined = components(links)
        at = _several(at.drop("label"), joined, n, paths, "jaccard-left")
    at = at.where("sid <> hub").join(sets.select("sid", "n", "map"), "sid").select("sig", "sid", "kind", "label", "n", "map")
    at = materialize(in_parts(at, n), "jaccard-sides", paths)
    x, y = at.where(F.col("kind") == ASKING).alias("x"), at.alias("y")
    rest = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.label") != F.col("y.label"))
                  & ((F.col("y.kind") != ASKING) | (F.col("x.sid") < F.col("y.sid"))) & _may_link("x", "y", percent))
    rest = rest.select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).distinct()
    rest = materialize(in_parts(rest, n), "jaccard-rest", paths)  # distinct deals them out anew: the join keeps its tasks
    if not rest.isEmpty():
        links = links.union(_verified(rest, sets, docs, size, percent, paths))
        joined = components(links)

    labels = documents.join(joined.select(F.col("node").alias("sid"), "label"), "sid", "left").select(
        "doc_id", "sid", "n", F.coalesce("label", "sid").alias("label"))
    least = labels.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    result = materialize(in_parts(labels.join(least, "label", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("sid").alias("set_id"),
        F.coalesce("component_id", "doc_id").alias("component_id"), "label"), n), "jaccard-components")
    remove(spark, paths)
    return result


def _several(lists: DataFrame, joined: DataFrame, n: int, paths: list[str], name: str) -> DataFrame:
    """The rows of the lists that hold sets of several components, with their label."""
    here = Window.partitionBy("sig")
    at = lists.join(joined.select(F.col("node").alias("sid"), "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    at = at.withColumn("lo", F.min("label").over(here)).withColumn("hi", F.max("label").over(here)).where("lo < hi")
    return materialize(in_parts(at.drop("lo", "hi"), n), name, paths)


def with_set_id(docs: DataFrame, size: int = 5) -> DataFrame:
    """``docs`` with set_id as ``join`` gives it to each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, size) for text in batch.column(batch.num_columns - 1).to_pylist()]
            ids = pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*batch.schema.names[:-1], "set_id"])

    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.withColumn("set_id", text).mapInArrow(run, StructType([*docs.schema, StructField("set_id", LongType())]))


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a, b = sets.select("sid", "n", "map").alias("x"), sets.select("sid", "n", "map").alias("y")
    return (pairs.join(a, F.col("a") == F.col("x.sid")).join(b, (F.col("b") == F.col("y.sid")) & _may_link("x", "y", percent))
            .select("a", "b"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: five words, four fifths."""
    return join(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op3_jaccard": op3_jaccard}
#: All pairs that share a shingle, counted, and the reach of their links.
ORACLE = {"op3_jaccard": r"""
WITH RECURSIVE
d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN sides l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)"""}
