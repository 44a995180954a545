"""Operator 1, removal of long repeated strings by suffix arrays.

Every string of ``length`` bytes picks an anchor inside it: the least hash among its k-byte pieces. Equal strings pick equal
anchors, so all strings that pick one anchor can be sorted apart from the rest.

1. Texts that equal another are counted as one (the others lose all). One scan finds the anchors of the rest and the runs of
   starts that pick each. Anchors that occur once go.
2. The text around the others (a *region*: the bytes of such a run's strings) is dealt out by anchor. Equal regions are
   counted as one with their earliest place; the strings of an anchor with very many regions are dealt out one by one.
   A region is cut to what it can share with another one of its anchor, going out from the anchor to both sides.
3. Each task builds the suffix array and common-prefix values of its regions by external induced sorting, shard by shard.
   Neighbours with a common prefix of ``length`` or more are equal strings: all but the earliest are marked.
4. The marks of a document are joined with its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysweep.llm.common import materialize, read, small_batches
from keysweep.llm.shingles import mix
from keysweep.llm.suffixes import suffix_array

#: Bytes of an anchor.
PIECE = 24
#: Regions of one anchor beyond which its strings are dealt out one by one.
HOT = 5000
#: Bytes of regions from which one suffix array is made (after they are cut); an anchor's regions are never divided.
SHARD = 6 << 20
#: Regions that a task holds to find equal ones before it sends them on.
HELD = 150_000
#: Up to so many keys (8 bytes each) are broadcast to leave out documents; beyond, documents are shuffled to them.
BROADCAST_KEYS = 1 << 18
#: Rows of one output batch.
_ROWS = 20_000
#: A spot in one number: first start (32 bits), the anchor's offset from it, number of starts (14 bits each), two flags.
_OFFSET, _COUNT, _HOT, _KNOWN = 32, 46, 61, 62
_FOURTEEN = (1 << 14) - 1

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 16), np.uint64(base))
        steps[0] = 1
        known = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of starts whose strings pick one anchor: the anchor's hash and the spot."""
    n, piece = len(data), min(PIECE, length)
    width = length - piece + 1
    if n < length:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * _powers(_INVERSE, n), out=sums[1:])
    hashes = mix((sums[piece:] - sums[:-piece]) * _powers(_BASE, n - piece + 1))
    # the upper half of a hash and its place: the least of them is the leftmost of the least
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    starts = n - length + 1
    least = np.minimum(least[:starts], least[width - size:width - size + starts])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    count = np.diff(np.append(begin, starts))
    return hashes[at[begin]], begin | at[begin] - begin << _OFFSET | count << _COUNT


def _find(docs: DataFrame, length: int) -> DataFrame:
    """route, key, spot and anchor (null: the route) of all anchors. Of an anchor that a batch holds more than once only the
    first travels under its name; the others are dealt out evenly, as they are known to repeat."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, keys = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes, spots = anchors(np.frombuffer(text, np.uint8), length)
                if len(hashes):
                    found.append((hashes, spots))
                    keys.append(np.full(len(hashes), key, dtype=np.int64))
            if not found:
                continue
            hashes, spots = (np.concatenate(x) for x in zip(*found))
            key = np.concatenate(keys)
            _, where, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            spots |= (counts[inverse] > 1).astype(np.int64) << _KNOWN
            first = where[inverse] == np.arange(len(hashes))
            route = np.where(first, hashes, mix(key.view(np.uint64) * np.uint64(31) + spots.view(np.uint64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(route.view(np.int64)), pa.array(key), pa.array(spots), pa.array(hashes.view(np.int64), mask=first)],
                ["route", "key", "spot", "anchor"])

    return docs.select("key", "data").mapInArrow(run, "route long, key long, spot long, anchor long")


#: ``last``: of a mark where it ends, of a region its anchor's offset.
_REGION = pa.schema([("route", pa.int64()), ("region", pa.binary()), ("key", pa.int64()), ("first", pa.int64()),
                     ("last", pa.int64())])
_REGION_SQL = "route long, region binary, key long, first long, last long"
_MARK = pa.schema([("key", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
#: (route, region, its anchor's offset) -> (key, first start)
Places = dict[tuple[int, bytes, int], list[tuple[int, int]]]


def _earliest(places: Places) -> Iterator[tuple]:
    """Each region once at its earliest place, and the other places as marks (without a region)."""
    for (route, region, offset), found in places.items():
        best = min(found)
        yield route, region, *best, offset
        for key, first in found:
            if (key, first) != best:
                yield hash((key, first)), None, key, first, first + len(region)


def _regions(docs: DataFrame, length: int) -> DataFrame:
    """From documents with their repeated anchors: regions, and marks of those that the same task holds earlier."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: Places = {}
        for batch in batches:
            data_of = batch.column(1).field("data").to_pylist()
            bounds, flat = batch.column(2).offsets.to_pylist(), batch.column(2).values
            spots, names = flat.field("spot").to_pylist(), flat.field("anchor").to_pylist()
            for row, (key, data) in enumerate(zip(batch.column(0).to_pylist(), data_of)):
                for k in range(bounds[row], bounds[row + 1]):
                    spot, anchor = spots[k], names[k]
                    first, n = spot & 0xFFFFFFFF, spot >> _COUNT & _FOURTEEN
                    offset = spot >> _OFFSET & _FOURTEEN
                    if spot >> _HOT & 1:
                        for start in range(first, first + n):
                            string = data[start:start + length]
                            route = xxhash.xxh64_intdigest(string) - (1 << 63)
                            places.setdefault((route, string, offset + first - start), []).append((key, start))
                    else:
                        places.setdefault((anchor, data[first:first + n + length - 1], offset), []).append((key, first))
                if len(places) >= HELD:
                    yield from _batches(_earliest(places), _REGION)
                    places = {}
        yield from _batches(_earliest(places), _REGION)

    return docs.mapInArrow(run, _REGION_SQL)


def _reach(sides: list[bytes]) -> list[int]:
    """For each string the longest prefix that it shares with another one."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    out = [0] * len(sides)
    for i, j in zip(order, order[1:]):
        a, b = sides[i], sides[j]
        low, high = 0, min(len(a), len(b))
        while low < high:
            middle = (low + high + 1) // 2
            if a[:middle] == b[:middle]:
                low = middle
            else:
                high = middle - 1
        out[i], out[j] = max(out[i], low), max(out[j], low)
    return out


def _trimmed(group: list[tuple[bytes, int, int, int]], length: int) -> Iterator[tuple[bytes, int, int]]:
    """The parts of one anchor's distinct regions (region, key, first, offset) that may stand in another one too: what a string
    shares with an equal one reaches from the anchor no further than these do to either side."""
    left = _reach([region[:offset][::-1] for region, _, _, offset in group])
    right = _reach([region[offset:] for region, _, _, offset in group])
    for (region, key, first, offset), a, b in zip(group, left, right):
        if a + b >= length:
            yield region[offset - a:offset + b], key, first + offset - a


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part: list[tuple] = []
    for row in rows:
        part.append(row)
        if len(part) >= _ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def sort_shard(regions: list[bytes], keys: np.ndarray, firsts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Marks (key, first, last) of all strings of ``length`` bytes in the regions that also start at an earlier place, by the
    suffix array of the regions one after the other."""
    sizes = np.array([len(r) for r in regions])
    text = np.append(np.frombuffer(b"".join(r + b"\0" for r in regions), np.uint8).astype(np.int16) + np.int16(2), np.int16(0))
    ends = np.cumsum(sizes + 1)
    text[ends - 1] = 1  # between two regions
    array, shared = suffix_array(text, max(length, 1 << 15))  # only whether prefixes reach the length is asked
    del text
    group = np.cumsum(shared < length, dtype=array.dtype)
    del shared
    counts = np.bincount(group)
    keep = counts[group] > 1
    array, group = array[keep], group[keep]
    region = np.searchsorted(ends, array, side="right")
    inside = array - (ends - sizes - 1)[np.minimum(region, len(sizes) - 1)]
    whole = (region < len(sizes)) & (inside + length <= sizes[np.minimum(region, len(sizes) - 1)])
    array, group, region, inside = array[whole], group[whole], region[whole], inside[whole]
    place = firsts[region] + inside
    order = np.lexsort((place, keys[region], group))
    later = np.concatenate(([False], group[order][1:] == group[order][:-1])) if len(order) else np.zeros(0, dtype=bool)
    marked = np.sort(array[order][later])
    if not len(marked):
        return (np.zeros(0, dtype=np.int64),) * 3
    begin = np.concatenate(([True], marked[1:] != marked[:-1] + 1))  # a separator lies between regions
    first, last = marked[begin], marked[np.append(begin[1:], True)]
    region = np.searchsorted(ends, first, side="right")
    shift = firsts[region] - (ends - sizes - 1)[region]
    return keys[region], first + shift, last + shift + length


def _sorted_shards(regions: DataFrame, length: int) -> DataFrame:
    """Marks from regions that stand together by route."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: Places = {}
        last_route, held = None, 0

        def sort() -> Iterator[pa.RecordBatch]:
            marks, groups = [], {}
            for route, region, key, first, last in _earliest(places):
                if region is None:
                    marks.append((key, first, last))
                else:
                    groups.setdefault(route, []).append((region, key, first, last))
            yield from _batches(iter(marks), _MARK)
            text = [x for group in groups.values() if len(group) > 1 for x in _trimmed(group, length)]
            if text:
                found = sort_shard([x[0] for x in text], np.array([x[1] for x in text]), np.array([x[2] for x in text]), length)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], schema=_MARK)

        for batch in batches:
            direct = batch.filter(batch.column(1).is_null())
            if len(direct):
                yield pa.RecordBatch.from_arrays([direct.column(k) for k in (2, 3, 4)], schema=_MARK)
            there = batch.filter(batch.column(1).is_valid())
            for route, region, key, first, offset in zip(*(there.column(k).to_pylist() for k in range(5))):
                if held >= SHARD and route != last_route:
                    yield from sort()
                    places, held = {}, 0
                last_route = route
                found = places.setdefault((route, region, offset), [])
                held += 0 if found else len(region)
                found.append((key, first))
        if places:
            yield from sort()

    return (regions.repartition("route").sortWithinPartitions("route")
            .mapInArrow(run, "key long, first long, last long"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """Adds ``key``, which orders documents: the doc_id, or where ids repeat or are missing the place of (doc_id, text) in
    their order. Also whether keys are unique."""
    total, ids = docs.agg(F.count("*"), F.count("doc_id")).first()
    if total == ids and docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.withColumn("key", F.col("doc_id")), True
    digest = F.sha2("data", 256)
    ordered = docs.select("doc_id", digest.alias("digest")).distinct().orderBy(F.col("doc_id").asc_nulls_first(), "digest")
    numbered = docs.sparkSession.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])),
                                                 "id long, digest string, key long")
    numbered = materialize(numbered, "suffix-keys")
    return docs.withColumn("digest", digest).join(numbered.withColumnRenamed("digest", "digest_"), F.col("doc_id").eqNullSafe(F.col("id"))
                                                  & (F.col("digest") == F.col("digest_"))).drop("id", "digest", "digest_"), False


def dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text",
          keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """Removes from each document every byte that a string of ``length`` bytes covers which also starts earlier, in a document
    with a smaller doc_id or further ahead in the same one. Strings are judged on the input.

    A row per row: doc_id, kept (binary: the bytes that remain, which may cut a character), n_bytes, n_removed and spans
    (array of removed [first, last) runs, none touching another). ``keep`` names further columns to carry along; ``as_text``
    gives text in place of kept, without the bytes of characters that were cut.

    Edge cases: a null or empty text, or one shorter than ``length``, loses nothing; matches never cross documents; where rows
    repeat a doc_id or have none, documents are ordered by doc_id (null first) and then by a hash of their text, and rows
    equal in both are one document (each gets its result); an empty table gives no rows; other columns are ignored.
    """
    if not 1 <= length <= _FOURTEEN:
        raise ValueError(f"length must lie in 1..{_FOURTEEN}")
    small_batches(docs.sparkSession)
    carried = [F.col(f"`{c}`").alias(f"__keep_{i}") for i, c in enumerate(keep)]
    table = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("data"), *carried)
    names, result = [f"__keep_{i}" for i in range(len(keep))], "text" if as_text else "kept"
    extra = "".join(f", `{n}` {table.schema[n].dataType.simpleString()}" for n in names)
    table, unique = _keyed(table)
    # Both joins of the texts below take whole rows, so that they read one exchange.
    table = table.where("key is not null").select("key", F.struct("doc_id", "data", *names).alias("row"))
    rows = table if unique else table.dropDuplicates(["key"])
    once = rows.select("key", F.col("row.data").alias("data"))
    copies = _copies(once, length)
    few = copies.count() <= BROADCAST_KEYS
    rest = once.join(F.broadcast(copies) if few else copies, "key", "left_anti")

    here = Window.partitionBy("route")
    known = F.col("spot").bitwiseAND(F.lit(1 << _KNOWN)) != 0
    spots = (_find(rest, length).withColumn("met", F.count("*").over(here))
             .where(known | ((F.col("met") > 1) & F.col("anchor").isNull()))
             .select(F.coalesce("anchor", "route").alias("anchor"), "key", "spot"))
    spots = materialize(spots, "suffix-anchors")
    hot = materialize(spots.groupBy("anchor").count().where(F.col("count") > HOT)
                      .select("anchor", F.lit(1 << _HOT).alias("hot")), "suffix-hot")
    if hot.count() <= BROADCAST_KEYS:  # then no join by anchor brings a hot one's spots together
        hot = F.broadcast(hot)
    spots = spots.join(hot, "anchor", "left").groupBy("key").agg(F.collect_list(F.struct(
        F.col("spot").bitwiseOR(F.coalesce("hot", F.lit(0).cast("long"))).alias("spot"), "anchor")).alias("spots"))

    marks = _sorted_shards(_regions(rows.join(spots, "key").select("key", "row", "spots"), length), length)
    marks = marks.union(copies.select("key", F.lit(0).cast("long").alias("first"), F.col("n").alias("last")))
    marks = marks.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("marks"))
    marked = table.join(marks, "key", "left").select("row", "marks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, spans = [], [], []
            row = batch.column(0)
            texts = row.field("data").to_pylist()
            for data, runs in zip(texts, batch.column(1).to_pylist()):
                merged: list[list[int]] = []
                for first, last in sorted((r["first"], r["last"]) for r in runs or ()):
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], last)
                    else:
                        merged.append([first, last])
                at, parts = 0, []
                for first, last in merged:
                    parts.append(data[at:first])
                    at = last
                kept.append(b"".join([*parts, data[at:]]))
                removed.append(sum(b - a for a, b in merged))
                spans.append(merged)
            yield pa.RecordBatch.from_arrays(
                [row.field("doc_id"), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text
                 else pa.array(kept, pa.binary()), pa.array([len(x) for x in texts], pa.int64()),
                 pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                 *[row.field(n) for n in names]],
                ["doc_id", result, "n_bytes", "n_removed", "spans", *names])

    out = marked.mapInArrow(
        cut, f"doc_id long, {result} {'string' if as_text else 'binary'}, n_bytes long, n_removed long, spans array<array<long>>" + extra)
    return out.withColumnsRenamed(dict(zip(names, keep)))


def _copies(once: DataFrame, length: int) -> DataFrame:
    """key and size of the texts that equal one with a smaller key and are long enough to be removed."""
    named = once.select("key", F.sha2("data", 256).alias("h"), F.octet_length("data").cast("long").alias("n")).where(F.col("n") >= length)
    least = named.groupBy("h").agg(F.min("key").alias("least"), F.count("*").alias("c")).where("c > 1").drop("c")
    return materialize(named.join(least, "h").where("key <> least").select("key", "n"), "suffix-copies")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: strings of 100 bytes."""
    return dedup(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
#: Every string of 100 bytes (by its MD5), and whether it is the first of its kind.
ORACLE = {"op1_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, k, md5_number(b[k + 1 : k + 100]) AS s
      FROM (SELECT doc_id, b, unnest(range(0, greatest(0, octet_length(b) - 99))) AS k FROM d)),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS n FROM w) WHERE n > 1),
o AS (SELECT doc_id, k, k > coalesce(lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 100, -1) AS starts FROM r),
i AS (SELECT doc_id, k, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM o),
gone AS (SELECT doc_id, run, min(k) AS a, max(k) + 100 AS z FROM i GROUP BY doc_id, run),
parts AS (SELECT doc_id, coalesce(lag(z) OVER one, 0) AS a, a AS z, z - a AS n FROM gone WINDOW one AS (PARTITION BY doc_id ORDER BY a)),
ends AS (SELECT doc_id, max(z) AS a, count(*) AS n_spans, sum(z - a) AS n_removed FROM gone GROUP BY doc_id),
pieces AS (SELECT doc_id, a, hex(b[a + 1 : z]) AS x FROM parts JOIN d USING (doc_id)
           UNION ALL SELECT doc_id, a, hex(b[a + 1 : octet_length(b)]) FROM ends JOIN d USING (doc_id)),
kept AS (SELECT doc_id, string_agg(x, '' ORDER BY a) AS x FROM pieces GROUP BY doc_id)
SELECT d.doc_id, octet_length(d.b)::BIGINT AS n_bytes, coalesce(e.n_removed, 0)::BIGINT AS n_removed,
       coalesce(e.n_spans, 0)::BIGINT AS n_spans, sha256(CASE WHEN e.doc_id IS NULL THEN d.b ELSE unhex(k.x) END) AS kept_sha256
FROM d LEFT JOIN ends e USING (doc_id) LEFT JOIN kept k USING (doc_id)"""}
