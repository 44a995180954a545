"""Operator 13, a Merkle manifest of a table by butterfly exchange.

Rows are leaves. The leaves of a tree (here: of a language) are sorted over the cluster and cut into aligned blocks, the
butterfly's partitions, each of which hashes its own subtree. Then blocks swap subtree roots round by round: in round r a
block meets the blocks whose number differs from its own in the r-th digit only, to the base of the fanout, and each of them
hashes their common ancestor. After as many rounds as the number of blocks has digits every block holds the tree's root and
all that a proof needs above the block, and no pass goes down again. Where the last run of a round is not full, its blocks
also stand in for the digits that it lacks. The roots of the trees are the leaves of one more tree, built the same way.

A block is at most ``FANOUT ** BLOCK_LEVELS`` leaves and a group of a round at most ``FANOUT`` rows, whatever the sizes of the
trees; every round is written to the shared folder, so a lost executor costs one round's part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysweep.llm.common import broadcast_if_few, flush, materialize, read, remove, small_batches

FANOUT = 8
#: Levels of a block's own subtree: 4,096 leaves.
BLOCK_LEVELS = 4
#: Rows of at most about 8 KB (a way up) that are broadcast; beyond, both sides are shuffled.
BROADCAST_WAYS = 2048
#: Blocks (of some hundred KB) in one Arrow batch.
BATCH_BLOCKS = 16
#: For each level: the place in its run, and the run's digests.
WAYS = "array<struct<at:int,run:array<string>>>"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def small_letters(text: Column) -> Column:
    """A-Z, and no other letters, in lower case."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))


def _leaves(docs: DataFrame) -> DataFrame:
    """tree and item: doc_id, leaf and, for rows that are tampered with, the leaf that they then have."""
    text = F.col("text").cast("string")
    key = F.col("doc_id").cast("long")
    above = [_field(key), *[_field(F.col(c)) for c in ("source", "lang", "n_chars")]]
    leaf = F.sha2(F.concat(*above, _field(text)).cast("binary"), 256)
    tampered = F.when(F.crc32(key.cast("string").cast("binary")) % 3 == 0,
                      F.sha2(F.concat(*above, _field(small_letters(text))).cast("binary"), 256))
    # null sorts before every language, the empty one included
    tree = F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0"))
    return docs.select(tree.alias("tree"), F.struct(key.alias("doc_id"), leaf.alias("leaf"), tampered.alias("tampered")).alias("item"))


def _placed(nodes: DataFrame, paths: list[str]) -> DataFrame:
    """``nodes`` (tree, item) with pos, the place among its tree's items, and size, how many these are."""
    nodes = materialize(nodes, "merkle-nodes", paths)  # the range partitioner reads its input twice
    rows = (nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("tree", "item", "_tie")
            .sortWithinPartitions("tree", "item").select("tree", "item", F.monotonically_increasing_id().alias("row")))
    rows = materialize(rows, "merkle-sorted", paths).withColumn("part", F.shiftright("row", 33))
    runs = rows.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("before"),
                       F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    runs = materialize(runs, "merkle-runs", paths)
    return rows.join(broadcast_if_few(runs), ["tree", "part"]).select(
        "tree", "item", (F.col("row") - F.col("first") + F.col("before")).alias("pos"), "size")


def _levels(leaves: list[str], size: int, levels: int) -> list[list[str]]:
    """The nodes of a block of a tree of ``size`` leaves, from its leaves to its root."""
    out = [leaves]
    while size > 1 and len(out) <= levels:
        now = out[-1]
        out.append([digest("".join(now[k:k + FANOUT])) for k in range(0, len(now), FANOUT)])
        size = -(-size // FANOUT)
    return out


def _way(levels: list[list[str]], k: int) -> list[tuple[int, list[str]]]:
    """From the k-th leaf to the block's root: place and run on each level."""
    out = []
    for now in levels[:-1]:
        at = k % FANOUT
        out.append((at, now[k - at:k - at + FANOUT]))
        k //= FANOUT
    return out


def _blocks(nodes: DataFrame, levels: int, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Two tables: tree, block, size and the block's items in order; and of each block tree, block, blocks (how many the
    tree has) and root."""
    many = FANOUT ** levels
    whole = (_placed(nodes, paths).groupBy("tree", F.expr(f"pos div {many}").alias("block"))
             .agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("pos", "item"))).alias("nodes"))
             .select("tree", "block", "size", F.col("nodes.item").alias("items")))
    whole = materialize(whole, "merkle-blocks", paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, block, size = (batch.column(k).to_pylist() for k in range(3))
            roots = [_levels(leaves, n, levels)[-1][0] for leaves, n in zip(batch.column(3).to_pylist(), size)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(tree), pa.array(block), pa.array([-(-n // many) for n in size], pa.int64()), pa.array(roots)],
                ["tree", "block", "blocks", "root"])

    small_batches(nodes.sparkSession)
    nodes.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_BLOCKS))
    roots = whole.select("tree", "block", "size", F.col("items.leaf")).mapInArrow(run, "tree string, block long, blocks long, root string")
    return whole, materialize(roots, "merkle-roots", paths)


def _exchange(roots: DataFrame, paths: list[str]) -> DataFrame:
    """Every block with the root of its tree and ways, its place and run on each level above it."""
    state = roots.withColumn("ways", F.array().cast(WAYS))
    most = roots.agg(F.max("blocks")).first()[0] or 0
    width = 1  # blocks below each of the nodes that this round brings together
    while width < most:
        node = F.expr(f"block div {width}")
        here = state.where(F.col("blocks") > width).select(
            "*", (F.col("block") % width).alias("low"), (node % FANOUT).cast("int").alias("at"),
            F.floor(node / FANOUT).alias("group"), F.lit(False).alias("stands_in"))
        last = F.expr(f"(blocks - 1) div {width}")
        there = F.col("blocks") - last * width
        lacking = here.where((node == last) & (last % FANOUT > 0) & (F.col("low") + there < width)).withColumn(
            "low", F.explode(F.sequence(F.col("low") + there, F.lit(width - 1).cast("long"), there))).withColumn("stands_in", F.lit(True))
        met = here.union(lacking).withColumn("run", F.sort_array(F.collect_list(F.struct("at", "root")).over(
            Window.partitionBy("tree", "group", "low")))["root"])
        met = met.where(~F.col("stands_in")).select(
            "tree", "block", "blocks", F.sha2(F.array_join("run", "").cast("binary"), 256).alias("root"),
            F.concat("ways", F.array(F.struct("at", "run"))).cast(WAYS).alias("ways"))
        state = materialize(met.union(state.where(F.col("blocks") <= width)), f"merkle-round-{width}", paths)
        width *= FANOUT
    return state


def _climb(start: str, ways: list[tuple[int, list[str]]]) -> str:
    now = start
    for at, run in ways:
        now = digest("".join([*run[:at], now, *run[at + 1:]]))
    return now


def _pairs(ways) -> list[tuple[int, list[str]]]:
    return [(w["at"], w["run"]) for w in ways]


def manifest(docs: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Proofs of all rows of ``docs`` (doc_id, source, lang, n_chars, text).

    A row per row: doc_id, leaf, subroot (of its language), root, proof_sha256 (of its siblings' digests from the leaf to the
    root), folded_root (from the leaf, of the tampered row where there is one, and the siblings) and verified (whether that is
    root), level (of the tree of languages: how many levels are above subroot) and tampered (whether the row was).

    Edge cases: a null is a field of its own, unlike the empty text; rows without a language are a tree that comes first; rows
    that repeat a doc_id stand side by side, ordered by leaf, and rows that are equal throughout have equal results up to their
    places; a row without doc_id comes first in its tree and is never tampered with; a tree of one leaf is that leaf, and where
    it is the only one, too, the proof is the digest of nothing; an empty table gives no rows; other columns play no part.
    """
    spark, paths = docs.sparkSession, []
    whole, roots = _blocks(_leaves(docs), levels, paths)
    state = _exchange(roots, paths)

    tops, top_roots = _blocks(state.where("block = 0").select(
        F.lit("").alias("tree"), F.struct(F.col("tree").alias("name"), F.col("root").alias("leaf")).alias("item")), levels, paths)
    top_ways = _exchange(top_roots, paths).select("tree", "block", "root", "ways")

    def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tree", pa.string()), ("root", pa.string()), ("above", _arrow_ways())])
        for batch in batches:
            for row in batch.to_pylist():
                nodes = _levels([x["leaf"] for x in row["items"]], row["size"], levels)
                yield from flush([(item["name"], row["root"], [{"at": at, "run": run} for at, run in _way(nodes, k)] + row["ways"])
                                  for k, item in enumerate(row["items"])], schema)

    above = tops.join(top_ways, ["tree", "block"]).mapInArrow(upper, f"tree string, root string, above {WAYS}")
    above = materialize(above, "merkle-above", paths)
    ways = state.select("tree", "block", F.col("root").alias("subroot"), "ways").join(broadcast_if_few(above, BROADCAST_WAYS), "tree")
    ways = materialize(ways, "merkle-ways", paths)

    out = pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
                     ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()),
                     ("level", pa.int32()), ("tampered", pa.bool_())])

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                items, higher = row["items"], _pairs(row["ways"]) + _pairs(row["above"])
                upper_siblings = "".join(d for at, run in higher for k, d in enumerate(run) if k != at)
                nodes, rows = _levels([x["leaf"] for x in items], row["size"], levels), []
                for k, item in enumerate(items):
                    lower = _way(nodes, k)
                    siblings = "".join(d for at, run in lower for j, d in enumerate(run) if j != at) + upper_siblings
                    folded = _climb(item["tampered"] or item["leaf"], lower + higher)
                    rows.append((item["doc_id"], item["leaf"], row["subroot"], row["root"], digest(siblings), folded,
                                 folded == row["root"], len(row["above"]), item["tampered"] is not None))
                yield from flush(rows, out)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_BLOCKS))
    found = whole.join(broadcast_if_few(ways, BROADCAST_WAYS), ["tree", "block"]).mapInArrow(
        proofs, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
                "verified boolean, level int, tampered boolean")
    result = materialize(found, "merkle-proofs")
    small_batches(spark)
    remove(spark, paths)
    return result


def _arrow_ways() -> pa.DataType:
    return pa.list_(pa.struct([("at", pa.int32()), ("run", pa.list_(pa.string()))]))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: a leaf for each row of ``documents``."""
    return manifest(read(spark, sf_dir, "documents")).drop("level", "tampered")


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}


def _oracle() -> str:
    """Level by level: nodes k has each tree's nodes (h) by place i; runs of 8 with their digests, where a tree has more
    than one node; up(k) is what is above. Documents then climb along the runs. 8 ** 9 rows of a language at most."""
    field = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')".format
    low = f"translate(text, '{CAPITALS}', '{SMALL}')"
    above = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    bits = ("flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), "
            "lambda b: (ord(c)::BIGINT >> b::INTEGER) & 1)))")
    crc = f"xor(list_reduce({bits}, lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295::BIGINT), 4294967295::BIGINT)"
    parts = [f"""d AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM (
      SELECT doc_id, coalesce('1' || lang, '0') AS t, sha256({above} || {field('text')}) AS leaf,
             CASE WHEN ({crc}) % 3 = 0 THEN sha256({above} || {field(low)}) END AS changed FROM documents))""",
             "n0 AS (SELECT t, i, leaf AS h, count(*) OVER (PARTITION BY t) AS n FROM d)"]

    def tree(name: str, levels: int) -> None:
        for k in range(levels):
            parts.append(f"r{name}{k} AS (SELECT t, i // 8 AS i, list(h ORDER BY i) AS run, any_value(n) AS n FROM n{name}{k} GROUP BY t, i // 8)")
            parts.append(f"n{name}{k + 1} AS (SELECT t, i, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h, "
                         f"count(*) OVER (PARTITION BY t) AS n FROM r{name}{k})")

    def climb(source: str, name: str, levels: int) -> str:
        for k in range(levels):
            at = f"(c.i // {8 ** k}) % 8"
            parts.append(f"""w{name}{k} AS (SELECT c.* EXCLUDE (p, f), p || CASE WHEN r.n = 1 THEN '' ELSE
      array_to_string(list_concat(run[1:{at}], run[{at} + 2:]), '') END AS p,
      CASE WHEN r.n = 1 THEN f ELSE sha256(array_to_string(run[1:{at}], '') || f || array_to_string(run[{at} + 2:], '')) END AS f
      FROM {source} c JOIN r{name}{k} r ON r.t = c.t AND r.i = c.i // {8 ** (k + 1)})""")
            source = f"w{name}{k}"
        return source

    tree("", 9)
    parts.append("nt0 AS (SELECT '' AS t, t AS lang, row_number() OVER (ORDER BY t) - 1 AS i, h, count(*) OVER () AS n FROM n9)")
    tree("t", 4)
    parts.append("s AS (SELECT *, '' AS p, coalesce(changed, leaf) AS f FROM d)")
    low_end = climb("s", "", 9)
    parts.append(f"u AS (SELECT w.doc_id, w.leaf, w.p, w.f, x.h AS subroot, x.i, '' AS t FROM {low_end} w JOIN nt0 x ON x.lang = w.t)")
    end = climb("u", "t", 4)
    return (f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified "
            f"FROM {end}, (SELECT h AS root FROM nt4)")


ORACLE = {"op13_merkle_manifest": _oracle()}
