"""Operator 10, a hidden Markov language model.

1. *Encoding* (one scan). Each task reads its texts once and writes chunks of documents: the tokens as numbers of a
   chunk's own dictionary, and that dictionary with its counts in training documents. Vocabularies grow without bound, so
   nothing of that size is ever broadcast: a dictionary row travels to its word's total count and back to its chunk.
2. *Training*. States emit one of a fixed number of hash buckets; a bucket gives each of its words the share that its
   count has, one more share being kept for unknown words. A mixture over all training documents forms the states; then, each round, tasks run forward-backward over all training tokens
   and the expected counts (states x buckets at most for each task) are summed by a shuffle; the model itself has a fixed size.
3. *Scoring*. The scaled forward recursion over each whole document gives its exact likelihood.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keysweep.llm.common import materialize, narrow, read, small_batches

#: The end of a text; a word never holds white space.
END = b"\n"
#: Bytes of text in one chunk: what a task holds at a time.
CHUNK_BYTES = 12 << 20
#: Tokens of one training sequence: longer documents are several (scoring never cuts).
SEGMENT = 256
#: Segments that run side by side.
SIDE = 512
#: Training ends when a round raises the log-likelihood by less than this for each token.
GAIN = 0.01
#: Rows of one batch of dictionary entries.
_DICT_ROWS = 20_000

_CHUNK = pa.schema([("chunk", pa.int64()), ("lid", pa.int32()), ("word", pa.binary()), ("count", pa.int64()),
                    ("blob", pa.binary())])
_CHUNK_SQL = "chunk long, lid int, word binary, count long, blob binary"


def bucket_of(word: bytes, buckets: int) -> int:
    return zlib.crc32(word) % buckets


class Numbering(dict):
    """word -> number in order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def pack_blob(ids: np.ndarray, ends: np.ndarray, doc_ids: list, held: list, buckets: np.ndarray) -> bytes:
    """One chunk as bytes: tokens of all documents (each ends with its end token), their bounds and flags."""
    known = np.array([d is not None for d in doc_ids], dtype="u1")
    numbers = np.array([d or 0 for d in doc_ids], dtype="<i8")
    head = np.array([len(ids), len(ends), len(buckets)], dtype="<i8")
    return zlib.compress(b"".join([head.tobytes(), ends.astype("<i8").tobytes(), numbers.tobytes(),
                                   ids.astype("<i4").tobytes(), buckets.astype("<i4").tobytes(), known.tobytes(),
                                   np.array(held, dtype="u1").tobytes()]), 1)


def open_blob(blob: bytes):
    raw = zlib.decompress(blob)
    n, m, v = np.frombuffer(raw, "<i8", 3)
    at = 24
    out = []
    for kind, size in (("<i8", m), ("<i8", m), ("<i4", n), ("<i4", v), ("u1", m), ("u1", m)):
        out.append(np.frombuffer(raw, kind, size, at))
        at += out[-1].nbytes
    ends, numbers, ids, buckets, known, held = out
    return ids, ends, numbers, known.astype(bool), held.astype(bool), buckets


def encode(docs: DataFrame, held_out: str, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks (rows with a blob) and their dictionaries (rows with a word) in one table. ``held_out``: SQL predicate over
    doc_id, true for documents that must not train the model."""
    small_batches(docs.sparkSession)
    table = narrow(docs, id_col, text_col).select(
        "doc_id", F.col("text").cast("binary"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held"),
        F.monotonically_increasing_id().alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts, ends, doc_ids, held, size, at, chunk = Numbering(), [], [], [], [], 0, 0, None

        def close() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
            train = np.repeat(~np.array(held, dtype=bool), np.diff(ends, prepend=0))
            counts = np.bincount(ids[train], minlength=len(words))
            hashed = np.fromiter((bucket_of(w, buckets) for w in words), dtype=np.int32, count=len(words))
            blob = pack_blob(ids, np.array(ends), doc_ids, held, hashed)
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([None], pa.int32()), pa.array([None], pa.binary()),
                                              pa.array([None], pa.int64()), pa.array([blob], pa.binary())], schema=_CHUNK)
            names = list(words)
            for k in range(0, len(names), _DICT_ROWS):
                part = names[k:k + _DICT_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(part)), pa.array(np.arange(k, k + len(part), dtype=np.int32)),
                     pa.array(part, pa.binary()), pa.array(counts[k:k + len(part)].astype(np.int64)),
                     pa.nulls(len(part), pa.binary())], schema=_CHUNK)

        for batch in batches:
            for doc_id, text, out, row in zip(*(c.to_pylist() for c in batch.columns)):
                chunk = row if chunk is None else chunk  # of a chunk's first row: no two chunks share it
                tokens = text.lower().split()  # of bytes: A-Z only, and the six characters of ASCII white space
                tokens.append(END)
                parts.append(np.fromiter(map(words.__getitem__, tokens), dtype=np.int32, count=len(tokens)))
                at += len(tokens)
                ends.append(at)
                doc_ids.append(doc_id)
                held.append(out)
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield from close()
                    words, parts, ends, doc_ids, held, size, at, chunk = Numbering(), [], [], [], [], 0, 0, None
        if doc_ids:
            yield from close()

    return table.mapInArrow(run, _CHUNK_SQL)


@dataclass
class Model:
    """start (K), move (K x K) and emit (buckets x K, each column a distribution)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def expect(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of bucket sequences: start (K), move (K x K), emit (buckets x K), log-likelihood."""
    states = len(model.start)
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros_like(model.emit)
    total, ones, back = 0.0, np.ones(states), np.ascontiguousarray(model.move.T)
    order = sorted((s for s in sequences if len(s)), key=len, reverse=True)
    for k in range(0, len(order), SIDE):
        part = order[k:k + SIDE]
        sizes = np.array([len(s) for s in part])
        steps = sizes[0]
        active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # sequences longer than t
        tokens = np.zeros((steps, len(part)), dtype=np.int32)
        for j, s in enumerate(part):
            tokens[:len(s), j] = s
        alpha, scale = np.zeros((steps, len(part), states)), np.ones((steps, len(part)))
        seen = model.emit[tokens]
        a = model.start * seen[0]
        for t in range(steps):
            n = active[t]
            if t:
                a = (alpha[t - 1, :n] @ model.move) * seen[t, :n]
            c = np.matmul(a, ones, out=scale[t, :n])
            np.divide(a, c[:, None], out=alpha[t, :n])
        total += float(np.log(scale).sum())
        beta = np.ones((len(part), states))
        gamma = alpha.copy()
        seen /= scale[:, :, None]
        for t in range(steps - 2, -1, -1):
            n = active[t + 1]
            ahead = seen[t + 1, :n] * beta[:n]
            move += alpha[t, :n].T @ ahead
            np.matmul(ahead, back, out=beta[:n])
            gamma[t, :n] *= beta[:n]
        start += gamma[0].sum(axis=0)
        flat, at = gamma.reshape(-1, states), tokens.reshape(-1)
        for z in range(states):  # padding has weight 0: alpha is 0 there
            emit[:, z] += np.bincount(at, weights=flat[:, z], minlength=len(emit))
    return start, move * model.move, emit, total


def maximise(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Model:
    """The next model; ``prior`` (a distribution over buckets, all positive; or one for each state) smooths the emissions."""
    start, move = start + 1.0, move + 1.0
    emit = emit + max(50.0, len(prior) / 4) * prior.reshape(len(prior), -1)
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0, keepdims=True))


def training(blob: bytes) -> list[np.ndarray]:
    """Bucket sequences of a chunk's training documents."""
    ids, ends, _, _, held, hashed = open_blob(blob)
    seq, begins = hashed[ids], np.concatenate([[0], ends[:-1]])
    return [seq[b:e] for b, e, out in zip(begins, ends, held) if not out]


def segments(sequences: list[np.ndarray]) -> list[np.ndarray]:
    return [s[k:k + SEGMENT] for s in sequences for k in range(0, len(s), SEGMENT)]


def mixture(emit: np.ndarray, weight: np.ndarray, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected counts of a mixture that draws each part from one state: emit (buckets x K), parts (K), log-likelihood."""
    logs, found, mass, total = np.log(emit), np.zeros_like(emit), np.zeros_like(weight), 0.0
    for k in range(0, len(parts), SIDE // 2):
        part = parts[k:k + SIDE // 2]
        sizes, flat = np.array([len(s) for s in part]), np.concatenate(part)
        score = np.add.reduceat(logs[flat], np.cumsum(sizes) - sizes) + np.log(weight)
        top = score.max(axis=1, keepdims=True)
        share = np.exp(score - top)
        norm = share.sum(axis=1, keepdims=True)
        total += float((top + np.log(norm)).sum())
        share /= norm
        mass += share.sum(axis=0)
        for z in range(len(weight)):
            found[:, z] += np.bincount(flat, weights=np.repeat(share[:, z], sizes), minlength=len(emit))
    return found, mass, total


def summed(chunks: DataFrame, rows: int, states: int, counts: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """The sum of ``counts`` (rows x K) over the training documents of all chunks: of a fixed size, whatever the corpus."""
    names = [f"s{z}" for z in range(states)]
    schema = pa.schema([("kind", pa.int32()), *[(n, pa.float64()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((rows, states))
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                table += counts(training(blob))
        at = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(table[at, z]) for z in range(states)]],
                                         schema=schema)

    blobs = chunks.where("blob is not null").select("blob")
    parts = blobs.rdd.getNumPartitions()  # each task sends a table: fewer tasks where there are many
    sums = (blobs.coalesce(max(1, parts // 4, min(parts, 4 * chunks.sparkSession.sparkContext.defaultParallelism)))
            .mapInArrow(run, "kind int, " + ", ".join(f"{n} double" for n in names))
            .groupBy("kind").agg(*[F.sum(n).alias(n) for n in names]))
    table = np.zeros((rows, states))
    for row in sums.collect():
        table[row[0]] = row[1:]
    return table


def first_model(chunks: DataFrame, states: int, prior: np.ndarray, gain: float = GAIN, seed: int = 7) -> Model:
    """The point from which training starts: a mixture fitted to the segments of all training documents, and states that
    tend to stay. It begins with one random tilt of the prior for each state, the same however the table is partitioned,
    and ends when a round gains less than ``gain`` for each token."""
    buckets = len(prior)
    tilted = prior[:, None] * np.exp(np.random.default_rng(seed).normal(size=(buckets, states)))
    tilted /= tilted.sum(axis=0)
    emit, weight, last = tilted, np.full(states, 1 / states), -np.inf
    while True:
        def counts(sequences: list[np.ndarray], emit: np.ndarray = emit, weight: np.ndarray = weight) -> np.ndarray:
            found, mass, total = mixture(emit, weight, segments(sequences))
            return np.vstack([found, mass[None], np.full((1, states), total)])

        table = summed(chunks, buckets + 2, states, counts)
        found, mass, now = table[:buckets], table[buckets], table[-1, 0]
        if not found.any():  # no training documents
            tilted = found = np.repeat(prior[:, None], states, axis=1)
            break
        emit = (found + 5.0 * tilted) / (found.sum(axis=0) + 5.0)
        weight = (mass + 1e-6 * mass.sum()) / (mass.sum() * (1 + 1e-6 * states))
        if now - last < gain * found.sum():
            break
        last = now
    move = np.full((states, states), 0.1 * max(1.0, buckets))
    np.fill_diagonal(move, 2.0 * buckets)
    return maximise(np.ones(states), move, found, tilted)


def train(chunks: DataFrame, prior: np.ndarray, states: int, rounds: int, gain: float = GAIN) -> Model:
    """Expectation maximisation over all training tokens: at least ``rounds`` rounds, and more until one gains less than
    ``gain`` for each token. A model of fixed size comes back each round."""
    model, buckets, last, done = first_model(chunks, states, prior, gain), len(prior), -np.inf, 0
    while True:
        def counts(sequences: list[np.ndarray], now: Model = model) -> np.ndarray:
            start, move, emit, total = expect(now, segments(sequences))
            return np.vstack([emit, move, start[None], np.full((1, states), total)])

        table = summed(chunks, buckets + states + 2, states, counts)  # buckets, then states (their moves), then the starts
        model, done, now = maximise(table[-2], table[buckets:-2], table[:buckets], prior), done + 1, table[-1, 0]
        if done >= rounds and now - last <= gain * table[:buckets].sum():
            return model
        last = now


def forward(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of each whole bucket sequence by the scaled forward recursion."""
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    out = np.zeros(len(sequences))
    for k in range(0, len(order), SIDE):
        part = [sequences[i] for i in order[k:k + SIDE]]
        sizes = np.array([len(s) for s in part])
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        flat = np.concatenate(part) if part else np.zeros(0, dtype=np.int32)
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        logs = np.zeros(len(part))
        a = np.tile(model.start, (len(part), 1))
        for t, n in enumerate(active):
            a = (a[:n] @ model.move if t else a) * model.emit[flat[begins[:n] + t]]
            c = a.sum(axis=1)
            a /= c[:, None]
            logs[:n] += np.log(c)
        out[order[k:k + SIDE]] = logs
    return out


_SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                    ("base_score", pa.float64()), ("score", pa.float64())])
_SCORE_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, held_out: str = "false", states: int = 8, buckets: int = 16384, rounds: int = 2,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trains on the documents that ``held_out`` leaves and scores all.

    A row per row: doc_id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score (add-one unigram)
    and score, both log10 probabilities of the whole text with its end.

    Edge cases: a null or empty text is the end alone; very long texts are scored whole; repeated rows and ids (null too)
    count and are scored as often as they stand; without training documents both models are uniform over one unknown
    token; an empty table gives no rows; other columns are ignored.
    """
    chunks = materialize(encode(docs, held_out, buckets, id_col, text_col), "hmm-chunks")
    # One shuffle by word gives every dictionary row its total and names one row of each word.
    word = Window.partitionBy("word")
    entries = (chunks.where("word is not null").select("chunk", "lid", "word", "count")
               .withColumn("total", F.sum("count").over(word)).where("total > 0")
               .withColumn("first", F.struct("chunk", "lid") == F.min(F.struct("chunk", "lid")).over(word))
               .select("chunk", "lid", "total", F.when(F.col("first"), F.pmod(F.crc32("word"), F.lit(buckets))).cast("int").alias("bucket")))
    entries = materialize(entries, "hmm-entries")
    by_bucket = (entries.where("bucket is not null").groupBy("bucket")
                 .agg(F.count("*").alias("n"), F.sum("total").alias("total")).collect())
    tokens, types = sum(r["total"] for r in by_bucket), sum(r["n"] for r in by_bucket)
    # what a bucket's shares add up to: each of its words one more than its count, and one for unknown words
    shares = np.ones(buckets)
    for r in by_bucket:
        shares[r["bucket"]] += r["n"] + r["total"]
    model = train(chunks, shares / shares.sum(), states, rounds)

    known = entries.select("chunk", "lid", "total", F.lit(None).cast("binary").alias("blob"))
    table = chunks.where("blob is not null").select(
        "chunk", F.lit(None).cast("int").alias("lid"), F.lit(None).cast("long").alias("total"), "blob").unionByName(known)
    table = table.repartition("chunk").sortWithinPartitions("chunk", F.col("lid").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lids, totals, chunk = [], [], None
        for batch in batches:
            blobs = batch.column(3)
            numbers, chunk_of = batch.column(1), batch.column(0).to_numpy()
            if blobs.null_count == len(blobs):
                if len(blobs) and chunk_of[0] == chunk_of[-1] == (chunk if chunk is not None else chunk_of[0]):
                    chunk = chunk_of[0]
                    lids.append(numbers.to_numpy())
                    totals.append(batch.column(2).to_numpy())
                    continue
            for here in dict.fromkeys(chunk_of.tolist()):
                if here != chunk:
                    lids, totals, chunk = [], [], here
                mine = batch.filter(pa.array(chunk_of == here))
                entries_ = mine.filter(mine.column(3).is_null())
                lids.append(entries_.column(1).to_numpy(zero_copy_only=False))
                totals.append(entries_.column(2).to_numpy(zero_copy_only=False))
                for blob in mine.filter(mine.column(3).is_valid()).column(3).to_pylist():
                    yield from scored(blob, np.concatenate(lids), np.concatenate(totals))
                    lids, totals = [], []

    def scored(blob: bytes, lids: np.ndarray, totals: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, ends, numbers, known_, held, hashed_ = open_blob(blob)
        count = np.zeros(len(hashed_))
        count[lids.astype(np.int64)] = totals
        begins = np.concatenate([[0], ends[:-1]])
        base = np.log10((count + 1) / (tokens + types + 1))[ids]
        inside = np.log((count + 1) / shares[hashed_])[ids]
        seq = hashed_[ids]
        sums = lambda x: np.add.reduceat(x, begins)  # noqa: E731  no document is without tokens
        logs = forward(model, [seq[b:e] for b, e in zip(begins, ends)]) + sums(inside)
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers, mask=~known_), pa.array(held), pa.array(ends - begins),
             pa.array(sums((count > 0)[ids].astype(np.int64))), pa.array(sums(base)), pa.array(logs / np.log(10))],
            schema=_SCORE)

    return table.mapInArrow(run, _SCORE_SQL).withColumn("train_tokens", F.lit(int(tokens)).cast("long"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: documents whose CRC-32 leaves remainder 2 by 7 are held out."""
    return score(read(spark, sf_dir, "documents"), "crc32(cast(doc_id as string)) % 7 = 2").select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op10_lm_scoring": op10_lm_scoring}
ORACLE: dict[str, str] = {}
