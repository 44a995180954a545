"""Operator 8, harmonic packing.

Piece lengths fall into classes of reciprocal capacity: a class of size ``capacity / k`` fills a bin with exactly
``k`` pieces. Documents may be cut freely, so each is cut into whole sequences and one piece for every set bit of the
rest: the classes are then ``capacity / 2**j``, every piece has exactly its class's size, and a bin of ``2**j`` pieces
is full to the last token. Each task packs its own rows (no shuffle, nothing global); what is left at its end is filled
up from the largest class down, so that a task leaves at most ``log2(capacity)`` sequences that are not full, each a
power of two long, which need no padding either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysweep.llm.common import flush, narrow, read, small_batches
from keysweep.llm.wordbpe import default_path, words_of

#: Rows of one output batch.
_ROWS = 4000
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                     ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def cuts(tokens: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: whole sequences, then the set bits of the rest from the largest down."""
    rest = tokens % capacity
    return [capacity] * (tokens // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if rest >> b & 1]


class Bins:
    """One task's open bins. A piece is (doc_id, start, length, ids, doc_tokens); rows gain sequence_id and offset."""

    def __init__(self, capacity: int, task: int):
        self.capacity, self.next_id, self.open = capacity, task << 40, {}

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        rows, at = [], 0
        for piece in pieces:
            rows.append((*piece, self.next_id, at))
            at += piece[2]
        self.next_id += 1
        return rows

    def add(self, piece: tuple) -> list[tuple]:
        """The rows of the bin that this piece fills, if it fills one."""
        bin_ = self.open.setdefault(piece[2], [])
        bin_.append(piece)
        if len(bin_) * piece[2] < self.capacity:
            return []
        return self._close(self.open.pop(piece[2]))

    def rest(self) -> list[tuple]:
        """The pieces left, from the largest down: full sequences, then sequences a power of two long."""
        rows, bin_, total = [], [], 0
        left = [p for size in sorted(self.open, reverse=True) for p in self.open[size]]
        ahead = sum(p[2] for p in left)
        room = min(self.capacity, 1 << ahead.bit_length() - 1) if ahead else 0
        for piece in left:
            bin_.append(piece)
            total, ahead = total + piece[2], ahead - piece[2]
            if total == room:
                rows += self._close(bin_)
                bin_, total = [], 0
                room = min(self.capacity, 1 << ahead.bit_length() - 1) if ahead else 0
        assert not bin_
        self.open = {}
        return rows


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = 2048, end_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` (a power of two) tokens.

    A row per piece: doc_id, start (its document's ids before it), length, ids (binary, little-endian unsigned 32
    bits), doc_tokens, sequence_id, offset (gapless from 0 in each sequence). Every id lies in exactly one piece.

    Edge cases: a null or empty text is the end id alone; a very long text is many full sequences and a rest; repeated
    rows and ids (null ones too) are packed like any others, each row on its own; an empty table gives no rows; other
    columns are ignored.
    """
    if capacity < 1 or capacity & capacity - 1:
        raise ValueError("capacity must be a power of two")
    path = tokenizer_path or default_path()
    small_batches(docs.sparkSession)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bins, rows = words_of(path), Bins(capacity, TaskContext.get().partitionId()), []
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode_all(batch.column(1))):
                ids += end
                tokens, at = len(ids) // 4, 0
                for size in cuts(tokens, capacity):
                    rows += bins.add((doc_id, at, size, ids[4 * at:4 * (at + size)], tokens))
                    at += size
                if len(rows) >= _ROWS:
                    yield from flush(rows, _SCHEMA)
                    rows = []
        yield from flush(rows + bins.rest(), _SCHEMA)

    return narrow(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: pieces with the unsigned CRC-32 of their ids."""
    pieces = pack(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


QUERIES = {"op8_packing": op8_packing}
ORACLE: dict[str, str] = {}
