"""Operator 7, encoding and decoding with the pieces of a SentencePiece model: shared-prefix Viterbi.

Spaces become marks, and a text is cut into marked words at places that no piece crosses, so the path of a text is the
paths of its words. The distinct new words of a batch are sorted: that order walks their trie depth first, and forward
states stand on a stack that is cut back to the prefix shared with the word before. Each task does this for its own texts
and remembers what it has met.

The given model was trained by merging, so the right path isn't the one with the best sum of scores but the one that
merging in the order of the scores leaves. That order decides which two pieces may stand side by side; with only such
steps allowed, exactly one path reaches each position, and the forward state of a position is that path's last piece.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keysweep.llm.common import narrow, read, small_batches

MARK = "▁"
#: Words that one worker remembers.
MOST = 700_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Pieces of a model, the order in which it merges, and the paths of the words met so far."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.unknown = model.unk_id()
        self.byte_ids: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        scores: dict[str, float] = {}
        for i, piece in enumerate(self.text):
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], scores[piece] = i, model.get_score(i)
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces with a mark after other characters cannot be cut at words")
        # Runs of marks merge last and from the left: they are looked up by length.
        self.runs = {len(p): i for p, i in self.ids.items() if not p.strip(MARK)}
        order = sorted((p for p in self.ids if len(p) > 1 and p.strip(MARK)), key=lambda p: (-scores[p], self.ids[p]))
        self.rank = {p: r for r, p in enumerate(order)}  # of pieces that merging makes
        self.parts: dict[str, tuple[str, str]] = {}
        for piece in order:
            if len(halves := self._merged(piece, self.rank[piece])) == 2:
                self.parts[piece] = (halves[0], halves[1])
        self.longest = max(map(len, order), default=1)
        alone = "" if any("\n" in p for p in order) else "\n"
        # No piece has one of these behind a letter, so words end there too.
        signs = re.escape("".join(c for c in string.punctuation if not any(
            b == c and a.isalpha() for p in order for a, b in zip(p, p[1:]))))
        rest = f"[^{MARK}{alone}]"
        cut = f"{MARK}?[^\\W\\d_]+(?=[{signs}])|" if signs else ""
        self.word = re.compile(f"{cut}{MARK}{rest}+|{MARK}+(?={MARK}{rest})|{MARK}+|{rest}+" + "|\n" * bool(alone))
        self.memo: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def _merged(self, piece: str, below: int) -> list[str]:
        """What merging makes of a piece's characters with the pieces that come before it."""
        parts = list(piece)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, below) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best >= below:
                break
            at = ranks.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: str, right: str) -> bool:
        """Whether merging leaves these two pieces side by side: their merges are taken back, the latest first, and no two
        pieces that then meet at the border may merge earlier than what was taken back. (Of equal merges the left comes
        first.)"""
        key = left, right
        known = self.fits.get(key)
        if known is not None:
            return known
        rank, parts, limit, fits = self.rank, self.parts, len(self.rank) + 1, None
        while fits is None:
            if rank.get(left + right, limit) < limit:
                fits = False
                break
            a, b = (rank[left] if left in parts else -1), (rank[right] if right in parts else -1)
            if a > b:
                limit, left = a, parts[left][1]
            elif b >= 0:
                limit, right = b + 1, parts[right][0]
            else:
                fits = True
        if len(self.fits) > 2 * MOST:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    def learn(self, words: list[str]) -> None:
        """The paths of sorted distinct words. ``last[j]`` is the last piece of the path to position j; states within the
        prefix shared with the word before are kept."""
        last, before = [""], ""
        parts, longest, may_follow = self.parts, self.longest, self.may_follow
        for word in words:
            if not word.strip(MARK):
                self.memo[word] = self._marks(len(word))
                continue
            same, limit = 0, min(len(word), len(before))
            while same < limit and word[same] == before[same]:
                same += 1
            del last[same + 1:]
            for end in range(same + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    piece = word[start:end]
                    if (start + 1 == end or piece in parts) and (not start or may_follow(last[start], piece)):
                        last.append(piece)
                        break
            path, at = [], len(word)
            while at:
                path.append(last[at])
                at -= len(last[at])
            ids = [i for p in reversed(path) for i in ((self.ids[p],) if p in self.ids else self.bytes_of(p))]
            self.memo[word] = np.array(ids, dtype="<u4").tobytes()
            before = word

    def _marks(self, n: int) -> bytes:
        ids = []
        while n:
            k = max(x for x in self.runs if x <= n)
            ids.append(self.runs[k])
            n -= k
        return np.array(ids, dtype="<u4").tobytes()

    def bytes_of(self, char: str) -> tuple[int, ...]:
        """A character without a piece."""
        return tuple(self.byte_ids.get(b, self.unknown) for b in char.encode("utf-8", "surrogatepass"))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids (little-endian unsigned 32 bits) of each text; an empty text has none."""
        if 2 * len(self.words) > MOST:  # two generations: what is met again moves to the younger
            self.older, self.words, self.memo = self.words, {}, {}
        plain = [bool(t) and MARK not in t and "  " not in t and t[0] != " " for t in texts]
        cut = [t.split(" ") if p else self.word.findall(MARK + t.replace(" ", MARK)) if t else [] for t, p in zip(texts, plain)]
        # what a space ends is a mark and one word or more; each such string is looked up as a whole
        fresh = {w for words, p in zip(cut, plain) if p for w in words}
        missing = [w for w in fresh if w not in self.words]
        self.words.update({w: self.older[w] for w in missing if w in self.older})
        parts = {w: self.word.findall(MARK + w) for w in missing if w not in self.older}
        new = {w for words in parts.values() for w in words} | {w for words, p in zip(cut, plain) if not p for w in words}
        self.learn(sorted(w for w in new if w not in self.memo))
        for w, words in parts.items():
            self.words[w] = b"".join(map(self.memo.__getitem__, words))
        out = [b"".join(map(self.words.__getitem__, words) if p else self._joined(words)) for words, p in zip(cut, plain)]
        for known, least in ((self.words, parts), (self.memo, new)):
            for w in [w for w in least if len(w) > 64]:
                del known[w]
        return out

    def _joined(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words among which are runs of marks; a word's own mark that stays a piece joins the run before it."""
        mark, run = np.array([self.ids.get(MARK, self.unknown)], dtype="<u4").tobytes(), 0
        for word in words:
            if not word.strip(MARK):
                run += len(word)
                continue
            ids = self.memo[word]
            if run:
                own = ids.startswith(mark) and word[0] == MARK
                yield self._marks(run + own)
                ids, run = ids[4 * own:], 0
            yield ids
        yield self._marks(run)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; byte pieces are joined, bytes that are no UTF-8 become replacement characters."""
        parts: list[bytes] = []
        byte = {i: bytes([b]) for b, i in self.byte_ids.items()}
        for i in ids.tolist():
            parts.append(byte[i] if i in byte else self.text[i].encode("utf-8"))
        text = b"".join(parts).decode("utf-8", "replace")
        return text.replace(MARK, " ")[1:] if text else ""


_OPEN: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _OPEN:
        _OPEN[path] = Pieces(path)
    return _OPEN[path]


def encode(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids and ids (binary, little-endian unsigned 32 bits) of every row's whole text.

    The text is not normalised: a mark is put before it and spaces become marks, so decoding gives the text back (marks
    that stood in the text come back as spaces).

    Edge cases: a null or empty text has no ids; a very long text, or one very long word, is encoded whole; equal merges go
    from the left; repeated rows stay repeated; an empty table gives no rows; other columns are ignored.
    """
    path = model_path or default_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for batch in batches:
            ids = pieces.encode_batch(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                                              pa.array(ids, pa.binary())], ["doc_id", "n_ids", "ids"])

    return narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_ids long, ids binary")


def decode(encoded: DataFrame, model_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of ids as ``encode`` gives them (null or no ids: empty)."""
    path = model_path or default_path()
    small_batches(encoded.sparkSession)
    table = encoded.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for batch in batches:
            texts = [pieces.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return table.mapInArrow(run, "doc_id long, text string")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of ids and the CRC-32 of its ids."""
    return encode(read(spark, sf_dir, "documents")).select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op7_pieces": op7_pieces}
ORACLE: dict[str, str] = {}
