"""Whole texts to ids of a public ``tokenizers`` file whose pre-tokenizer drops white space.

Such a tokenizer encodes every white-space separated word on its own, so each task keeps the ids of the words it
has met and joins them; the file is opened once in each Python worker. Where the file lower-cases and takes runs of letters and
runs of signs for pre-tokens, a word of Latin letters with signs behind is two of them: the lower-cased letters go straight to the
tokenizer's model. Only characters that are white space both for Python and for the tokenizer's pattern split a text, and a text
with the few that differ is encoded as a whole.
"""

from __future__ import annotations

import json
import os
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: str.split() splits at these too, the tokenizer's pattern does not.
_ODD = re.compile("[\x1c-\x1f]")
#: Words of a text whose ids are put together at once.
_GROUP = 1 << 18
#: Normalizer and pattern of the files whose words of letters may go straight to the model.
_NORMALIZER = ["NFC", "Replace", "Lowercase"]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_OPEN: dict[str, "Words"] = {}


def _byte_characters() -> dict[int, str]:
    """The characters that stand for the bytes of a byte-level model."""
    own = {*range(0x21, 0x7f), *range(0xa1, 0xad), *range(0xae, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(256 + n) for n, b in enumerate(others)}


_BYTES = _byte_characters()


def _letters(word: str) -> bool:
    """One pre-token: letters that are letters in every Unicode version; a lower-cased dotted I has a mark behind it."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250" and "\u0130" not in word)


def _by_runs(spec: dict) -> bool:
    """Whether a tokenizer file lower-cases and makes pre-tokens of runs of letters and runs of signs, in bytes."""
    try:
        steps, (split, level) = spec["normalizer"]["normalizers"], spec["pre_tokenizer"]["pretokenizers"]
        return ([s["type"] for s in steps] == _NORMALIZER and steps[1]["pattern"] == {"Regex": r"\s+"}
                and (split["type"], split["pattern"], split["behavior"], split["invert"]) == ("Split", {"Regex": _PATTERN}, "Removed", True)
                and (level["type"], level["add_prefix_space"], level["use_regex"]) == ("ByteLevel", False, False)
                and spec["model"]["type"] == "BPE" and not spec["model"]["dropout"]
                and all(re.match(r"[!-/:-@\[-`{-~]+[A-Za-z]", t["content"]) for t in spec["added_tokens"]))
    except (KeyError, TypeError, ValueError, IndexError):
        return False


class Words(dict):
    """word -> ids as little-endian unsigned 32-bit bytes."""

    #: Words held by one worker, in two generations: when the younger is full it becomes the older, and what is met again
    #: moves over, so that frequent words stay.
    MOST = 1_100_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        self.by_runs = _by_runs(spec)
        #: The bytes of every id.
        ids = np.arange(max(self.tokenizer.get_vocab().values()) + 1, dtype="<u4").tobytes()
        self.raw = [ids[at:at + 4] for at in range(0, len(ids), 4)]

    def bytes_of(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _run(self, word: str) -> bytes:
        """Of lower-case letters alone."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTES)
        raw = self.raw
        return b"".join([raw[token.id] for token in self.model.tokenize(word)])

    def ids_of(self, word: str) -> bytes:
        """The ids of a word; what they are made of is kept."""
        if not word:
            return b""
        if self.by_runs:
            core = word.rstrip(string.punctuation)
            if _letters(core):
                low = core.lower()
                ids = self.get(low) or self._keep(low, self.older.get(low) or self._run(low))
                return ids if len(core) == len(word) else ids + self[word[len(core):]]
        return self.get(word) or self._keep(word, self.older.get(word) or self.bytes_of(word))

    def _keep(self, word: str, ids: bytes) -> bytes:
        if len(word) <= 64:
            if 2 * len(self) >= self.MOST:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        return self._keep(word, self.older.get(word) or self.ids_of(word))

    def encode(self, text: str) -> bytes:
        """All ids of a text, four bytes each."""
        if _ODD.search(text):
            return self.bytes_of(text)
        return b"".join(map(self.__getitem__, text.split()))

    def encode_all(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        """``encode`` of each text of a batch; every word of the batch is looked up once."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        split = pc.ascii_split_whitespace(texts)  # at some of the tokenizer's white space; the rest is left to it
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.get, words))
        for k in [k for k, ids in enumerate(found) if ids is None]:
            found[k] = self.ids_of(words[k])
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) >> 2
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), dtype="<u4")
        at, ends = coded.indices.to_numpy(), np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        for k, end in enumerate(ends.tolist()):
            first = int(ends[k - 1]) if k else 0
            yield b"".join([_gather(at[i:min(i + _GROUP, end)], sizes, starts, flat) for i in range(first, end, _GROUP)])


def _gather(at: np.ndarray, sizes: np.ndarray, starts: np.ndarray, flat: np.ndarray) -> bytes:
    """The ids of the words ``at``, one after the other."""
    n = sizes[at]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[at] - ends + n, n) + np.arange(ends[-1])].tobytes()


def words_of(path: str) -> Words:
    """This worker's open tokenizer of ``path``."""
    if path not in _OPEN:
        _OPEN[path] = Words(path)
    return _OPEN[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
