import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from keysweep.llm import packing as K
from keysweep.llm import token_counts as T
from keysweep.llm.common import read
from keysweep.llm.wordbpe import Words, default_path

from conftest import SF_SMALL
from edge import ROWS, frame


def check(rows, texts, capacity):
    tokenizer = Tokenizer.from_file(default_path())
    pieces: dict = {}
    sequences: dict = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] > 0
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in texts.items():
        found = sorted(pieces.pop(i), key=lambda r: r["start"])
        whole = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert [r["start"] for r in found] == np.cumsum([0] + [r["length"] for r in found])[:-1].tolist()
        assert np.frombuffer(b"".join(r["ids"] for r in found), "<u4").tolist() == whole
        assert {r["doc_tokens"] for r in found} == {len(whole)}
    assert not pieces
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity and at & at - 1 == 0  # full, or a power of two: nothing is padded
    return sequences


@pytest.mark.parametrize("capacity", [2048, 64, 1])
def test_given_documents(spark, capacity):
    docs = read(spark, SF_SMALL, "documents").repartition(3) if capacity == 64 else read(spark, SF_SMALL, "documents")
    docs = docs.where("doc_id < 20") if capacity == 1 else docs
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sequences = check(K.pack(docs, capacity=capacity).collect(), texts, capacity)
    short = sum(sum(x[1] for x in s) < capacity for s in sequences.values())
    assert short <= 3 * max(1, capacity.bit_length())


def test_edge_rows(spark):
    rows = [r for r in ROWS if r[0] not in (5, None)]
    check(K.pack(frame(spark, rows)).collect(), dict(rows), 2048)
    twice = K.pack(frame(spark, [(5, "one two"), (5, "one two"), (None, None)])).collect()
    assert sum(r["length"] for r in twice if r["doc_id"] == 5) == 2 * twice[0]["doc_tokens"] or len(twice) >= 3
    assert K.pack(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        K.pack(frame(spark, []), capacity=100)


def test_query_checksums(spark):
    docs = {r["doc_id"]: r["text"] for r in read(spark, SF_SMALL, "documents").collect()}
    words = Words(default_path())
    for r in K.op8_packing(spark, SF_SMALL).collect():
        ids = words.bytes_of(docs[r["doc_id"]]) + np.array([1], "<u4").tobytes()
        assert r["ids_crc32"] == zlib.crc32(ids[4 * r["start"]:4 * (r["start"] + r["length"])])


def test_words_encode_like_whole_texts():
    words = Words(default_path())
    for text in ("Don't STOP, it's 1.5% of É́tudes...", "a\x1cb <|endoftext|>x ΣΑΣ ΑΣ.", "İstanbul ǅ.", "x" * 200 + ",", "日本語。 ok"):
        assert words.encode(text) == words.bytes_of(text)


def test_new_words_are_encoded_together():
    """A dotted I lower-cases to two characters, the second of which joins a sign behind it."""
    texts = ["Xİ, aİ", "", " \n", "Don't STOP, it's 1.5% of É́tudes...", "a\x1cb <|endoftext|>x ΣΑΣ.", "ª º, ŉ. ǅ, ß.", "x" * 200 + ",",
             "one One ONE, one. two", "one, three"] * 3
    for group in (texts, texts[:1], texts[::-1], []):
        words = Words(default_path())
        assert list(words.encode_all(group)) == [words.bytes_of(text) for text in group]
        assert [words.encode(text) for text in group] == [words.bytes_of(text) for text in group]
    words, alone = Words(default_path()), []
    words.bytes_of = lambda word: alone.append(word) or Words.bytes_of(words, word)
    list(words.encode_all([" ".join(f"{a}{b}, {b}{a.upper()}" for a in "abcdefghij" for b in "klmnopqrst")]))
    assert alone == [","]
    words.MOST = 8  # words held go again and again
    assert list(words.encode_all(texts)) == [Words.bytes_of(words, text) for text in texts]


def test_letters_with_signs_behind_are_two_runs():
    """Letters with signs behind cost one look at the letters; apostrophes, digits and marks are left to the tokenizer."""
    texts = [" ".join(f"{a}{b}{s} {b.upper()}{a}{s}" for a in "abcdeé" for b in ("tion", "Él") for s in ("$$$", "!!", "%%%", ".***")),
             "it's IT'S don't'; x'% a-b_ b\u0301! 'll. <|endoftext|>% a<|endoftext|> Ⱥ# ŉ'", "\u00a0a\u00a0% b\x85.", "", "\n a \n"]
    words, alone = Words(default_path()), []
    words.bytes_of = lambda word: alone.append(word) or Words.bytes_of(words, word)
    assert list(words.encode_all(texts)) == [Words.bytes_of(words, text) for text in texts]
    assert sorted(word for word in alone if word[-1] in "$*") == sorted(["$$$", ".***"])
    words.by_runs = False  # another pre-tokenizer: every word by itself
    words.clear()
    assert list(words.encode_all(texts)) == [Words.bytes_of(words, text) for text in texts]


def test_histogram_answers_every_limit(spark):
    docs = read(spark, SF_SMALL, "documents")
    tokenizer = Tokenizer.from_file(default_path())
    sizes = np.array([len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.collect()])
    hist = T.histogram(T.lengths(docs)).cache()
    for r in hist.collect():
        n = r["length"]
        assert r["n_docs"] == (sizes == n).sum() and r["docs_longer"] == (sizes > n).sum()
        assert r["tokens_longer"] == sizes[sizes > n].sum() and r["tokens_total"] == sizes.sum()
        assert r["truncated_total"] == np.minimum(sizes, n).sum() and abs(r["quantile"] - (sizes <= n).mean()) < 1e-12
    limits = [0, 1, 77, 512, 512, 2048, 10**9]
    got = sorted((r["context_limit"], r["docs_cut"], r["truncated_total"]) for r in T.at_limits(hist, limits).collect())
    assert got == sorted((c, int((sizes > c).sum()), int(np.minimum(sizes, c).sum())) for c in limits)
    shares = {r["share"]: r["length"] for r in T.quantiles(hist, [0.01, 0.5, 0.9, 1.0]).collect()}
    for share, n in shares.items():
        assert (sizes <= n).mean() >= share - 1e-12 and (sizes < n).mean() < share


def test_histogram_edge_rows(spark):
    got = T.histogram(T.lengths(frame(spark)))
    assert sum(r["n_docs"] for r in got.collect()) == len(ROWS)
    assert T.histogram(T.lengths(frame(spark, []))).collect() == []
    assert T.at_limits(T.histogram(T.lengths(frame(spark, []))), [5]).collect() == []
