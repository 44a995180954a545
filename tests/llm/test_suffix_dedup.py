import hashlib
import random

import numpy as np
import pytest

from keysweep.llm import suffix_dedup as S
from keysweep.llm import suffixes

from edge import ROWS, frame, random_texts


def naive(text):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    shared = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        shared.append(k)
    return order, shared


@pytest.mark.parametrize("bulk,in_memory", [(4, 8), (16, 1 << 20), (1 << 18, 1 << 22)])
def test_suffix_array_and_common_prefixes(monkeypatch, bulk, in_memory):
    monkeypatch.setattr(suffixes, "BULK", bulk)
    monkeypatch.setattr(suffixes, "IN_MEMORY", in_memory)  # runs of the queue on disk
    r = random.Random(bulk)
    for _ in range(150):
        letters = r.choice((1, 2, 3, 5, 60))
        text = [r.randint(1, letters) for _ in range(r.randint(0, 90))]
        if text and r.random() < 0.5:
            text += text[r.randrange(len(text)):] + text[:r.randrange(len(text))]
        order, shared = suffixes.suffix_array(np.array([*text, 0]))
        assert (order.tolist(), shared.tolist()) == naive([*text, 0])


def brute(rows, length):
    """doc_id, text -> (n_bytes, n_removed, n_spans, hash), documents in the operator's order."""
    seen, out = set(), {}
    texts = {(i, (t or "").encode()) for i, t in rows}
    for i, data in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(x[1]).hexdigest())):
        gone = np.zeros(len(data), dtype=bool)
        for k in range(len(data) - length + 1):
            string = data[k:k + length]
            if string in seen:
                gone[k:k + length] = True
            seen.add(string)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[i, data] = len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()
    return out


def check(spark, rows, length):
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], len(r["spans"]),
                  hashlib.sha256(r["kept"]).hexdigest()) for r in S.dedup(frame(spark, rows), length).collect())
    expected = brute(rows, length)
    assert got == sorted((i is not None, i or 0, *expected[i, (t or "").encode()]) for i, t in rows)


def test_against_brute_force(spark):
    check(spark, random_texts(120, 5), 20)


def test_edge_rows(spark):
    check(spark, ROWS, 30)


def test_hot_anchor_is_dealt_out_by_string(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 2)
    check(spark, random_texts(80, 9), 20)


def test_many_copies_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_KEYS", -1)
    check(spark, random_texts(40, 2) + [(1000 + k, "the same long text " * 8) for k in range(30)], 25)


def test_empty_table(spark):
    assert S.dedup(frame(spark, [])).collect() == []


def test_text_and_carried_columns(spark):
    rows = S.dedup(frame(spark, [(1, "é" * 30), (2, "x" + "é" * 30)]), 21, keep=("key", "data"), as_text=True).collect()
    assert {r["key"] for r in rows} == {1} and {r["data"] for r in rows} == {"d"}
    assert all(isinstance(r["text"], str) for r in rows)
