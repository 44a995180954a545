import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from keysweep.llm import hmm as L
from keysweep.llm.common import read

from conftest import SF_SMALL
from edge import ROWS, frame


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


def small_model(seed=0, states=3, buckets=5):
    rng = np.random.default_rng(seed)
    return L.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(buckets), states).T.copy())


def paths(model, seq):
    """Probability of a sequence along every path of states."""
    for path in itertools.product(range(len(model.start)), repeat=len(seq)):
        p = model.start[path[0]] * model.emit[seq[0], path[0]]
        for a, b, x in zip(path, path[1:], seq[1:]):
            p *= model.move[a, b] * model.emit[x, b]
        yield path, p


def test_forward_is_the_sum_over_all_paths():
    model, seqs = small_model(), [np.array(s) for s in ([0], [1, 4, 2], [3, 3, 3, 0, 1], [2, 1])]
    expected = [math.log(sum(p for _, p in paths(model, s))) for s in seqs]
    assert np.allclose(L.forward(model, seqs), expected, rtol=1e-12)


def test_expected_counts_are_those_of_all_paths(monkeypatch):
    monkeypatch.setattr(L, "SIDE", 2)
    model, seqs = small_model(1), [np.array(s) for s in ([0, 1, 4], [3, 3, 0, 1], [2])]
    start, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for s in seqs:
        every = list(paths(model, s))
        total = sum(p for _, p in every)
        for path, p in every:
            start[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                move[a, b] += p / total
            for x, z in zip(s, path):
                emit[x, z] += p / total
    got = L.expect(model, seqs)
    assert np.allclose(got[0], start) and np.allclose(got[1], move) and np.allclose(got[2], emit)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(5)
    truth = L.Model(np.array([0.5, 0.5]), np.array([[0.95, 0.05], [0.1, 0.9]]), np.array([[0.6, 0.0], [0.4, 0.1], [0.0, 0.9]]))
    seqs = []
    for _ in range(60):
        z, s = rng.integers(2), []
        for _ in range(40):
            s.append(rng.choice(3, p=truth.emit[:, z]))
            z = rng.choice(2, p=truth.move[z])
        seqs.append(np.array(s))
    model, prior, last = small_model(2, 2, 3), np.full(3, 1 / 3), -np.inf
    for _ in range(8):
        start, move, emit, now = L.expect(model, seqs)
        assert now > last - 1.0  # the priors may cost a little
        last, model = now, L.maximise(start, move, emit, prior)


def base(rows, held):
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    total, types = sum(counts.values()), len(counts)
    return {(i, t): (held(i), len(words(t)), sum(counts[w] > 0 for w in words(t)), total,
                     sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in words(t))) for i, t in rows}


def test_query_base_and_held_out_score(spark):
    rows = [(r["doc_id"], r["text"]) for r in read(spark, SF_SMALL, "documents").collect()]
    expected = {k[0]: v for k, v in base(rows, lambda i: zlib.crc32(str(i).encode()) % 7 == 2).items()}
    got = L.op10_lm_scoring(spark, SF_SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        held, n, known, total, score = expected[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(score, rel=1e-9)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_scores_are_a_distribution_over_one_token_texts(spark):
    """All texts of no or one word: their probabilities, with those of unknown words, stay below one."""
    rows = [(k, t) for k, t in enumerate(["a b a", "b c", "c c d", "", "a", "b", "c", "d", "unseen"])]
    got = {r["doc_id"]: r["score"] for r in L.score(frame(spark, rows), "doc_id > 2", states=2, buckets=8).collect()}
    assert 0 < sum(10 ** got[k] for k in range(3, 9)) < 1


def test_edge_rows(spark):
    got = L.score(frame(spark), states=2, buckets=16, rounds=1).collect()
    expected = base(ROWS, lambda i: False)
    key = lambda r: (r[0] is not None, *r)
    assert sorted(((r["doc_id"], r["n_tokens"], r["n_known"]) for r in got), key=key) == sorted(
        ((i, expected[i, t][1], expected[i, t][2]) for i, t in ROWS), key=key)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    none = L.score(frame(spark), "true", states=2, buckets=16, rounds=1).collect()
    assert {r["train_tokens"] for r in none} == {0} and len(none) == len(ROWS)
    assert L.score(frame(spark, []), states=2, buckets=16, rounds=1).collect() == []


def topics(spark, held, parts=2):
    """40 texts of two topics; ``held`` ones stand first, in a partition of their own."""
    rows = [(k, " ".join(f"{'xy'[k % 2]}{(7 * k + j * j) % 40}" for j in range(60))) for k in range(40)]
    first = spark.createDataFrame(held, "doc_id long, text string").coalesce(1)
    return first.union(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id"))


def fitted(docs, states=2, buckets=512):
    chunks = L.encode(docs, "doc_id < 0", buckets)
    return L.train(chunks, np.full(buckets, 1 / buckets), states, 2)


def test_states_part_when_the_first_chunk_trains_nothing(spark):
    model = fitted(topics(spark, [(-1, "held out " * 50)]))
    at = lambda t: [L.bucket_of(f"{t}{k}".encode(), 512) for k in range(40)]
    x, y = model.emit[at("x")].sum(axis=0), model.emit[at("y")].sum(axis=0)
    assert (x[0] - y[0]) * (x[1] - y[1]) < 0  # one state has more of x, the other of y


def test_the_model_does_not_depend_on_partitions(spark):
    one, other = (fitted(topics(spark, [(-1, "held")], n).repartition(n, "text")) for n in (1, 3))
    assert np.allclose(one.emit, other.emit) and np.allclose(one.move, other.move)
