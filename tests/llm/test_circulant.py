import random
import re

import numpy as np
import pytest

from keysweep.llm import circulant as M
from keysweep.llm.shingles import shingle_set

from edge import ROWS, frame, random_texts


def shingles(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(rows, percent=85):
    """Component of each doc_id by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in sets:
        for b, r in sets:
            if a < b and s and r and 100 * len(s & r) >= percent * len(s | r):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in sets}


def check(spark, rows):
    found = M.near_duplicates(frame(spark, rows)).collect()
    expected = brute(rows)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found if r["doc_id"] is not None) == sorted(
        (i, len(shingles(t)), expected[i], expected[i] == i) for i, t in rows if i is not None)
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    check(spark, random_texts(150, seed, words=120))


def test_edge_rows(spark):
    none = [r for r in check(spark, ROWS) if r["doc_id"] is None]
    assert [(r["component_id"], r["kept"]) for r in none] == [(None, True)]


def test_empty_table(spark):
    assert M.near_duplicates(frame(spark, [])).collect() == []


def test_documents_are_shuffled_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(M, "BROADCAST_KEYS", -1)
    check(spark, random_texts(60, 8, words=100))


def family(n, seed, same=70, own=30, words=3000):
    """Texts of one template, about 55 percent alike: they share buckets and never link."""
    r = random.Random(seed)
    base = [f"b{k}" for k in range(same)]
    return [(i, " ".join(base + [f"w{r.randrange(words)}" for _ in range(own)])) for i in range(n)]


def test_a_family_of_templates_is_not_paired(spark, monkeypatch):
    """Of 45,000 pairs of 300 texts of a template few get as far as a comparison of sets."""
    compared = []
    add = M._Links.add

    def counted(self, pairs, checked=False):
        n = len(self.paths)
        out = add(self, pairs, checked)
        compared.append(self.docs.sparkSession.read.parquet(self.paths[n]).count())
        return out

    monkeypatch.setattr(M._Links, "add", counted)
    rows = family(300, 5) + [(1000 + k, f"{t} end") for k, (_, t) in enumerate(family(300, 5)[:20])]
    check(spark, rows)
    assert sum(compared) < 500


def test_group_of_near_copies_that_link_in_chains(spark):
    """Every text differs from the next one by a word, and far ones don't link by themselves."""
    words = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(words)))
        words = words[:]
        words[(7 * i) % 150] = f"n{i}"
    assert {r["component_id"] for r in check(spark, rows)} == {0}


def test_signature_is_the_minimum_over_shifted_places():
    s = shingle_set(b"the quick brown fox jumps over the lazy dog again and again", 3)
    circle = M._circle()
    places = (M.mix(s ^ np.uint64(0x632BE59BD9B4E019)) & np.uint64(M.CIRCLE - 1)).astype(int)
    values = circle[:, 0]
    assert sorted(values.tolist()) == list(range(M.CIRCLE))  # a permutation
    got = M.signature(s)
    for k in (0, 1, 17, M.BANDS * M.ROWS - 1):
        assert got[k] == min(values[(p + k) % M.CIRCLE] for p in places)


def test_coordinates_estimate_the_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85, 0.95):
        alike = []
        for _ in range(30):
            n = 600
            both = rng.integers(0, 2**63, int(2 * n * share / (1 + share))).astype(np.uint64)
            a, b = (np.unique(np.concatenate((both, rng.integers(0, 2**63, n - len(both)).astype(np.uint64)))) for _ in range(2))
            alike.append(np.mean(M.signature(a) == M.signature(b)))
        assert abs(np.mean(alike) - share) < 0.02


def test_linked_sets_share_a_bucket():
    rng = np.random.default_rng(2)
    for n in (2, 7, 30, 300, 5000):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = a[:max(1, -(-len(a) * 85 // 100))]
            assert set(M.buckets(M.signature(a))) & set(M.buckets(M.signature(b)))
