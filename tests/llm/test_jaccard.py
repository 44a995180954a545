import re

import pytest

from keysweep.llm import jaccard as J
from keysweep.llm.components import components

from edge import ROWS, frame, random_texts


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4)))


def brute(rows, percent=80):
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


def check(spark, rows, percent=80):
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in J.join(frame(spark, rows), percent=percent).collect()
                 if r["doc_id"] is not None)
    expected = brute(rows, percent)
    assert got == sorted((i or -1, len(shingles(t)), expected[i]) for i, t in rows if i is not None)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    check(spark, random_texts(150, seed, words=90))


def test_lower_threshold(spark):
    check(spark, random_texts(80, 4), percent=60)


def test_edge_rows(spark):
    check(spark, ROWS)
    assert [r["component_id"] for r in J.join(frame(spark)).where("doc_id is null").collect()] == [None]


def test_documents_are_shuffled_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_KEYS", -1)
    check(spark, random_texts(60, 8))


def test_a_part_of_the_maps_can_decide(spark):
    """A first part that differs too much is enough, and what all parts let through is what the whole maps do."""
    import random
    rng, words = random.Random(5), J.MAP_WORDS
    rows = [(10, [-1] * (words // 4), 11, [0] * (words // 4))]  # nothing behind the first part
    for _ in range(200):
        x = [rng.getrandbits(63) for _ in range(words)]
        y = [v ^ (rng.getrandbits(63) & rng.getrandbits(63) if rng.random() < 0.3 else 0) for v in x]
        rows.append((rng.randint(500, 1500), x, rng.randint(500, 1500), y))
    pairs = spark.createDataFrame([((n, x), (m, y)) for n, x, m, y in rows],
                                  "x struct<n: int, map: array<long>>, y struct<n: int, map: array<long>>")
    got = [r[0] for r in pairs.select(J._may_link("x", "y", 80)).collect()]
    assert got[0] is False
    expected = [100 * n >= 80 * m and 100 * m >= 80 * n and sum((v ^ w).bit_count() for v, w in zip(x, y)) <= (n + m) * 20 // 180
                for n, x, m, y in rows[1:]]
    assert got[1:] == expected and len(set(expected)) == 2


def test_map_condition_is_short_code(spark):
    """Written out word by word, it was too long for the JVM to compile."""
    sides = spark.createDataFrame([(5, [1] * J.MAP_WORDS)], "n int, map array<long>")
    pairs = sides.alias("x").crossJoin(sides.alias("y")).select(J._may_link("x", "y", 80).alias("may"))
    assert str(pairs._jdf.queryExecution().analyzed()).count("bit_count") == 1 and pairs.collect() == [(True,)]


def test_components_in_few_parts(spark, monkeypatch):
    """Parts and repeated edges change nothing: a chain, a star, a ring, a loop and a pair given twice."""
    from keysweep.llm import components as C
    edges = ([(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
             + [(300, 300), (401, 400), (400, 401)])
    expected = ({i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {200 + i: 200 for i in range(9)} | {400: 400, 401: 400})
    frame_ = spark.createDataFrame(edges, "a long, b long").repartition(30)
    for least in (1, 8):
        monkeypatch.setattr(C, "LEAST_PARTS", least)
        found = C.components(frame_)
        assert sorted(map(tuple, found.collect())) == sorted(expected.items())


def test_few_rows_are_written_in_few_files(spark, monkeypatch):
    """However many partitions a shuffle has (F1): only the signatures keep them."""
    frames, parts = type(spark.range(0)), {}
    keep, point = J.materialize, frames.checkpoint

    def written(df, name, *more):
        table = keep(df, name, *more)
        parts.setdefault(name, []).append(len(table.inputFiles()))
        return table

    def checkpointed(df, *more):
        out = point(df, *more)
        parts.setdefault("steps", []).append(out.rdd.getNumPartitions())
        return out

    monkeypatch.setattr(J, "materialize", written)
    monkeypatch.setattr(frames, "checkpoint", checkpointed)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        check(spark, random_texts(150, 1, words=90))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(parts.pop("jaccard-signatures")) > 8
    assert {"jaccard-classes", "jaccard-links", "jaccard-components", "steps"} <= set(parts)
    assert {k: v for k, v in parts.items() if max(v) > 8} == {}


def test_empty_table(spark):
    assert J.join(frame(spark, [])).collect() == []


def test_every_linked_pair_shares_an_asking_signature():
    """The pigeonhole: whatever the smaller set, one of the pair asks under a signature that the other is indexed under."""
    import numpy as np
    from keysweep.llm.shingles import mix
    rng, bands = np.random.default_rng(3), J.Bands(80)
    for _ in range(400):
        n = int(rng.integers(2, 120))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = a[rng.random(len(a)) > rng.choice([0.02, 0.1, 0.2])]
        b = np.unique(np.concatenate((b, rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 8))).astype(np.uint64))))
        common = len(np.intersect1d(a, b))
        if not len(b) or 100 * common < 80 * (len(a) + len(b) - common) or np.array_equal(a, b):
            continue
        rows = []
        for s in (a, b):
            mixed = mix(s)
            sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mixed, dtype=np.uint64)))
            own, mine = bands.of(len(s)), {}
            for band in (own, own - 1):
                if band < 0 or (m := bands.segments(band)) == 1:
                    continue
                partner = min(bands.high[band], len(s) * 100 // 80)
                if band < own and partner * 100 < len(s) * 80:
                    continue
                sigs, asks = J.signatures(s, sums, mixed, band, m, J.most_apart(len(s), partner, 80) + 1, band == own)
                for sig, ask in zip(sigs.tolist(), asks.tolist()):
                    mine[sig] = mine.get(sig, False) or ask
            rows.append(mine)
        assert any(sig in rows[1] and (ask or rows[1][sig]) for sig, ask in rows[0].items())


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (7, 7), (100, 101)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
