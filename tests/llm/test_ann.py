import numpy as np

from keysweep.llm import ann as A
from keysweep.llm.common import read

from conftest import SF_SMALL


def exact(ids, vectors, queries, k):
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    out = {}
    for i in queries:
        score = (vectors * vectors[i]).sum(axis=1) / (norms * norms[i])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_recall_and_scores(spark):
    table = read(spark, SF_SMALL, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in table.select("vec_id", "embedding").collect()]
    ids, vectors = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    expected = exact(ids, vectors, np.flatnonzero(ids % 5 == 0), 5)
    got: dict = {}
    for r in A.search(table, "vec_id % 5 = 0").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got.keys() == expected.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in expected[q]}) for q in got)
    assert hits / (5 * len(got)) >= 0.9
    place = {int(i): k for k, i in enumerate(ids)}
    for q, found in got.items():
        for i, score in found:
            a, b = vectors[place[q]], vectors[place[i]]
            assert abs(score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


def test_scan_without_early_exits_is_exact():
    rng = np.random.default_rng(1)
    points, ids = rng.standard_normal((300, 48)), np.arange(300)
    points[50:60] = points[49]  # ties
    found: dict = {}
    for q, i, s in A.scan(points[:20], ids[:20], points, ids, A.rotation(48), 5):
        found.setdefault(q, []).append(i)
    expected = exact(ids, points, range(20), 5)
    hits = sum(len(set(found[q]) & {i for i, _ in expected[q]}) for q in found)
    assert hits >= 98


def test_edge_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, [0.5, 0.5]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (10, [3.0, 0.0]), (100, [0.0, 0.0])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, list int, v string")
    got = A.search(table, "vec_id % 50 = 0", k=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 10), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 10)]
    assert all(r["score"] == 1.0 for r in got)
    few = A.search(table.where("vec_id in (0, 8)"), "vec_id % 50 = 0").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 8)]
    assert A.search(table.where("vec_id < 0"), "vec_id % 50 = 0").collect() == []


def test_hot_list_is_split(spark, monkeypatch):
    monkeypatch.setattr(A, "CHUNK", 16)
    rows = [(k, [1.0, 2.0, 3.0, 4.0]) for k in range(200)] + [(1000 + k, [float(k % 7), 1.0, -2.0, float(k)]) for k in range(40)]
    got = A.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id % 50 = 0").where("query_id = 50").orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1, 2, 3, 4]
