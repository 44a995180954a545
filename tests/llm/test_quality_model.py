import numpy as np

from keysweep.llm import quality_model as M
from keysweep.llm.common import read

from conftest import SF_SMALL
from edge import ROWS, frame

SF = SF_SMALL.replace("sf0.001", "sf0.01")


def test_held_out_labels(spark):
    """No label is used in training: all of them are held out."""
    judged = M.op6_quality_classifier(spark, SF).join(read(spark, SF, "labels"), "doc_id").toPandas()
    assert judged[judged.quality == 1].kept.mean() > 0.98
    assert judged[judged.quality == 0].kept.mean() < 0.1


def test_estimate_finds_the_accuracies():
    rng = np.random.default_rng(2)
    n = len(M.LABELLERS)
    good = rng.random(4000) < 0.85
    rates = np.where(M.SIDES > 0, np.array([[0.2], [0.9]]), np.array([[0.5], [0.03]]))
    counts: dict = {}
    truth: dict = {}
    for g in good:
        p = M.pattern(tuple((rng.random(n) < rates[int(g)]).astype(int)), 500)
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, []).append(g)
    prior, found, posterior = M.estimate(counts)
    assert abs(prior - 0.85) < 0.03 and np.abs(found - rates).max() < 0.08
    right = sum(sum(g == (posterior[p] > 0.5) for g in gs) for p, gs in truth.items())
    assert right > 0.97 * 4000


def test_edge_rows(spark):
    got = M.classify(frame(spark), keep=("key",)).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["kept"] == (r["score"] >= 0.5) for r in got)
    assert {r["key"] for r in got} == {1}
    same = {r["score"] for r in got if r["doc_id"] == 5}
    assert len(same) == 1


def test_empty_table(spark):
    assert M.classify(frame(spark, [])).collect() == []
    assert M.estimate({})[2] == {}


def test_scorer_does_not_depend_on_how_rows_are_dealt(spark):
    docs = read(spark, SF_SMALL, "documents")
    a = {r["doc_id"]: r["score"] for r in M.classify(docs.coalesce(1)).collect()}
    b = {r["doc_id"]: r["score"] for r in M.classify(docs.repartition(5)).collect()}
    assert a == b
