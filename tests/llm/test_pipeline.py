import duckdb

import corpus_pipeline as P
from keysweep.llm import quality_rules as Q
from keysweep.llm.common import materialize, read

from conftest import SF_SMALL
from edge import ROWS
from test_jaccard import brute as components_of
from test_packing import check as check_packing
from test_suffix_dedup import brute as removed_from

TYPES = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], TYPES)


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_every_stage_against_brute_force(spark):
    docs = read(spark, SF_SMALL, "documents")
    stages = dict(P.STAGES)
    assert [k for k, _ in P.STAGES] == ["quality classifier", "quality rules", "n-gram Jaccard join", "suffix-array dedup", "packing"]

    kept = materialize(stages["quality classifier"](spark, docs, SF_SMALL), "t")
    assert kept.columns == P.COLUMNS and kept.exceptAll(docs.select(P.COLUMNS)).isEmpty()
    labels = {r["doc_id"]: r["quality"] for r in read(spark, SF_SMALL, "labels").collect()}
    left = {r["doc_id"] for r in kept.collect()}
    assert sum(i in left for i, q in labels.items() if q == 1) >= 0.98 * sum(q == 1 for q in labels.values())
    assert sum(i in left for i, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values())

    ruled = materialize(stages["quality rules"](spark, kept, SF_SMALL), "t")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", pairs(kept))
    assert pairs(ruled) == sorted(con.execute(f"WITH {Q._sql('documents')} SELECT doc_id, text FROM judged WHERE kept").fetchall())

    single = materialize(stages["n-gram Jaccard join"](spark, ruled, SF_SMALL), "t")
    before = pairs(ruled)
    component = components_of(before)
    assert pairs(single) == [(i, t) for i, t in before if component[i] == i]

    cut = materialize(stages["suffix-array dedup"](spark, single, SF_SMALL), "t")
    removed = removed_from(pairs(single), 100)
    sizes = {r["doc_id"]: len(r["text"].encode()) for r in cut.collect()}
    for (i, data), (n, gone, _, _) in removed.items():
        assert n - gone - 6 <= sizes[i] <= n - gone  # less what is left of cut characters
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    packed = P.pack(cut).collect()
    check_packing(packed, dict(pairs(cut)), 2048)
    assert len(packed) == stages["packing"](spark, cut, SF_SMALL).count()


def test_run_is_the_stages_one_after_the_other(spark):
    rows = P.run(spark, SF_SMALL)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 0


def test_edge_rows(spark):
    docs = table(spark, ROWS)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF_SMALL).collect() is not None
        assert stage(spark, table(spark, []), SF_SMALL).collect() == []
    twice = table(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")])
    assert pairs(P.jaccard_join(spark, twice, SF_SMALL)) == [(None, "a b c d e f"), (1, "a b c d e f")]


def test_rows_that_share_a_doc_id_are_judged_one_by_one(spark):
    a = " ".join(f"a{k}" for k in range(40))
    near = a + " z"
    b, c = a.replace("a", "b"), near.replace("a", "b").replace("z", "y")
    other = a.replace("a", "o")

    def left(*rows):
        return pairs(P.jaccard_join(spark, table(spark, rows), SF_SMALL))

    assert left((1, a), (2, near), (2, b)) == [(1, a), (2, b)]
    assert left((1, a), (2, near), (2, b), (3, c)) == [(1, a), (2, b)]
    assert left((5, a), (5, near)) in ([(5, a)], [(5, near)])
    # two components with the same smallest doc_id; a third that is linked with neither
    assert left((5, a), (5, b), (6, near), (6, c), (6, other)) == [(5, a), (5, b), (6, other)]
    assert left((5, ""), (5, ""), (5, " "), (5, a), (5, a), (None, a), (None, a)) == [
        (None, a), (None, a), (5, ""), (5, " "), (5, a)]
