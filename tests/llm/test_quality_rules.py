import duckdb
import pytest

from keysweep.llm import quality_rules as Q
from keysweep.llm.common import read

from conftest import SF_SMALL
from edge import ROWS, frame, random_texts

NAV = "Home | About | Contact | Jobs | Press\n"
PROSE = " ".join(f"Sentence {k} has word{k} of its{k} own{k}." for k in range(20)) + "\n"


def rows_of(spark, rows):
    got = Q.clean(frame(spark, rows)).select(*Q.RESULT, "text").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    names = [*Q.RESULT, "text"]
    expected = con.execute(f"WITH {Q._sql('documents')} SELECT {', '.join(names)} FROM judged").fetchall()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)
    return [r.asDict() for r in got]


def test_edge_rows_match_sql(spark):
    rows_of(spark, ROWS)


def test_random_texts_match_sql(spark):
    rows_of(spark, random_texts(60, 1) + [(900, NAV * 5 + PROSE), (901, PROSE), (902, NAV * 30)])


def test_empty_table(spark):
    assert rows_of(spark, []) == []


def test_lines_go_before_documents(spark):
    got = {r["doc_id"]: r for r in rows_of(spark, [(1, NAV + PROSE + "All rights reserved.\n"), (2, NAV * 40 + PROSE)])}
    assert got[1]["kept"] and got[1]["text"] == PROSE.rstrip("\n") and got[1]["n_failed_lines"] == 2
    assert not got[2]["kept"]


def test_filter_on_the_verdict_stays_above_the_array_functions(spark):
    plan = Q.clean(frame(spark)).where("kept")._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line and "lambda" in line]
    assert not filters


def test_native_and_without_shuffle(spark):
    plan = Q.op2_quality_rules(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Exchange", "Python", "Arrow", "Pandas"))


def test_labelled_documents(spark):
    """Held against the given labels: clean documents stay, junk goes."""
    judged = Q.op2_quality_rules(spark, SF_SMALL).join(read(spark, SF_SMALL, "labels"), "doc_id").where("not base_failed").toPandas()
    assert judged[judged.quality == 1].kept.mean() > 0.98
    assert judged[judged.quality == 0].kept.mean() < 0.1


@pytest.mark.parametrize("text,n", [("a b c a b c", 6), ("a b c d", 0), ("a a a a", 4), ("a b c x a b c d", 6), ("a b", 0)])
def test_words_in_repeated_windows(spark, text, n):
    assert Q.clean(frame(spark, [(1, text)])).first()["n_repeat_words"] == n
