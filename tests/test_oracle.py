"""Every registered query against its DuckDB oracle at sf0.001 (the driver checks sf0.01)."""

import math

import duckdb
import pytest

from keysweep.plans import registry
from keysweep.sources.tables import GIVEN_TABLES

from conftest import SF_SMALL


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in GIVEN_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_oracle(spark, con, name):
    sdf = registry.SPARK[name](spark, SF_SMALL)
    scols = sdf.columns
    srows = sorted(tuple(_norm(r[c]) for c in sorted(scols)) for r in sdf.collect())
    res = con.execute(registry.ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(dcols) == sorted(scols)
    idx = [dcols.index(c) for c in sorted(dcols)]
    drows = sorted(tuple(_norm(r[i]) for i in idx) for r in res.fetchall())
    assert srows == drows


def test_every_query_has_oracle_or_is_documented():
    assert set(registry.SPARK) == set(registry.ORACLE)
