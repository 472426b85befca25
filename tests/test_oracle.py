"""Every query of the camera part against its SQL check (DuckDB) at sf0.001."""


import duckdb
import pytest

import __spark_entry__ as E
from sightline.plans.oracle import ORACLE
from sightline.plans.queries import QUERIES

from .conftest import SF_SMALL

TABLES = ["events", "embeddings"]


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_sql(spark, con, key):
    df = E.queries()[key](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.sql(E.oracle_sql()[key])
    assert sorted(rel.columns) == cols
    exp = sorted((tuple(_norm(dict(zip(rel.columns, r))[c]) for c in cols) for r in rel.fetchall()), key=repr)
    assert got == exp


def test_every_query_has_a_check():
    assert set(ORACLE) == set(QUERIES) and set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "prediction" in df.columns
