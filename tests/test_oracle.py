"""Every job with a SQL twin must equal DuckDB on the small fixture."""
import os

import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, rows_of

NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, sf, duck, name):
    df = E.queries()[name](spark, sf)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    res = duck.sql(E.oracle_sql()[name])
    dcols, drows = res.columns, res.fetchall()
    assert sorted(cols) == sorted(dcols)
    assert len(rows) == len(drows)
    assert rows_of(cols, rows) == rows_of(dcols, drows)


def test_every_oracle_has_a_job():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["user_idx", "rank", "item_idx", "score"]
