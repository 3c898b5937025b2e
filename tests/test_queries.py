"""Each query with SQL gives the rows that DuckDB gives for it."""

import math

import duckdb
import pytest

from corpusloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
        return None
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


def _rows(frame):
    names = sorted(frame.columns)
    return names, sorted([tuple(map(_plain, r)) for r in frame[names].itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    assert _rows(catalog.queries()[name](spark, SF).toPandas()) == _rows(duck.sql(catalog.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
