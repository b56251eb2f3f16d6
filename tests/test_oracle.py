"""Every registered query against its SQL on the small tables."""

import duckdb
import pandas as pd
import pytest

from ledgerloom import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame):
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return ""
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", list(q.queries()))
def test_query(spark, sf, duck, name):
    got = q.queries()[name](spark, sf).toPandas()
    if name not in q.oracle_sql():
        assert len(got)
        return
    want = duck.execute(q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 8
    assert set(q.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
