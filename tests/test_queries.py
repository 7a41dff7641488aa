"""Every registered query that has SQL gives the rows of that SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from quillstream.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canonical(frame, columns):
    def value(v):
        if pd.isna(v):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    rows = frame[columns].astype(object).itertuples(index=False)
    return sorted(str(tuple(value(v) for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, db, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = db.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got, sorted(got.columns)) == canonical(want, sorted(want.columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
