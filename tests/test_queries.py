"""Registered queries against their SQL in DuckDB, on the smallest data."""

import duckdb
import pandas as pd
import pytest

from docloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(frame, columns):
    def text(v):
        if v is None or pd.isna(v):
            return "null"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(text(v) for v in row) for row in frame[columns].astype(object).to_numpy().tolist())


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, db, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = db.sql(catalogue.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert canonical(got, columns) == canonical(want, columns)
