"""Every registered query of the engine against its SQL, over the smallest tables."""

import glob
import numbers
import os

import duckdb
import pandas as pd
import pytest

from numerail import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


def text_of(v):
    if v is None or pd.isna(v):
        return "null"
    return str(float(v)) if isinstance(v, numbers.Real) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), db.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda d: sorted(tuple(text_of(v) for v in r) for r in d[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_digits_of_e(spark):
    text = "".join(r["text"] for r in registry.queries()["e_digits"](spark, SF).orderBy("chunk_no").collect())
    assert len(text) == 151 and text.startswith("2718281828459045235360287471352662497757247093699959574966967627724076630353")


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
