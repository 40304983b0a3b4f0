"""Every registered query of the vector engine against its SQL, and the entry point."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from quiverlake.plans import catalog

SF = "/root/testdata/sf0.01"
TABLES = sorted(x.removesuffix(".parquet") for x in os.listdir(SF)) if os.path.isdir(SF) else []
pytestmark = pytest.mark.skipif(not TABLES, reason="no test tables")


def rows(df):
    def plain(x):
        return round(float(x), 9) if isinstance(x, float) else None if x != x else x

    return sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
