"""The registered queries against DuckDB on the smallest data, and the entry itself."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corvane.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLE) <= set(QUERIES) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    r = duck.execute(ORACLE[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)

    def rows(columns, each):
        at = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(repr(tuple("nan" if isinstance(x[i], float) and math.isnan(x[i]) else x[i] for i in at)) for x in each)

    assert rows(df.columns, got) == rows(names, r.fetchall())
