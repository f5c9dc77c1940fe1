"""Every registered query gives the rows of its SQL twin."""

import glob
import math
import os

import duckdb
import pytest

from planline.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    ours = QUERIES[name](spark, SF)
    columns = sorted(ours.columns)
    cursor = duck.execute(SQL[name])
    theirs_columns = [c[0] for c in cursor.description]
    assert sorted(theirs_columns) == columns
    order = [theirs_columns.index(c) for c in columns]
    theirs = sorted(repr(tuple(plain(r[k]) for k in order)) for r in cursor.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in ours.collect()) == theirs


def test_every_query_without_sql_runs(spark):
    for name in set(QUERIES) - set(SQL):
        QUERIES[name](spark, SF).count()
