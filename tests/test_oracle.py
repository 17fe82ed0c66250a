"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
import os
from decimal import Decimal
from glob import glob

import duckdb
import pytest

from wayline.plans import movement, results, segments  # noqa: F401
from wayline.registry import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")


def shown(v):
    if isinstance(v, float | Decimal):
        return "NaN" if math.isnan(v) else repr(round(float(v), 9) + 0.0)
    return "[" + ",".join(map(shown, v)) + "]" if isinstance(v, list | tuple) else repr(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cursor = duck.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    theirs = sorted("|".join(shown(r[columns.index(c)]) for c in sorted(columns)) for r in cursor.fetchall())
    assert sorted("|".join(shown(r[c]) for c in sorted(columns)) for r in df.collect()) == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0
