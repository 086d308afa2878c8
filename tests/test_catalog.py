"""Every query with SQL gives the SQL's rows on the smallest driver tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point

from .conftest import SF_SMALL

SQL = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_SMALL}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5)
    return value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, oracle, name):
    got = entry_point.queries()[name](spark, SF_SMALL)
    columns = sorted(got.columns)
    cursor = oracle.execute(SQL[name])
    assert sorted(c[0] for c in cursor.description) == columns
    order = [[c[0] for c in cursor.description].index(n) for n in columns]
    expected = sorted(tuple(comparable(r[k]) for k in order) for r in cursor.fetchall())
    found = sorted(tuple(comparable(v) for v in r) for r in got.select(*columns).collect())
    assert len(found) == len(expected) > 0 or name == "label_check"
    for f, e in zip(found, expected):
        assert f == pytest.approx(e, abs=2e-5) if all(isinstance(v, (int, float)) for v in e) else f == e


def test_entry_runs(spark):
    assert entry_point.entry(spark).count() == 1


def test_every_query_with_sql_is_registered():
    assert set(SQL) <= set(entry_point.queries())
