"""Every registered query against its SQL, and the driver contract."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
import checks

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(checks.QUERIES))
def test_query(spark, tables, name):
    frame = entry_point.queries()[name](spark, FOLDER)
    cursor = tables.execute(entry_point.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    got = comparable([tuple(r) for r in frame.collect()], frame.columns)
    assert got == comparable(cursor.fetchall(), columns)
    assert got


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


def test_no_cross_joins(spark):
    for name, run in checks.QUERIES.items():
        plan = run(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
