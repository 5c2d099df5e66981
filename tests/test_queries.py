"""Every registered query against its SQL on the smallest tables, and what plans must not hold."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows
from workloads import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name", ["stream_dedup", "stream_skill_demand", "stream_late"])
def test_streams_read_tables_that_are_folders_of_parts(spark, db, name, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES[name](spark, str(tmp_path))
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(ORACLE[name])
    assert got and got == rows([d[0] for d in cursor.description], cursor.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["section", "rank", "key", "value"] and df.count() > 0
