"""Every registered query of the store against its DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tidemark.oracle import ORACLE_SQL
from tidemark.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(frame, columns):
    plain = lambda x: None if pd.isna(x) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted(str([plain(x) for x in r]) for r in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and len(ours)
    assert rows(ours, columns) == rows(theirs, columns)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_snapshot_filter_reaches_the_scan(spark, tmp_path):
    from tidemark.operators.mvcc import snapshot_read
    from tidemark.plans.histories import serial_versions

    path = str(tmp_path / "versions")
    serial_versions(spark, SF).write.mode("overwrite").parquet(path)
    plan = snapshot_read(spark.read.parquet(path), 500)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(commit_ts,500)" in plan and "tx_id" not in plan.split("ReadSchema")[1]
