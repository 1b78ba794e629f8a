"""Every registered query with SQL against that SQL, and the shape of all plans."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from check_sql import compare, connect

QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def connection(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, folder, connection, name):
    df = QUERIES[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert compare(df.columns, df.collect(), connection, ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_gives_a_report(spark):
    rows = {r["label"]: r for r in driver.entry(spark).collect()}
    assert {"accuracy", "macro avg", "weighted avg"} <= set(rows)
    assert rows["accuracy"]["support"] == sum(r["support"] for k, r in rows.items() if k.isdigit())


def test_scan_reads_only_what_is_needed(spark, folder):
    plan = QUERIES["a16_group_measures"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_returnflag:string>" in plan
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    filtered = QUERIES["p17_value_filters"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_type,ECONOMY)" in filtered
