"""Every registered query against its check SQL on the smallest tables, and plan rules."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    kinds = {d[0]: str(d[1]) for d in cur.description}
    assert {f.name: check.SAME.get(f.dataType.simpleString()) for f in df.schema} == kinds
    assert check.rows_of(df.columns, [tuple(r) for r in df.collect()]) == check.rows_of(cols, cur.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["average_precision_a10", "iou_pairs_j06_p02", "nets_g01", "overlines_o05", "connector_attach_j11_u09", "nearest_node_j20"])
def test_no_cartesian_product(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = entry.queries()["newest_entries_f06"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,error)" in plan and "props" not in plan
