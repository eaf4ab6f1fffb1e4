import pytest

from tracewright.operators import wires as W
from tracewright.plans.registry import Tables


@pytest.mark.parametrize("n,broadcast", [(10, True), (400_000, False)])
def test_only_few_rows_are_broadcast(spark, tmp_path, n, broadcast):
    """A table of many rows that packs into a small file is not sent through the driver."""
    spark.range(n).selectExpr("id div 10 AS sheet_id", "id % 10 AS id", "id % 3 AS s_x", "id % 4 AS s_y", "id % 5 AS e_x", "id % 6 AS e_y").coalesce(1).write.parquet(f"{tmp_path}/lines.parquet")
    spark.range(1_000_000).selectExpr("id div 50 AS sheet_id", "id % 7 AS x", "id % 9 AS y").write.parquet(f"{tmp_path}/spots.parquet")
    t = Tables(spark, str(tmp_path))
    near = W.covered_by_points(t("lines"), t("spots"), 4.0)
    plan = near._jdf.queryExecution().sparkPlan().toString()
    assert ("BroadcastHashJoin" in plan) == broadcast
