"""Cells of answers are judged by many tasks, however small the file of their rows."""

import pytest
from pyspark.sql import functions as F

from questloom.plans import q_verify  # noqa: F401 - defines the tables
from questloom.plans.registry import Tables


@pytest.mark.parametrize("name", ["messy_cells", "check_cells"])
def test_cells_are_dealt_over_tasks(spark, tmp_path, name):
    rows = spark.range(4000).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "CAST(id % 25 AS INT) AS c_nationkey", "id / 7D AS c_acctbal", "'BUILDING' AS c_mktsegment")
    rows.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(3).selectExpr("id AS s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    cells = Tables(spark, str(tmp_path)).load(name)
    parts = cells.filter("row_idx > 0").groupBy(F.spark_partition_id().alias("p")).count()
    most, total = parts.agg(F.max("count"), F.sum("count")).first()
    assert most <= total / 8
    assert cells.filter("task_id < 1000000").select("row_idx").distinct().count() == 4000
