"""Shapes of physical plans that matter at scale."""

import pytest
from pyspark.sql import functions as F

from paramloom.operators import grid, history
from paramloom.plans import QUERIES
from paramloom.plans import fixtures as fx

EAGER = ("st_", "run_train", "ml_train", "train_")


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(k for k in QUERIES if not k.startswith(EAGER)))
def test_no_cross_join_and_no_row_wise_python(spark, sf_dir, key):
    plan = plan_of(QUERIES[key](spark, sf_dir))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan.replace("ArrowEvalPython", "")


def test_sweep_pushes_its_limits_into_the_scan(spark, sf_dir):
    plan = plan_of(QUERIES["run_sweep_agg"](spark, sf_dir))
    assert "LessThanOrEqual(l_discount,0.08)" in plan
    assert "LessThan(l_quantity,40.0)" in plan
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double>" in plan


def test_tail_limits_rows_before_the_shuffle(spark, sf_dir):
    plan = plan_of(history.tail(fx.fx_log_line(spark, sf_dir)))
    assert plan.count("WindowGroupLimit") == 2


def test_kfold_reads_no_text(spark, sf_dir):
    assert "text:string" not in plan_of(QUERIES["run_kfold_metric"](spark, sf_dir))


def test_grid_of_constants_has_no_shuffle(spark):
    swept = grid.grid_range(spark, {"a": list(range(100)), "b": list(range(100))})
    assert "Exchange" not in plan_of(swept.where(F.col("a") == 3))


def test_hot_spec_is_spread(spark):
    """One spec with all combinations does not end up in one task."""
    values = spark.createDataFrame(
        [("s", i, f"p{i}", "list", [str(v) for v in range(10)]) for i in range(5)],
        "spec_id string, ord int, param string, kind string, values array<string>")
    sizes = grid.grid(values, block=1000).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 100_000
    assert len(sizes) == 4
    assert max(r["count"] for r in sizes) < 50_000
