"""Queries that run work per combination."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from paramloom.operators import folds, grid, specs, tasks
from paramloom.operators.sweep import (Measure, Threshold, parameter_sweep, predicate_sweep,
                                       threshold_sweep)
from paramloom.plans import fixtures as fx
from paramloom.plans.parameter_space import fx_grid
from paramloom.plans.registry import query, table
from paramloom.session import work_path
from paramloom.sources.specs import read_specs

DISCOUNTS = [0.02, 0.05, 0.08, -1.0]
QUANTITIES = [10.0, 25.0, 40.0, 0.0]


def sweep_over_lineitem(spark, sf_dir, discounts, quantities):
    """Number of items and revenue per (discount limit, quantity limit)."""
    facts = table(spark, sf_dir, "lineitem")
    swept = threshold_sweep(
        facts,
        {"d": Threshold(F.col("l_discount"), "<=", discounts),
         "q": Threshold(F.col("l_quantity"), "<", quantities)},
        {"n": Measure("count"),
         "revenue": Measure("sum", F.col("l_extendedprice") * (1 - F.col("l_discount")))})
    return swept.withColumn("revenue", F.round("revenue", 2))


@query("run_sweep_agg", """
    WITH grid AS (
        SELECT row_number() OVER () - 1 AS combo_id, d, q FROM (
            SELECT d, q FROM (SELECT unnest([0.02, 0.05, 0.08, -1.0]) AS d,
                                     unnest([0, 1, 2, 3]) AS i),
                             (SELECT unnest([10.0, 25.0, 40.0, 0.0]) AS q,
                                     unnest([0, 1, 2, 3]) AS j)
            ORDER BY i, j))
    SELECT combo_id, cast(d AS double) AS d, cast(q AS double) AS q, count(l_orderkey) AS n,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM grid LEFT JOIN lineitem ON l_discount <= cast(d AS double) AND l_quantity < q
    GROUP BY combo_id, d, q
""")
def run_sweep_agg(spark, sf_dir):
    return sweep_over_lineitem(spark, sf_dir, DISCOUNTS, QUANTITIES)


@query("run_sweep_mixed", """
    WITH grid AS (
        SELECT cast((a.i * 2 + b.i) * 3 + c.i AS bigint) AS combo_id, a.v AS flag, b.v AS size, c.v AS tax
        FROM (SELECT unnest([0, 1]) AS i, unnest(['A', 'R']) AS v) a,
             (SELECT unnest([0, 1]) AS i, unnest([30.0, 10.0]) AS v) b,
             (SELECT unnest([0, 1, 2]) AS i, unnest([0.05, 0.01, 0.03]) AS v) c)
    SELECT combo_id, flag, cast(size AS double) AS size, cast(tax AS double) AS tax,
           count(l_orderkey) AS n, min(l_extendedprice) AS lowest,
           max(l_extendedprice) AS highest, round(avg(l_extendedprice), 4) AS mean
    FROM grid LEFT JOIN lineitem
         ON l_returnflag = flag AND l_quantity >= size AND l_tax > cast(tax AS double)
    GROUP BY ALL
""")
def run_sweep_mixed(spark, sf_dir):
    """Equality, lower limits and every kind of measure."""
    price = F.col("l_extendedprice")
    swept = threshold_sweep(
        table(spark, sf_dir, "lineitem"),
        {"flag": Threshold(F.col("l_returnflag"), "=", ["A", "R"]),
         "size": Threshold(F.col("l_quantity"), ">=", [30.0, 10.0]),
         "tax": Threshold(F.col("l_tax"), ">", [0.05, 0.01, 0.03])},
        {"n": Measure("count"), "lowest": Measure("min", price),
         "highest": Measure("max", price), "mean": Measure("avg", price)})
    return swept.withColumn("mean", F.round("mean", 4))


@query("run_sweep_predicate", """
    WITH grid AS (SELECT i AS combo_id, 2 + i % 5 AS m, i // 5 AS r FROM range(0, 10) g(i))
    SELECT combo_id, count(*) AS n, round(sum(l_extendedprice), 2) AS price
    FROM grid JOIN lineitem ON (l_partkey + l_suppkey) % m = r GROUP BY combo_id
""")
def run_sweep_predicate(spark, sf_dir):
    """Conditions that are no thresholds."""
    combinations = [{"m": 2 + i % 5, "r": i // 5} for i in range(10)]
    swept = predicate_sweep(
        table(spark, sf_dir, "lineitem"), combinations,
        lambda c: (F.col("l_partkey") + F.col("l_suppkey")) % c["m"] == c["r"],
        {"n": Measure("count"), "price": Measure("sum", F.col("l_extendedprice"))})
    return swept.withColumn("price", F.round("price", 2))


SWEEP_FILE = """# spec sweep
l_discount: [0.02, 0.05, 0.08]
l_quantity: !!python/tuple [10, 45, 15]
"""


@query("run_sweep_from_spec", """
    SELECT cast(a.i * 3 + b.i AS bigint) AS combo_id, count(l_orderkey) AS n,
           round(sum(l_extendedprice), 2) AS price
    FROM (SELECT unnest([0, 1, 2]) AS i, unnest([0.02, 0.05, 0.08]) AS v) a
         CROSS JOIN (SELECT unnest([0, 1, 2]) AS i, unnest([10, 25, 40]) AS v) b
         LEFT JOIN lineitem ON l_discount <= cast(a.v AS double) AND l_quantity < b.v
    GROUP BY ALL
""")
def run_sweep_from_spec(spark, sf_dir):
    """From a parameter file to its combinations to a sweep of the table."""
    path = work_path(spark, "sweep-spec")
    spark.createDataFrame([(SWEEP_FILE,)], "value string").write.text(path)
    combinations = grid.grid(specs.param_dimensions(read_specs(spark, path)))
    swept = parameter_sweep(
        table(spark, sf_dir, "lineitem"), combinations,
        {"l_discount": lambda v: F.col("l_discount") <= float(v),
         "l_quantity": lambda v: F.col("l_quantity") < float(v)},
        {"n": Measure("count"), "price": Measure("sum", F.col("l_extendedprice"))})
    return swept.select("combo_id", "n", F.round("price", 2).alias("price"))


WIDE_SWEEP_FILE = """# spec wide
divisor: !!python/tuple [2, 102, 1]
part: !!python/tuple [0, 100, 1]
"""


@query("run_sweep_wide", """
    SELECT cast(a.d * 100 + b.p AS bigint) AS combo_id, count(l_orderkey) AS n,
           round(sum(l_extendedprice), 2) AS price, max(l_quantity) AS most
    FROM range(0, 100) a(d) CROSS JOIN range(0, 100) b(p)
         LEFT JOIN lineitem
         ON l_partkey % 100 = b.p AND (l_orderkey + l_linenumber) % (a.d + 2) = 0
    GROUP BY ALL
""")
def run_sweep_wide(spark, sf_dir):
    """10,000 combinations of conditions that are no thresholds, in one scan."""
    path = work_path(spark, "wide-spec")
    spark.createDataFrame([(WIDE_SWEEP_FILE,)], "value string").write.text(path)
    combinations = grid.grid(specs.param_dimensions(read_specs(spark, path)))
    swept = parameter_sweep(
        table(spark, sf_dir, "lineitem"), combinations,
        {"divisor": lambda v: (F.col("l_orderkey") + F.col("l_linenumber")) % int(v) == 0,
         "part": lambda v: F.col("l_partkey") % 100 == int(v)},
        {"n": Measure("count"), "price": Measure("sum", F.col("l_extendedprice")),
         "most": Measure("max", F.col("l_quantity"))})
    return swept.select("combo_id", "n", F.round("price", 2).alias("price"), "most")


def _describe(params: dict) -> dict:
    """A task: what a run of these parameters would cost."""
    epochs, units = int(params.get("epoch", "20")), int(params["unit"])
    return {"options": len(params), "cost": epochs * units, "model": params["model"].upper()}


@query("run_map", """
    SELECT spec_id, combo_id, 'SUCCESS' AS status,
           2 + (is_verbose)::int + (epoch IS NOT NULL)::int AS options,
           cast(coalesce(epoch, 20) * cast(unit AS integer) AS bigint) AS cost,
           upper(model) AS model
    FROM fx_grid
""", ("fx_grid",))
def run_map(spark, sf_dir):
    done = tasks.run_map(fx_grid(spark, sf_dir), _describe,
                         "options int, cost bigint, model string",
                         keep=["spec_id", "combo_id"])
    return done.drop("error")


def _fragile(params: dict):
    """A task that gives a dictionary, a plain value, rows, nothing, or what does not fit."""
    unit = int(params["unit"])
    share = 100 // (unit % 10)
    return [{"share": share}, share, [{"share": share}, {"share": unit}], None, "no number"][unit % 5]


@query("run_isolate_errors", """
    , units AS (SELECT spec_id, combo_id, cast(unit AS integer) AS u FROM fx_grid),
    each_row AS (SELECT spec_id, combo_id, u, unnest(CASE WHEN u % 10 <> 0 AND u % 5 = 2
                 THEN [0, 1] ELSE [0] END) AS i FROM units)
    SELECT spec_id, combo_id, CASE WHEN u % 10 = 0 OR u % 5 = 4 THEN 'FAILURE' ELSE 'SUCCESS' END
               AS status,
           CASE WHEN u % 10 = 0 THEN 'ZeroDivisionError' WHEN u % 5 = 4 THEN 'ArrowInvalid' END
               AS error,
           CASE WHEN u % 10 = 0 OR u % 5 > 2 THEN NULL WHEN i = 1 THEN u
                ELSE 100 // (u % 10) END::bigint AS share
    FROM each_row
""", ("fx_grid",))
def run_isolate_errors(spark, sf_dir):
    done = tasks.run_map(fx_grid(spark, sf_dir), _fragile, "share bigint",
                         keep=["spec_id", "combo_id"])
    return done.withColumn("error", F.substring_index("error", ":", 1))


def _cost(params: dict) -> int:
    return int(params["unit"]) * int(params.get("epoch", "20"))


def _name_length(params: dict) -> int:
    return len(params["model"])


@query("run_named", """
    SELECT spec_id, combo_id, CASE WHEN u % 3 = 2 THEN 'FAILURE' ELSE 'SUCCESS' END AS status,
           CASE WHEN u % 3 = 2 THEN 'UnknownTask: draw' END AS error,
           CASE u % 3 WHEN 0 THEN u * coalesce(epoch, 20) WHEN 1 THEN length(model) END::bigint
               AS value
    FROM (SELECT *, cast(unit AS integer) AS u FROM fx_grid)
""", ("fx_grid",))
def run_named(spark, sf_dir):
    """Each combination names its task; a name that nobody registered fails alone."""
    names = F.array(F.lit("cost"), F.lit("length"), F.lit("draw"))
    named = fx_grid(spark, sf_dir).withColumn("params", F.map_concat("params", F.create_map(
        F.lit("task"), F.get(names, (F.col("params")["unit"].cast("int") % 3)))))
    return tasks.run_map(named, tasks.by_name({"cost": _cost, "length": _name_length}),
                         "value bigint", keep=["spec_id", "combo_id"])


def _restless(params: dict) -> int:
    """A task that ends its process for some parameters."""
    if params["o_orderkey"] % 7 == 3:
        os._exit(5)
    return params["o_orderkey"] * 2


@query("run_supervised", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 3 THEN 'FAILURE' ELSE 'SUCCESS' END AS status,
           CASE WHEN o_orderkey % 7 = 3 THEN 'TaskEnded: exit code 5' END AS error,
           CASE WHEN o_orderkey % 7 <> 3 THEN o_orderkey * 2 END AS value
    FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
      AND o_orderstatus = 'F'
""")
def run_supervised(spark, sf_dir):
    """Tasks in processes of their own: some exit, and nobody else notices."""
    customers = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(
        F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(
        customers, "o_custkey", "left_semi")
    rows = orders.select("o_orderkey", F.create_map(F.lit("o_orderkey"), "o_orderkey").alias("params"))
    return tasks.run_map(rows, _restless, "value bigint", keep=["o_orderkey"],
                         limits=tasks.Limits(seconds=60))


@query("run_placement", """
    SELECT count(*) AS tasks, true AS dealt_out FROM fx_grid
""", ("fx_grid",))
def run_placement(spark, sf_dir):
    placed = tasks.placement(grid.tasks(fx_grid(spark, sf_dir)))
    return placed.agg(F.sum("tasks").alias("tasks"),
                      (F.count_distinct("partition_id") > 1).alias("dealt_out"))


@query("run_echo", """
    SELECT task_id, i AS seq, 'MSG' AS status, 'i=' || i AS text
    FROM fx_echo, range(0, 6) r(i) WHERE i < n
    UNION ALL
    SELECT task_id, n, 'SUCCESS',
           '{"n":' || n || CASE WHEN n > 0 THEN ',"i":' || (n - 1) ELSE '' END || '}' FROM fx_echo
""", ("fx_echo",))
def run_echo(spark, sf_dir):
    return tasks.echo(fx.fx_echo(spark, sf_dir))


@query("run_echo_udtf", """
    SELECT task_id, i AS seq, 'i=' || i AS text FROM fx_echo, range(0, 6) r(i) WHERE i < n
""", ("fx_echo",))
def run_echo_udtf(spark, sf_dir):
    return tasks.echo_by_table_function(spark, fx.fx_echo(spark, sf_dir))


@query("run_dedup_redelivery", """
    SELECT task_id, seq, status, "out", err, text, result, detail FROM fx_message
""", ("fx_message",))
def run_dedup_redelivery(spark, sf_dir):
    return tasks.without_redelivery(fx.fx_redelivered(spark, sf_dir)).drop("ts")


@query("run_kfold_split", """
    SELECT doc_id, f AS fold, CASE WHEN doc_id % 5 = f THEN 'test' ELSE 'train' END AS part
    FROM documents, range(0, 5) r(f)
""")
def run_kfold_split(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return folds.fold_rows(documents, "doc_id", 5).withColumn("fold", F.col("fold").cast("bigint"))


@query("run_kfold_metric", """
    , folds AS (SELECT k AS nfolds, f AS fold FROM (SELECT unnest([1, 2, 5]) AS k) k,
                range(0, 5) r(f) WHERE f < k),
    trained AS (
        SELECT nfolds, fold, avg(n_chars) AS threshold FROM folds, fx_kfold
        WHERE nfolds = 1 OR doc_id % nfolds <> fold GROUP BY nfolds, fold)
    SELECT nfolds, cast(fold AS integer) AS fold, round(threshold, 6) AS threshold,
           count(*) AS n_test,
           round(avg(CASE WHEN (n_chars > threshold)::int = y THEN 1 ELSE 0 END), 6) AS accuracy
    FROM trained, fx_kfold WHERE doc_id % nfolds = fold GROUP BY nfolds, fold, threshold
""", ("fx_kfold",))
def run_kfold_metric(spark, sf_dir):
    metric = folds.threshold_metric(fx.fx_kfold(spark, sf_dir), "doc_id", "n_chars", "y", [1, 2, 5])
    return metric.withColumn("threshold", F.round("threshold", 6)) \
        .withColumn("accuracy", F.round("accuracy", 6))
