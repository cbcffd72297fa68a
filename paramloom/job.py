"""A whole parameter sweep: specifications in, task results and a run log out."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from paramloom.functions.params import overlay
from paramloom.operators import grid, specs, tasks
from paramloom.sources import runlog
from paramloom.sources.specs import read_specs


@dataclass(frozen=True)
class Sweep:
    """What a sweep left behind, as DataFrames over the files it wrote."""

    tasks: DataFrame
    results: DataFrame
    errors: DataFrame
    log: DataFrame


def plan(spark: SparkSession, spec_path: str, base: dict[str, str] | None = None,
         list_as_interval: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tasks of all combinations of all specs, and the parameters that were not taken.

    ``base`` gives values to parameters that a spec does not name.
    """
    raw = read_specs(spark, spec_path)
    combinations = grid.grid(specs.param_dimensions(raw, list_as_interval))
    if base:
        under = F.create_map(*[F.lit(x) for pair in base.items() for x in pair])
        combinations = combinations.withColumn(
            "params", overlay(under, F.map_keys("params"), F.col("params")))
    return grid.tasks(combinations), specs.spec_errors(raw, list_as_interval)


LEDGER = "task_id string, batch int, attempt string"


def _committed(spark: SparkSession, output_path: str) -> DataFrame:
    """``(task_id, batch, attempt)`` of the tasks whose results count."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{output_path}/ledger")
    except AnalysisException:  # nothing was committed yet
        return spark.createDataFrame([], LEDGER)


def _results(spark: SparkSession, output_path: str, schema: StructType) -> DataFrame:
    """Results of committed batches; what an interrupted attempt wrote is passed over."""
    written = spark.read.schema(StructType([*schema.fields, StructField("batch", IntegerType()),
                                            StructField("attempt", StringType())])) \
        .parquet(f"{output_path}/results")
    batches = _committed(spark, output_path).select("batch", "attempt").distinct()
    return written.join(batches, ["batch", "attempt"], "left_semi").select(*schema.names)


def run_sweep(spark: SparkSession, spec_path: str, output_path: str,
              fn: Callable[[dict], dict | Iterable[dict]], schema: str,
              base: dict[str, str] | None = None, partitions: int | None = None,
              result_text: Column | None = None, batches: int = 1, resume: bool = False,
              limits: tasks.Limits | None = None) -> Sweep:
    """Runs ``fn`` once per combination; every part is written before it is read again.

    ``output_path`` gets the folders ``tasks``, ``results`` and ``ledger`` (parquet) and ``log``
    (text): a header row per task, then a row per result, whose text is ``result_text`` or the
    result as JSON. Tasks are dealt to ``batches`` by a hash of their id; a batch's results
    count once the ledger names its tasks. ``resume`` goes on with a sweep that was interrupted:
    only tasks that the ledger does not name run. A batch that was cut off between its log rows and
    its commit writes the log rows again, which ``tasks.without_redelivery`` drops.
    """
    planned, errors = plan(spark, spec_path, base)
    begun = resume and not _committed(spark, output_path).isEmpty()
    if not begun:
        planned.write.mode("overwrite").parquet(f"{output_path}/tasks")
        runlog.write_headers(spark.read.parquet(f"{output_path}/tasks"), f"{output_path}/log")
        spark.createDataFrame([], LEDGER).write.mode("overwrite").parquet(f"{output_path}/ledger")
    dispatched = spark.read.parquet(f"{output_path}/tasks")
    number = F.pmod(F.xxhash64("task_id"), F.lit(batches)).cast("int")
    unset, attempt = F.lit(None).cast("string"), uuid.uuid4().hex
    form = tasks.run_map(dispatched.limit(0), fn, schema).schema
    if not begun:
        spark.createDataFrame([], form).withColumns({"batch": F.lit(-1), "attempt": F.lit("")}) \
            .write.mode("overwrite").partitionBy("batch", "attempt").parquet(f"{output_path}/results")
    for batch in range(batches):
        open_tasks = dispatched.where(number == batch).join(
            _committed(spark, output_path), "task_id", "left_anti")
        if begun and open_tasks.isEmpty():
            continue
        path = f"{output_path}/results/batch={batch}/attempt={attempt}"
        tasks.run_map(open_tasks, fn, schema, partitions, limits=limits).write.parquet(path)
        done = spark.read.schema(form).parquet(path)
        values = [c for c in form.names if c not in ("task_id", "status", "error")]
        text = F.to_json(F.struct(*values)) if result_text is None else result_text
        runlog.append_messages(done.select(
            "task_id", F.lit(0).cast("bigint").alias("seq"), "status", unset.alias("out"),
            unset.alias("text"), text.alias("result")), f"{output_path}/log")
        open_tasks.select("task_id", F.lit(batch).alias("batch"), F.lit(attempt).alias("attempt")) \
            .write.mode("append").parquet(f"{output_path}/ledger")
    return Sweep(dispatched, _results(spark, output_path, form), errors,
                 runlog.read_log(spark, f"{output_path}/log"))
