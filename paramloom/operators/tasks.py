"""Running user functions per combination, and the echo task."""

from __future__ import annotations

import multiprocessing
import os
import pickle
import resource
import socket
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from paramloom.operators import ordering

OUTPUT_ROWS = 10_000


def _rows_of(result, names: list[str]):
    """What a function gave back, as dictionaries: none, one, or as many as it yields."""
    if result is None:
        return [{}]
    if isinstance(result, dict):
        return [result]
    if isinstance(result, (str, bytes)) or not isinstance(result, Iterable):
        if len(names) != 1:
            raise TypeError(f"one value for {len(names)} columns: {result!r}")
        return [{names[0]: result}]
    return result


class UnknownTask(Exception):
    """A row asks for a task that no function is registered for."""


class TaskEnded(Exception):
    """A task's process ended by itself, or was ended at its time limit."""


def by_name(functions: dict[str, Callable[[dict], object]], key: str = "task",
            default: str | None = None) -> Callable[[dict], object]:
    """One function for ``run_map`` that calls the one that a task names.

    The name is taken out of the parameters, from ``key``; tasks without one get ``default``. An
    unknown name is a failure of that task.
    """
    known = dict(functions)

    def call(params: dict):
        name = params.pop(key, default)
        if name not in known:
            raise UnknownTask(str(name))
        return known[name](params)
    return call


@dataclass(frozen=True)
class Limits:
    """What one task may take: seconds, and megabytes on top of its worker's memory."""

    seconds: float | None = None
    megabytes: int | None = None


def _address_space() -> int:
    with open("/proc/self/statm") as file:
        return int(file.read().split()[0]) * resource.getpagesize()


def _in_child(pipe, fn, params, names, limits: Limits) -> None:
    """A child's work: portions of rows, then how it ended."""
    try:
        if limits.megabytes:
            most = _address_space() + limits.megabytes * 1_000_000
            resource.setrlimit(resource.RLIMIT_AS, (most, most))
        rows = []
        for row in _rows_of(fn(params), names):
            rows.append(row)
            if len(rows) >= OUTPUT_ROWS:
                pipe.send_bytes(pickle.dumps(rows))
                rows = []
        pipe.send_bytes(pickle.dumps(rows))
        last = None
    except BaseException as error:  # also what would end the process
        last = (type(error).__name__, str(error))
    pipe.send_bytes(pickle.dumps(last))
    pipe.close()
    os._exit(0)


def _supervised(fn, names: list[str], limits: Limits):
    """``fn`` in a process of its own, which may exit, hang or take too much without harm."""
    fork = multiprocessing.get_context("fork")

    def call(params: dict):
        ours, theirs = fork.Pipe(duplex=False)
        child = fork.Process(target=_in_child, args=(theirs, fn, params, names, limits), daemon=True)
        child.start()
        theirs.close()
        try:
            while True:
                if not ours.poll(limits.seconds):
                    raise TaskEnded(f"no answer in {limits.seconds:g} seconds")
                try:
                    told = pickle.loads(ours.recv_bytes())
                except EOFError:
                    child.join()
                    raise TaskEnded(f"exit code {child.exitcode}") from None
                if told is None:
                    return
                if isinstance(told, tuple):
                    raise type(told[0], (Exception,), {})(told[1])
                yield from told
        finally:
            child.kill()
            child.join()
            ours.close()
    return call


def run_map(tasks: DataFrame, fn: Callable[[dict], object], schema: str,
            partitions: int | None = None, keep: list[str] | None = None,
            limits: Limits | None = None) -> DataFrame:
    """Calls ``fn(params)`` once per task.

    ``fn`` gives a dictionary, several (a list or generator), one plain value for a
    schema of one column, or None: a row of NULLs. Result:
    ``(task_id, status, error, <schema>)``, or with the columns ``keep`` of the task
    instead of its id. A task that raises, or whose result does not fit the schema, gets
    one FAILURE row with its error and does not disturb the others; rows that a generator
    gave before it failed stay, in portions of ``OUTPUT_ROWS``. ``partitions`` sets how
    many tasks may run side by side, otherwise those of the input do. With ``limits`` each
    task runs in a process of its own: one that exits, gives nothing for too long or takes too
    much memory is a failure too, and the others go on.
    """
    keep = keep or ["task_id"]
    names = _parse_datatype_string(schema).names
    call = fn if limits is None else _supervised(fn, names, limits)
    chosen = tasks.select(*keep, "params")
    if partitions:
        chosen = chosen.repartition(partitions)
    output = StructType([*chosen.schema.fields[:-1], StructField("status", StringType()),
                         StructField("error", StringType()),
                         *_parse_datatype_string(schema).fields])
    fields = list(to_arrow_schema(output))

    def converted(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([row[i] for row in rows], f.type) for i, f in enumerate(fields)],
            names=[f.name for f in fields])

    def failure(task, error):
        text = f"{type(error).__name__}: {error}"
        return [*task, "FAILURE", text, *[None] * len(names)]

    def portions(task, params):
        """Portions of a task's rows."""
        rows = []
        try:
            for result in _rows_of(call(dict(params or {})), names):
                rows.append([*task, "SUCCESS", None, *[result.get(n) for n in names]])
                if len(rows) >= OUTPUT_ROWS:
                    yield rows
                    rows = []
        except Exception as error:  # any failure belongs to this task only
            rows.append(failure(task, error))
        if rows:
            yield rows

    def written(held):
        """Several portions at once, or one by one if a row does not fit."""
        try:
            yield converted([row for _, rows in held for row in rows])
        except (pa.ArrowException, TypeError, ValueError, OverflowError):
            for task, rows in held:
                try:
                    yield converted(rows)
                except (pa.ArrowException, TypeError, ValueError, OverflowError) as error:
                    yield converted([failure(task, error)])

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            columns = batch.to_pydict()
            for *task, params in zip(*(columns[c] for c in [*keep, "params"])):
                for rows in portions(task, params):
                    held.append((task, rows))
                    size += len(rows)
                    if size >= OUTPUT_ROWS:
                        yield from written(held)
                        held, size = [], 0
        if held:
            yield from written(held)

    return chosen.mapInArrow(run_batches, output)


def placement(tasks: DataFrame, partitions: int | None = None) -> DataFrame:
    """``(partition_id, host, tasks)``: where each task of a run was placed.

    Without ``partitions`` tasks are dealt out to as many as the session shuffles into.
    """
    def locate(batches):
        host, partition = socket.gethostname(), TaskContext.get().partitionId()
        for batch in batches:
            yield pd.DataFrame({"partition_id": [partition], "host": [host],
                                "tasks": [len(batch)]})

    rows = tasks.select("task_id")
    dealt = rows.repartition(partitions) if partitions else ordering.spread(rows)
    placed = dealt.mapInPandas(
        locate, "partition_id int, host string, tasks bigint")
    return placed.groupBy("partition_id", "host").agg(F.sum("tasks").alias("tasks"))


def echo(tasks: DataFrame) -> DataFrame:
    """Messages ``i=0`` to ``i=n-1`` of each ``(task_id, n)``, then its result.

    ``(task_id, seq, status, text)``; the result names the last ``i`` if there is one.
    """
    n = F.greatest(F.col("n"), F.lit(0)).cast("bigint")
    steps = ordering.positions(tasks, n, "seq", ["task_id"])
    messages = steps.select(
        "task_id", "seq", F.lit("MSG").alias("status"),
        F.concat(F.lit("i="), F.col("seq").cast("string")).alias("text"))
    results = tasks.select(
        "task_id", n.alias("seq"), F.lit("SUCCESS").alias("status"),
        F.to_json(F.struct("n", F.when(n > 0, n - 1).alias("i"))).alias("text"))
    return messages.unionByName(results)


class _EchoSteps:
    """A task that emits a row per step, as a table function."""

    def eval(self, n: int):
        for i in range(n or 0):
            yield i, f"i={i}"


def echo_by_table_function(spark: SparkSession, tasks: DataFrame) -> DataFrame:
    """``(task_id, seq, text)`` of the echo task, run as a Python table function."""
    steps = F.udtf(_EchoSteps, returnType="seq bigint, text string", useArrow=True)
    spark.udtf.register("paramloom_echo", steps)
    return spark.sql(
        "SELECT t.task_id, e.seq, e.text FROM {tasks} t, LATERAL paramloom_echo(t.n) e",
        tasks=tasks.select("task_id", F.col("n").cast("bigint").alias("n")))


def without_redelivery(messages: DataFrame) -> DataFrame:
    """Each message once, however often a restarted task sent it.

    Copies are combined map-side, so many copies of one message cost one row per task.
    """
    return messages.dropDuplicates(["task_id", "seq"])
