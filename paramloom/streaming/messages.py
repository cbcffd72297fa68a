"""Log operators on running message streams.

State is kept per task (or per task and piece), never per stream, so it is spread
over the cluster. Sinks written from ``foreachBatch`` put each micro-batch into its
own folder and overwrite it, so a batch that is run again leaves one copy.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from paramloom.operators.history import LINES_PER_PIECE, accumulate
from paramloom.operators.ordering import whole

# How long a poll waits, how many waiting inputs are taken at once.
POLL_SECONDS = 5
QUEUE_BOUND = 5

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_messages(spark: SparkSession, path: str, schema, queue_bound: int | None = QUEUE_BOUND
                  ) -> DataFrame:
    """Stream of the parquet files at ``path``, at most ``queue_bound`` per batch."""
    reader = spark.readStream.schema(schema)
    if queue_bound:
        reader = reader.option("maxFilesPerTrigger", queue_bound)
    return reader.parquet(path)


def start(writer, until_done: bool, poll_seconds: int = POLL_SECONDS) -> StreamingQuery:
    """Starts a writer: over what is there now, or polling for more."""
    if until_done:
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    return writer.trigger(processingTime=f"{poll_seconds} seconds").start()


def append_files(stream: DataFrame, path: str, checkpoint: str, until_done: bool = True
                 ) -> StreamingQuery:
    """Stateless results to parquet, each row exactly once."""
    writer = (stream.writeStream.format("parquet").outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint))
    return start(writer, until_done)


def handle(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str,
           until_done: bool = True) -> StreamingQuery:
    """Calls ``handler(rows, batch number)`` on the messages of each micro-batch."""
    writer = (stream.writeStream.foreachBatch(handler).outputMode("append")
              .option("checkpointLocation", checkpoint))
    return start(writer, until_done)


def keep_updates(updates: DataFrame, path: str, checkpoint: str, until_done: bool = True
                 ) -> StreamingQuery:
    """Changed keys of a running aggregate, one folder per micro-batch."""
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = (updates.writeStream.foreachBatch(write).outputMode("update")
              .option("checkpointLocation", checkpoint))
    return start(writer, until_done)


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest state of each key out of ``keep_updates`` folders."""
    updates = spark.read.parquet(path)
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    return (updates.groupBy(*keys)
            .agg(F.max_by(F.struct(*values), "batch").alias("__newest"))
            .select(*keys, "__newest.*"))


def first_exit_state(commands: DataFrame) -> DataFrame:
    """Running first exit code per host; a later code never replaces it."""
    return commands.groupBy("host").agg(
        F.min_by("exitcode", F.when(F.col("exitcode").isNotNull(), F.struct("ts", "id")))
        .alias("exitcode"))


def output_state(log: DataFrame, lines_per_piece: int = LINES_PER_PIECE) -> DataFrame:
    """Running output text per task and piece, in line order whatever the arrival.

    A piece holds a fixed range of line numbers, which bounds each state.
    """
    return accumulate(log, lines_per_piece)


def append_output(log: DataFrame, path: str, checkpoint: str, until_done: bool = True
                  ) -> StreamingQuery:
    """The lines of ``log``, each written once and never again, whatever comes later.

    What a micro-batch writes follows its new lines, not the texts so far; ``read_output``
    puts them together.
    """
    return append_files(log.select("task_id", "line_no", "line"), path, checkpoint, until_done)


def read_output(spark: SparkSession, path: str, lines_per_piece: int = LINES_PER_PIECE
                ) -> DataFrame:
    """``(task_id, piece, text)`` of what ``append_output`` has written so far, in line order."""
    lines = spark.read.schema("task_id string, line_no bigint, line string").parquet(path)
    return accumulate(lines, lines_per_piece)


def _drop_near_copies(keys: list[str]):
    """Task function: each key once per Arrow batch."""
    def run(batches):
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            place = pa.array(range(len(rows)), pa.int64())
            first = rows.select(keys).append_column("__place", place) \
                .group_by(keys).aggregate([("__place", "min")])
            yield from rows.take(first["__place_min"].sort()).combine_chunks().to_batches()
    return run


def without_redelivery(messages: DataFrame, horizon: str | None = None) -> DataFrame:
    """Each message once.

    Copies that arrive close together are dropped before the shuffle, so that many
    copies of one message do not meet in one task. Exact by default: all keys stay in
    state, for which ``disk_state`` is meant. With ``horizon`` (as ``"1 hour"``) state
    is dropped after that much event time, right only where no copy comes later.
    """
    keys = ["task_id", "seq"]
    thinned = messages.mapInArrow(_drop_near_copies(keys), messages.schema)
    if horizon is None:
        return thinned.dropDuplicates(keys)
    return (thinned.withColumn("ts", F.col("ts").cast("timestamp"))
            .withWatermark("ts", horizon).dropDuplicatesWithinWatermark(keys))


# Message numbers that one state covers, and groups that tasks are dealt to by a hash.
NUMBERS_PER_STATE = 1 << 18
TASK_GROUPS = 1 << 10


def _joined(lows: np.ndarray, highs: np.ndarray, numbers: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray]:
    """Ranges ``lows`` to ``highs`` with further numbers, which lie in none of them."""
    lows, highs = np.concatenate([lows, numbers]), np.concatenate([highs, numbers])
    order = np.argsort(lows)
    lows, highs = lows[order], highs[order]
    apart = lows[1:] > highs[:-1] + 1
    return lows[np.append(True, apart)], highs[np.append(apart, True)]


def _unseen(key, frames, state):
    """Messages of a group of tasks and a block whose number is in no range of their task.

    Bounds of ranges are numbers behind the task's place in the list of the group's tasks, so
    that all tasks of the group are searched at once.
    """
    places, lows, highs = {}, *[np.zeros(0, np.int64)] * 2
    if state.exists:
        tasks, ranges = state.get
        places = {task: place for place, task in enumerate(json.loads(tasks))}
        lows, highs = np.split(np.frombuffer(ranges, np.int64), 2)
    changed = False
    for frame in frames:
        codes, tasks = pd.factorize(frame["__task"])
        place = np.array([places.setdefault(t, len(places)) for t in tasks], np.int64)
        numbers, first = np.unique(place[codes] << 32 | frame["__number"].to_numpy(np.int64),
                                   return_index=True)
        below = np.searchsorted(lows, numbers, side="right")
        new = numbers > np.append(np.int64(-1), highs)[below]
        if new.any():
            changed = True
            lows, highs = _joined(lows, highs, numbers[new])
            yield frame.iloc[first[new]].drop(columns=_PLACED)
    if changed:
        state.update((json.dumps(list(places)), np.concatenate([lows, highs]).tobytes()))


def _through_text(schema: T.StructType) -> tuple[list[Column], list[Column]]:
    """Columns as pandas keeps them whole (numbers as text, times as counts), and back."""
    there, back = [], []
    for field in schema:
        column, kind = F.col(field.name), field.dataType
        if isinstance(kind, T.TimestampType):
            there.append(F.unix_micros(column).cast("string").alias(field.name))
            back.append(F.timestamp_micros(column.cast("bigint")).alias(field.name))
        elif isinstance(kind, T.NumericType):
            there.append(column.cast("string").alias(field.name))
            back.append(column.cast(kind).alias(field.name))
        else:
            there.append(column)
            back.append(column)
    return there, back


# Columns of this module: group of tasks, block of numbers, task as text, number in the block.
_PLACED = ["__group", "__block", "__task", "__number"]


def without_redelivery_by_ranges(messages: DataFrame, numbers: int = NUMBERS_PER_STATE,
                                 groups: int = TASK_GROUPS) -> DataFrame:
    """Each message once, by ``task_id`` and the whole number ``seq``, in any order of arrival.

    State holds the ranges of numbers seen, by task, in one row per group of tasks (``groups``,
    by a hash) and block of ``numbers`` message numbers. A task that sent all its numbers so far
    has one range a block, so state follows tasks, not messages; a task with gaps has at most
    ``numbers / 2`` ranges a block. Messages of one task are spread by blocks. A call of Python
    costs about a millisecond, so many tasks share one; with hundreds of thousands of tasks per
    group give more groups, as a row is written whole when one of its tasks sends something
    new. Messages without a task count as one task's, those of a task without a number as one
    message. Columns may be of plain types; those named as ``_PLACED`` says are refused.
    """
    if set(_PLACED) & set(messages.columns):
        raise ValueError(f"columns {', '.join(_PLACED)} are used here")
    there, back = _through_text(messages.schema)
    thinned = messages.mapInArrow(_drop_near_copies(["task_id", "seq"]), messages.schema)
    task = there[messages.columns.index("task_id")]
    if isinstance(messages.schema["task_id"].dataType, T.BinaryType):
        task = F.hex(task)
    # Blocks of negative numbers reach downwards from 0, as division cuts towards it.
    placed = thinned.select(
        *there,
        F.pmod(F.xxhash64("task_id"), F.lit(groups)).cast("int").alias("__group"),
        F.struct(whole(F.col("seq"), numbers), F.col("seq") < 0).cast("string").alias("__block"),
        F.coalesce(F.concat(F.lit("="), task.cast("string")), F.lit("")).alias("__task"),
        F.coalesce(F.abs(F.col("seq") % numbers), F.lit(0)).cast("int").alias("__number"))
    schema = T.StructType([f for f in placed.schema if f.name not in _PLACED])
    once = placed.groupBy("__group", "__block").applyInPandasWithState(
        _unseen, schema, "tasks string, ranges binary", "append", GroupStateTimeout.NoTimeout)
    return once.select(*back)


@contextmanager
def disk_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, not in executor memory."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def ended_state(messages: DataFrame) -> DataFrame:
    """Running ``(task_id, ended)``."""
    return messages.groupBy("task_id").agg(
        F.max(F.col("status") != "MSG").alias("ended"))


def on_finish(messages: DataFrame, callback: Callable[[DataFrame, int, dict], None],
              params: dict, checkpoint: str, until_done: bool = True) -> StreamingQuery:
    """Calls back once per task, with the tasks that ended in a micro-batch, and parameters.

    An end that is delivered again, in this micro-batch or a later one, is known from
    state, which holds a key per ended task. A micro-batch whose call returned is noted in a
    ledger beside the checkpoint; when it runs again, after a restart, it does not call again.
    """
    ledger = f"{checkpoint.rstrip('/')}-called"
    ended = (messages.where(F.col("status") != "MSG").select("task_id", "status")
             .dropDuplicates(["task_id"]))

    def hook(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        try:
            called = spark.read.schema("batch bigint").parquet(ledger)
            if not called.where(F.col("batch") == batch).isEmpty():
                rows.write.format("noop").mode("overwrite").save()  # state must be committed
                return
        except AnalysisException:  # no call yet
            pass
        callback(rows, batch, params)
        spark.createDataFrame([(batch,)], "batch bigint").write.mode("append").parquet(ledger)

    return handle(ended, hook, checkpoint, until_done)
