"""Streams over several micro-batches against the batch operators."""

import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paramloom.operators import history, messages, tasks
from paramloom.plans import fixtures as fx
from paramloom.plans.registry import table
from paramloom.streaming import messages as stream

FILES = 4


@pytest.fixture(scope="module")
def events(spark, sf_dir, tmp_path_factory):
    """The events in several files, every seventh message sent again in a later file."""
    path = str(tmp_path_factory.mktemp("stream") / "events")
    rows = table(spark, sf_dir, "events")
    parts = [rows.where(F.col("event_id") % FILES == i) for i in range(FILES)]
    for i, part in enumerate(parts):
        again = parts[i - 1].where(F.col("event_id") % 7 == 0) if i else part.limit(0)
        part.unionByName(again).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture()
def source(spark, events):
    return stream.read_messages(spark, events, spark.read.parquet(events).schema, queue_bound=1)


@pytest.fixture()
def paths(tmp_path):
    return str(tmp_path / "out"), str(tmp_path / "checkpoint")


def same(left, right):
    assert sorted(map(tuple, left.collect()), key=repr) == \
        sorted(map(tuple, right.select(left.columns).collect()), key=repr)


def received(spark, events):
    return fx.message_columns(spark.read.parquet(events))


def test_queue_bound_sets_the_batches(spark, events, source, paths):
    seen = []
    query = stream.handle(fx.message_columns(source), lambda rows, n: seen.append(rows.count()),
                          paths[1])
    assert len(seen) == FILES
    assert sum(seen) == received(spark, events).count()
    assert query.exception() is None


def test_routing_equals_batch(spark, events, source, paths):
    lines = messages.split_streams(fx.message_columns(source), clean=True)
    stream.append_files(lines, *paths)
    same(spark.read.parquet(paths[0]),
         messages.split_streams(received(spark, events), clean=True))


def test_restart_takes_only_what_is_new(spark, events, paths, tmp_path):
    schema = spark.read.parquet(events).schema
    for _ in range(2):
        lines = fx.message_columns(stream.read_messages(spark, events, schema, 2))
        stream.append_files(lines, *paths)
    assert spark.read.parquet(paths[0]).count() == received(spark, events).count()


@pytest.mark.parametrize("disk", [False, True])
def test_redelivery_over_batches(spark, events, source, paths, disk):
    once = stream.without_redelivery(fx.message_columns(source).drop("ts"))
    if disk:
        with stream.disk_state(spark):
            stream.append_files(once, *paths)
    else:
        stream.append_files(once, *paths)
    same(spark.read.parquet(paths[0]),
         tasks.without_redelivery(received(spark, events)).drop("ts"))


def _state_rows(query):
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


@pytest.mark.parametrize("disk", [False, True])
@pytest.mark.parametrize("numbers", [stream.NUMBERS_PER_STATE, 64])
def test_redelivery_by_ranges(spark, events, source, paths, disk, numbers):
    """State follows tasks and blocks of numbers, not messages."""
    rows = fx.message_columns(source).drop("ts")
    once = stream.without_redelivery_by_ranges(rows, numbers)
    assert once.schema == rows.schema
    if disk:
        with stream.disk_state(spark):
            query = stream.append_files(once, *paths)
    else:
        query = stream.append_files(once, *paths)
    expected = tasks.without_redelivery(received(spark, events)).drop("ts")
    same(spark.read.parquet(paths[0]), expected)
    groups = expected.select("task_id", F.call_function("div", "seq", F.lit(numbers))).distinct()
    assert _state_rows(query) == groups.count() < expected.count()


def test_states_of_ranges_are_fewer_than_tasks(spark, paths, tmp_path):
    """Tasks of a few messages each share states; each keeps its own ranges."""
    path = str(tmp_path / "in")
    sent = spark.range(6000).selectExpr("cast(id % 3000 as string) AS task_id", "id AS seq")
    for part in (sent.where("seq % 3 > 0"), sent, sent.where("seq < 2000")):
        part.coalesce(1).write.mode("append").parquet(path)
    # The same numbers from other tasks are other messages.
    spark.range(6000).selectExpr("concat(id % 3000, '!') AS task_id", "id AS seq") \
        .coalesce(1).write.mode("append").parquet(path)
    source = stream.read_messages(spark, path, sent.schema, queue_bound=1)
    query = stream.append_files(stream.without_redelivery_by_ranges(source, groups=16), *paths)
    kept = spark.read.parquet(paths[0])
    assert kept.count() == kept.distinct().count() == 12000
    assert kept.where("seq % 3000 = int(replace(task_id, '!', ''))").count() == 12000
    assert _state_rows(query) == 16


def test_ranges_keep_every_value(spark, paths, tmp_path):
    """Negative and missing numbers, no task, and numbers, times and flags beside nulls."""
    import datetime
    import decimal
    schema = ("task_id string, seq bigint, big bigint, x double, d decimal(30,2), ok boolean, "
              "ts timestamp, day date")
    when, day = datetime.datetime(1600, 1, 2, 3, 4, 5, 678901), datetime.date(1500, 1, 1)
    rows = [("a", n, 2 ** 62 + 1, float("nan"), decimal.Decimal("1.10"), True, when, day)
            for n in (-3, 3, 0, -64, 64, 63, -63, 2 ** 62)]
    rows += [(t, n, None, None, None, None, None, None) for t, n in
             [("b", 1), (None, 1), (None, None), ("b", None), ("", 1)]]
    path = str(tmp_path / "in")
    for part in (rows[::2], rows[1::2], rows, rows[::-1]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    source = stream.read_messages(spark, path, spark.read.parquet(path).schema, queue_bound=1)
    stream.append_files(stream.without_redelivery_by_ranges(source, 64), *paths)
    kept = spark.read.parquet(paths[0]).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, rows))  # NaN equals no NaN


def test_joined_ranges():
    import random
    rng, lows, highs, seen = random.Random(1), *[np.zeros(0, np.int32)] * 2, set()
    for _ in range(30):
        new = sorted({rng.randrange(200) for _ in range(9)} - seen)
        seen |= set(new)
        lows, highs = stream._joined(lows, highs, np.array(new, np.int32))
        assert [n for a, b in zip(lows, highs) for n in range(a, b + 1)] == sorted(seen)
        assert (lows[1:] > highs[:-1] + 1).all()


def test_redelivery_with_horizon(spark, events, source, paths):
    once = stream.without_redelivery(fx.message_columns(source), horizon="3650 days")
    stream.append_files(once, *paths)
    same(spark.read.parquet(paths[0]).select("task_id", "seq"),
         tasks.without_redelivery(received(spark, events)).select("task_id", "seq"))


def test_copies_in_one_batch_are_dropped_before_the_shuffle(spark, events):
    rows = received(spark, events).drop("ts")
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(5)))).drop("copy")
    thin = many.mapInArrow(stream._drop_near_copies(["task_id", "seq"]), many.schema)
    assert thin.count() < 2 * rows.count()
    same(thin.distinct(), rows.distinct())


def test_first_exit_sticks(spark, events, source, paths):
    running = stream.first_exit_state(fx.command_columns(source))
    stream.keep_updates(running, *paths)
    newest = stream.latest(spark, paths[0], ["host"]).where("exitcode IS NOT NULL")
    same(newest, history.first_exit(fx.command_columns(spark.read.parquet(events))))


def test_output_in_line_order(spark, events, source, paths):
    def log(rows):
        return rows.where("event_id % 7 <> 0").select(
            F.col("event_type").alias("task_id"), F.col("event_id").alias("line_no"),
            F.col("props").alias("line"))

    stream.keep_updates(stream.output_state(log(source), 100), *paths)
    same(stream.latest(spark, paths[0], ["task_id", "piece"]),
         history.accumulate(log(spark.read.parquet(events)), 100))


def test_appended_output_is_written_once(spark, events, source, paths):
    """Every line is on disk once, however many micro-batches a piece gets lines from."""
    def log(rows):
        return rows.where("event_id % 7 <> 0").select(
            F.col("event_type").alias("task_id"), F.col("event_id").alias("line_no"),
            F.col("props").alias("line"))

    lines = log(spark.read.parquet(events))
    stream.append_output(log(source), *paths)
    same(stream.read_output(spark, paths[0], 100), history.accumulate(lines, 100))
    assert spark.read.parquet(paths[0]).count() == lines.count()


def test_progress(spark, events, source, paths):
    stream.keep_updates(stream.ended_state(fx.message_columns(source)), *paths)
    newest = stream.latest(spark, paths[0], ["task_id"])
    expected = received(spark, events).groupBy("task_id").agg(
        F.bool_or(F.col("status") != "MSG").alias("ended"))
    same(newest, expected)


def test_callback_gets_tasks_and_parameters(spark, events, source, paths):
    calls = []

    def callback(rows, batch, params):
        calls.append((batch, params["name"], {r["task_id"] for r in rows.collect()}))

    stream.on_finish(fx.message_columns(source), callback, {"name": "done"}, paths[1])
    assert [c[0] for c in calls] == list(range(FILES))
    assert {c[1] for c in calls} == {"done"}
    ended = {r["task_id"] for r in history.terminal(received(spark, events)).collect()}
    assert set().union(*[c[2] for c in calls]) == ended


def test_a_batch_that_runs_again_does_not_call_again(spark, events, source, paths):
    """The last batch's commit is lost after its call returned, so Spark runs it again."""
    calls = []

    def callback(rows, batch, params):
        calls.append((batch, rows.count()))

    for _ in range(2):
        stream.on_finish(fx.message_columns(source), callback, {}, paths[1])
        for name in (f"{FILES - 1}", f".{FILES - 1}.crc"):
            (pathlib.Path(paths[1]) / "commits" / name).unlink(missing_ok=True)
    assert [batch for batch, _ in calls] == list(range(FILES))


def test_poll_runs_until_stopped(spark, events, paths):
    everything = stream.read_messages(spark, events, spark.read.parquet(events).schema, None)
    lines = messages.route(fx.message_columns(everything))
    query = stream.append_files(lines, *paths, until_done=False)
    try:
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
