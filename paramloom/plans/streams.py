"""Queries that run as streams until their input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from paramloom.operators import messages
from paramloom.operators.messages import decode_message
from paramloom.plans import fixtures as fx
from paramloom.plans.registry import query, table
from paramloom.session import work_path
from paramloom.streaming import messages as stream


def _events(spark, sf_dir):
    # The braces make the path a pattern, which may match a file as well as a folder.
    path = f"{sf_dir.rstrip('/')}/events.{{parquet}}"
    files = max(stream.QUEUE_BOUND, 4 * spark.sparkContext.defaultParallelism)
    return stream.read_messages(spark, path, table(spark, sf_dir, "events").schema, files)


def _paths(spark, name):
    return work_path(spark, name), work_path(spark, f"{name}-checkpoint")


@query("st_route", r"""
    SELECT task_id, seq, 'out' AS stream,
           regexp_replace("out", '[\x00-\x1f]', '', 'g') AS line FROM fx_message
    WHERE status = 'MSG' AND length("out") > 0
    UNION ALL
    SELECT task_id, seq, 'err', err FROM fx_message WHERE status = 'MSG' AND length(err) > 0
""", ("fx_message",))
def st_route(spark, sf_dir):
    path, checkpoint = _paths(spark, "st-route")
    lines = messages.split_streams(fx.message_columns(_events(spark, sf_dir)), clean=True)
    stream.append_files(lines, path, checkpoint)
    return spark.read.schema(lines.schema).parquet(path)


@query("st_sink", r"""
    SELECT value FROM (SELECT CASE
        WHEN status = 'MSG' AND length("out") > 0 THEN task_id || ',' || "out"
        WHEN status = 'MSG' AND text IS NOT NULL THEN text
        WHEN status = 'SUCCESS' AND result IS NOT NULL THEN task_id || ',' || result END AS value
        FROM fx_message) WHERE value IS NOT NULL
""", ("fx_message",))
def st_sink(spark, sf_dir):
    """The result log written by a handler, one folder per micro-batch."""
    path, checkpoint = _paths(spark, "st-sink")

    def write(rows, batch):
        rows.select("value").write.mode("overwrite").text(f"{path}/batch={batch}")

    logged = fx.message_columns(_events(spark, sf_dir)) \
        .withColumn("value", messages.legacy_row()).where(F.col("value").isNotNull())
    stream.handle(logged, write, checkpoint)
    return spark.read.text(path).select("value")


@query("st_first_exit", """
    SELECT host, arg_min(exitcode, (ts, id)) FILTER (exitcode IS NOT NULL) AS exitcode
    FROM fx_command GROUP BY host
""", ("fx_command",))
def st_first_exit(spark, sf_dir):
    path, checkpoint = _paths(spark, "st-exit")
    running = stream.first_exit_state(fx.command_columns(_events(spark, sf_dir)))
    stream.keep_updates(running, path, checkpoint)
    return stream.latest(spark, path, ["host"])


@query("st_state", f"""
    SELECT cast(user_id AS varchar) AS task_id, event_id // {fx.PIECE} AS piece,
           string_agg(props, chr(10) ORDER BY event_id) AS text
    FROM events WHERE event_type = 'view' GROUP BY user_id, event_id // {fx.PIECE}
""")
def st_state(spark, sf_dir):
    path, checkpoint = _paths(spark, "st-state")
    log = fx.message_columns(_events(spark, sf_dir)).where(F.col("out").isNotNull()).select(
        "task_id", F.col("seq").alias("line_no"), F.col("out").alias("line"))
    stream.append_output(log, path, checkpoint)
    return stream.read_output(spark, path, fx.PIECE)


DEDUP_SQL = """
    SELECT task_id, seq, status, "out", err, text, result, detail FROM fx_message
"""


def _once(spark, sf_dir, without_redelivery):
    path, checkpoint = _paths(spark, "st-dedup")
    received = fx.redelivered(fx.message_columns(_events(spark, sf_dir))).drop("ts")
    once = without_redelivery(received)
    with stream.disk_state(spark):
        stream.append_files(once, path, checkpoint)
    return spark.read.schema(once.schema).parquet(path)


@query("st_dedup", DEDUP_SQL, ("fx_message",))
def st_dedup(spark, sf_dir):
    return _once(spark, sf_dir, stream.without_redelivery)


@query("st_dedup_ranges", DEDUP_SQL, ("fx_message",))
def st_dedup_ranges(spark, sf_dir):
    """The same with state that follows tasks, not messages."""
    return _once(spark, sf_dir, stream.without_redelivery_by_ranges)


@query("st_progress", """
    SELECT count(*) AS total, count(*) FILTER (ended) AS finished,
           count(*) FILTER (NOT ended) AS open
    FROM (SELECT task_id, bool_or(status <> 'MSG') AS ended FROM fx_message GROUP BY task_id)
""", ("fx_message",))
def st_progress(spark, sf_dir):
    path, checkpoint = _paths(spark, "st-progress")
    ended = stream.ended_state(fx.message_columns(_events(spark, sf_dir)))
    stream.keep_updates(ended, path, checkpoint)
    return stream.latest(spark, path, ["task_id"]).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("ended")).alias("finished"),
        F.count_if(~F.col("ended")).alias("open"))


@query("st_on_finish", """
    SELECT task_id, true AS ended FROM fx_message WHERE status <> 'MSG' GROUP BY task_id
""", ("fx_message",))
def st_on_finish(spark, sf_dir):
    """One call per ended task, although ends are delivered again and tasks end several times."""
    path, checkpoint = _paths(spark, "st-finish")

    def record(rows, batch, params):
        rows.write.mode("overwrite").parquet(f"{params['path']}/batch={batch}")

    messages = fx.redelivered(fx.message_columns(_events(spark, sf_dir)))
    stream.on_finish(messages, record, {"path": path}, checkpoint)
    return spark.read.parquet(path).select(
        "task_id", F.col("status").isNotNull().alias("ended"))


@query("st_decode_message", """
    SELECT task_id, seq, status, "out", err, text, result, replace(detail, ' ', '') AS detail FROM fx_message
""", ("fx_message",))
def st_decode_message(spark, sf_dir):
    path, checkpoint = _paths(spark, "st-decode")
    decoded = decode_message(fx.raw_messages(fx.message_columns(_events(spark, sf_dir))))
    stream.append_files(decoded, path, checkpoint)
    return spark.read.schema(decoded.schema).parquet(path)
