"""Queries on messages, output lines, commands and the result log."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from paramloom.functions.params import dictionary_text
from paramloom.operators import generate, grid, history, messages
from paramloom.plans import fixtures as fx
from paramloom.plans.parameter_space import fx_grid
from paramloom.plans.registry import query, table
from paramloom.session import work_path
from paramloom.sources import records, runlog

HEADER_SQL = """task_id || ',model=' || model || ',' || CASE WHEN is_verbose THEN 'verbose=,'
    ELSE '' END || 'unit=' || unit || ',' || CASE WHEN epoch IS NULL THEN ''
    ELSE 'epoch=' || epoch || ',' END"""
TASK_SQL = """SELECT *, spec_id || '/' || combo_id AS task_id FROM fx_grid"""
STRIP_SQL = r"regexp_replace({}, '[\x00-\x1f]', '', 'g')"
LEGACY_SQL = f"""
    SELECT task_id, seq, CASE
        WHEN status = 'MSG' AND length({STRIP_SQL.format('"out"')}) > 0
            THEN task_id || ',' || {STRIP_SQL.format('"out"')}
        WHEN status = 'MSG' AND text IS NOT NULL THEN text
        WHEN status = 'SUCCESS' AND result IS NOT NULL THEN task_id || ',' || result END AS value
    FROM fx_message"""


def fx_tasks(spark, sf_dir):
    return fx_grid(spark, sf_dir).withColumn(
        "task_id", F.concat_ws("/", "spec_id", F.col("combo_id").cast("string")))


@query("log_decode_message", """
    SELECT task_id, seq, status, "out", err, text, result, replace(detail, ' ', '') AS detail FROM fx_message
""", ("fx_message",))
def log_decode_message(spark, sf_dir):
    """Messages as JSON text, as they are sent, back to their columns."""
    return messages.decode_message(fx.raw_messages(fx.fx_message(spark, sf_dir)))


@query("sink_task_header", f"SELECT {HEADER_SQL} AS value FROM ({TASK_SQL})", ("fx_grid",))
def sink_task_header(spark, sf_dir):
    path = work_path(spark, "headers")
    runlog.write_headers(fx_tasks(spark, sf_dir), path)
    return spark.read.text(path)


@query("sink_message_row", f"SELECT value FROM ({LEGACY_SQL}) WHERE value IS NOT NULL",
       ("fx_message",))
def sink_message_row(spark, sf_dir):
    path = work_path(spark, "messages")
    runlog.append_messages(fx.fx_message(spark, sf_dir), path)
    return spark.read.text(path)


@query("src_output_log", f"""
    SELECT task_id, 'header' AS kind, concat_ws(',', 'epoch=' || epoch, 'model=' || model,
           'unit=' || unit, CASE WHEN is_verbose THEN 'verbose=' END) AS params, NULL AS text
    FROM ({TASK_SQL})
    UNION ALL
    SELECT CASE WHEN value <> 'signup' THEN task_id END,
           CASE WHEN value = 'signup' THEN 'plain' ELSE 'row' END, NULL,
           CASE WHEN value = 'signup' THEN value ELSE substr(value, length(task_id) + 2) END
    FROM ({LEGACY_SQL}) WHERE value IS NOT NULL
""", ("fx_grid", "fx_message"))
def src_output_log(spark, sf_dir):
    path = work_path(spark, "log")
    runlog.write_headers(fx_tasks(spark, sf_dir), path)
    runlog.append_messages(fx.fx_message(spark, sf_dir), path)
    log = runlog.read_log(spark, path)
    return log.withColumn("params", dictionary_text(F.col("params")))


@query("src_split_records", """
    SELECT event_type AS W, cast(user_id AS varchar) AS N, cast(event_id AS varchar) AS Gomi
    FROM events
""")
def src_split_records(spark, sf_dir):
    return records.split_records(fx.fx_worker_text(spark, sf_dir), ["W", "N", "Gomi"])


@query("log_filter_worker", """
    SELECT cast(user_id AS varchar) AS N, cast(event_id AS varchar) AS Gomi
    FROM events WHERE event_type = 'click'
""")
def log_filter_worker(spark, sf_dir):
    return src_split_records(spark, sf_dir).where(F.col("W") == "click").select("N", "Gomi")


@query("log_count_worker", "SELECT event_type AS W, count(*) AS n FROM events GROUP BY event_type")
def log_count_worker(spark, sf_dir):
    return src_split_records(spark, sf_dir).groupBy("W").agg(F.count(F.lit(1)).alias("n"))


@query("log_route", """
    SELECT task_id, seq, CASE status WHEN 'MSG' THEN 'message' WHEN 'SUCCESS' THEN 'result'
           ELSE 'other' END AS route FROM fx_message
""", ("fx_message",))
def log_route(spark, sf_dir):
    return messages.route(fx.fx_message(spark, sf_dir)).select("task_id", "seq", "route")


@query("log_split_streams", """
    SELECT task_id, seq, 'out' AS stream, "out" AS line FROM fx_message
    WHERE status = 'MSG' AND length("out") > 0
    UNION ALL
    SELECT task_id, seq, 'err', err FROM fx_message WHERE status = 'MSG' AND length(err) > 0
""", ("fx_message",))
def log_split_streams(spark, sf_dir):
    return messages.split_streams(fx.fx_message(spark, sf_dir))


@query("log_plain_text", """
    SELECT task_id, seq, text, text AS legacy_line FROM fx_message
    WHERE status = 'MSG' AND text IS NOT NULL
""", ("fx_message",))
def log_plain_text(spark, sf_dir):
    return messages.plain_texts(fx.fx_message(spark, sf_dir))


@query("log_results", """
    SELECT task_id, seq, result, task_id || ',' || result AS legacy_line FROM fx_message
    WHERE status = 'SUCCESS' AND result IS NOT NULL
""", ("fx_message",))
def log_results(spark, sf_dir):
    return messages.results(fx.fx_message(spark, sf_dir))


@query("log_explode_detail", """
    SELECT task_id, seq, 'k : ' || json_extract_string(detail, '$.k') AS line FROM fx_message
    WHERE status = 'FAILURE'
""", ("fx_message",))
def log_explode_detail(spark, sf_dir):
    return messages.detail_lines(fx.fx_message(spark, sf_dir))


@query("log_strip_control", f"""
    SELECT task_id, {STRIP_SQL.format('text')} AS text FROM fx_raw_out
""", ("fx_raw_out",))
def log_strip_control(spark, sf_dir):
    return messages.strip_text(fx.fx_raw_out(spark, sf_dir))


@query("log_lines", """
    SELECT task_id, line_no, line FROM (
        SELECT task_id, unnest(string_split(text, chr(10))) AS line,
               unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM fx_raw_out)
    WHERE length(line) > 0
""", ("fx_raw_out",))
def log_lines(spark, sf_dir):
    return messages.text_lines(fx.fx_raw_out(spark, sf_dir))


@query("log_clean_lines", r"""
    SELECT task_id, count(*) AS n_lines, cast(sum(length(line)) AS bigint) AS n_chars FROM (
        SELECT task_id, regexp_replace(unnest(string_split(text, chr(10))),
                                       '[\x00-\x1f]', '', 'g') AS line FROM fx_raw_out)
    WHERE length(line) > 0 GROUP BY task_id
""", ("fx_raw_out",))
def log_clean_lines(spark, sf_dir):
    """Framing and cleaning of every output text, counted per task."""
    lines = messages.strip_text(messages.text_lines(fx.fx_raw_out(spark, sf_dir)), "line")
    return lines.where(F.length("line") > 0).groupBy("task_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("log_out_then_err", """
    SELECT task_id, stream, line_no, row_number() OVER (
        PARTITION BY task_id ORDER BY CASE stream WHEN 'out' THEN 0 ELSE 1 END, line_no)
        AS emit_no FROM fx_log_line
""", ("fx_log_line",))
def log_out_then_err(spark, sf_dir):
    return history.out_then_err(fx.fx_log_line(spark, sf_dir)).drop("line")


@query("log_drop_empty", """
    SELECT task_id, seq, concat_ws(',', 'err=' || err, 'out=' || "out") AS payload
    FROM fx_message WHERE "out" IS NOT NULL OR err IS NOT NULL
""", ("fx_message",))
def log_drop_empty(spark, sf_dir):
    kept = messages.without_empty(messages.payload(fx.fx_message(spark, sf_dir)))
    return kept.select("task_id", "seq", dictionary_text(F.col("payload")).alias("payload"))


@query("log_accumulate", f"""
    SELECT task_id, line_no // {history.LINES_PER_PIECE} AS piece,
           string_agg(line, chr(10) ORDER BY line_no) AS text
    FROM fx_log_line WHERE stream = 'out' GROUP BY task_id, line_no // {history.LINES_PER_PIECE}
""", ("fx_log_line",))
def log_accumulate(spark, sf_dir):
    return history.accumulate(fx.fx_log_line(spark, sf_dir).where("stream = 'out'"))


@query("log_first_exit", """
    SELECT host, arg_min(exitcode, (ts, id)) AS exitcode FROM fx_command
    WHERE exitcode IS NOT NULL GROUP BY host
""", ("fx_command",))
def log_first_exit(spark, sf_dir):
    return history.first_exit(fx.fx_command(spark, sf_dir))


@query("log_exit_line", r"""
    SELECT id, cast(nullif(regexp_extract(line, '^exitcode=(\d+)', 1), '') AS integer) AS exitcode
    FROM (SELECT id, coalesce('exitcode=' || exitcode, command) AS line FROM fx_command)
""", ("fx_command",))
def log_exit_line(spark, sf_dir):
    lines = fx.fx_command(spark, sf_dir).select("id", F.coalesce(
        F.concat(F.lit("exitcode="), F.col("exitcode").cast("string")), "command").alias("line"))
    return history.exit_lines(lines).select("id", "exitcode")


@query("log_failed", "SELECT host, id, exitcode FROM fx_command WHERE exitcode > 0",
       ("fx_command",))
def log_failed(spark, sf_dir):
    return history.failed(fx.fx_command(spark, sf_dir)).select("host", "id", "exitcode")


@query("log_interleave", """
    SELECT task_id, stream, line_no, row_number() OVER (PARTITION BY task_id ORDER BY
        line_no // 2, CASE stream WHEN 'out' THEN 0 ELSE 1 END, line_no) AS turn_no
    FROM fx_log_line
""", ("fx_log_line",))
def log_interleave(spark, sf_dir):
    return history.interleave(fx.fx_log_line(spark, sf_dir), burst=2).drop("line")


@query("log_command_repr", """
    SELECT id, command || coalesce(' (' || exitcode || ')', '') AS command_repr FROM fx_command
""", ("fx_command",))
def log_command_repr(spark, sf_dir):
    return history.command_repr(fx.fx_command(spark, sf_dir)).select("id", "command_repr")


@query("log_command_tokens", """
    SELECT id, split_part(command, ' ', 1) AS name,
           array_to_string(string_split(command, ' ')[2:], '|') AS args FROM fx_command
""", ("fx_command",))
def log_command_tokens(spark, sf_dir):
    tokens = history.command_tokens(fx.fx_command(spark, sf_dir))
    return tokens.select("id", "name", F.array_join("args", "|").alias("args"))


@query("log_open_tasks", """
    SELECT task_id FROM fx_task WHERE task_id NOT IN (
        SELECT task_id FROM fx_message WHERE status <> 'MSG')
""", ("fx_task", "fx_message"))
def log_open_tasks(spark, sf_dir):
    return history.open_tasks(fx.fx_task(spark, sf_dir), fx.fx_message(spark, sf_dir))


@query("log_progress", """
    SELECT count(*) AS total, count(e.task_id) AS finished,
           count(*) - count(e.task_id) AS open
    FROM fx_task t LEFT JOIN (SELECT DISTINCT task_id FROM fx_message WHERE status <> 'MSG') e
         ON t.task_id = e.task_id
""", ("fx_task", "fx_message"))
def log_progress(spark, sf_dir):
    return history.progress(fx.fx_task(spark, sf_dir), fx.fx_message(spark, sf_dir))


@query("log_history", """
    SELECT host, id, row_number() OVER (PARTITION BY host ORDER BY ts, id) - 1 AS idx
    FROM fx_command
""", ("fx_command",))
def log_history(spark, sf_dir):
    return history.history(fx.fx_command(spark, sf_dir)).select("host", "id", "idx")


@query("log_history_lookup", """
    , numbered AS (SELECT host, command, row_number() OVER (PARTITION BY host ORDER BY ts, id) - 1
                   AS idx FROM fx_command),
    requests AS (SELECT c_custkey % 160 AS host, c_custkey // 160 AS idx FROM customer)
    SELECT host, idx, command FROM requests JOIN numbered USING (host, idx)
""", ("fx_command",))
def log_history_lookup(spark, sf_dir):
    key = F.col("c_custkey")
    requests = table(spark, sf_dir, "customer").select(
        (key % 160).alias("host"), F.floor(key / 160).alias("idx"))
    return history.history_lookup(fx.fx_command(spark, sf_dir), requests).select(
        "host", "idx", "command")


@query("log_tail", """
    SELECT task_id, line_no, line FROM (
        SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY line_no DESC) AS r FROM (
            SELECT task_id, unnest(string_split(text, chr(10))) AS line,
                   unnest(range(0, len(string_split(text, chr(10))))) AS line_no FROM fx_raw_out)
        WHERE length(line) > 0)
    WHERE r <= 10
""", ("fx_raw_out",))
def log_tail(spark, sf_dir):
    return history.tail(messages.text_lines(fx.fx_raw_out(spark, sf_dir)))


@query("log_step_gap", """
    SELECT user_id, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (
        PARTITION BY user_id ORDER BY ts, event_id)) AS gap_us FROM events
""")
def log_step_gap(spark, sf_dir):
    steps = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return history.step_gaps(steps).drop("ts")


# The symbols of generated texts.
ALPHABET = string.ascii_lowercase[:20]


@query("gen_worker_rows", f"""
    WITH hashed AS (
        SELECT c_name AS name, i, md5(c_name || ':' || i || ':0') || md5(c_name || ':' || i || ':1')
               || md5(c_name || ':' || i || ':2') AS h
        FROM customer, range(0, 14) r(i))
    SELECT name, i, array_to_string(list_transform(
        range(1, cast('0x' || substr(h, 1, 4) AS bigint) % {len(ALPHABET)} + 2),
        lambda p: substr('{ALPHABET}', cast('0x' || substr(h, p * 4 + 1, 4) AS bigint)
                         % {len(ALPHABET)} + 1, 1)), '') AS text
    FROM hashed
""")
def gen_worker_rows(spark, sf_dir):
    workers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    return generate.worker_rows(workers, 14, ALPHABET)
