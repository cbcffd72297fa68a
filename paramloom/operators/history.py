"""Logs and commands per task: order, accumulation, exit codes, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paramloom.functions.text import command_arguments, command_name, command_text, exit_code
from paramloom.functions.times import micros
from paramloom.operators import ordering
from paramloom.operators.ordering import ROWS_PER_BLOCK, Blocks, id_blocks, range_blocks, whole

LINES_PER_PIECE = 1_000


def _stream_rank() -> Column:
    return F.when(F.col("stream") == "out", F.lit(0)).otherwise(F.lit(1))


def out_then_err(log: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Adds ``emit_no``: all stdout of a task in order, then all its stderr."""
    blocks = Blocks(F.struct(
        _stream_rank().alias("stream"), whole(F.col("line_no"), rows_per_block).alias("part")))
    return ordering.number_rows(log, ["task_id"], [_stream_rank(), F.col("line_no")],
                                blocks, "emit_no")


def accumulate(log: DataFrame, lines_per_piece: int = LINES_PER_PIECE) -> DataFrame:
    """``(task_id, piece, text)``: the output of each task in order, in pieces.

    A task may have written any amount, so its text comes as numbered pieces of
    ``lines_per_piece`` line numbers each; joined in order they are the whole text.
    """
    piece = whole(F.col("line_no"), lines_per_piece)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    text = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return log.groupBy("task_id", piece.alias("piece")).agg(text.alias("text"))


def output_of(pieces: DataFrame, task_id: str) -> DataFrame:
    """``(piece, text)`` of one task in order; joined by line ends they are its whole output."""
    return pieces.where(F.col("task_id") == task_id).select("piece", "text").orderBy("piece")


def first_exit(commands: DataFrame) -> DataFrame:
    """``(host, exitcode)``: the first code written is kept."""
    return (commands.where(F.col("exitcode").isNotNull()).groupBy("host")
            .agg(F.min_by("exitcode", F.struct("ts", "id")).alias("exitcode")))


def exit_lines(log: DataFrame) -> DataFrame:
    """Adds ``exitcode`` read from lines ``exitcode=N``."""
    return log.withColumn("exitcode", exit_code(F.col("line")))


def failed(commands: DataFrame) -> DataFrame:
    """Commands with a positive exit code; a negative one is not a failure."""
    return commands.where(F.col("exitcode") > 0)


def interleave(log: DataFrame, burst: int = 257,
               rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Adds ``turn_no``: up to ``burst`` lines of one stream, then of the other.

    The position follows from the line's own number and the length of the other
    stream, so no task's lines are sorted together. ``line_no`` counts each stream
    from 0 without gaps; ``out`` comes first.
    """
    is_out = (F.col("stream") == "out").cast("bigint")
    counted = ordering.with_totals(
        log, ["task_id"], id_blocks(F.col("line_no"), rows_per_block),
        {"__n_out": is_out, "__n_err": 1 - is_out})
    turn = whole(F.col("line_no"), burst)
    other = F.when(F.col("stream") == "out", F.least(F.col("__n_err"), turn * burst)) \
        .otherwise(F.least(F.col("__n_out"), (turn + 1) * burst))
    return counted.withColumn("turn_no", F.col("line_no") + 1 + other).drop("__n_out", "__n_err")


def command_repr(commands: DataFrame) -> DataFrame:
    return commands.withColumn("command_repr", command_text(F.col("command"), F.col("exitcode")))


def command_tokens(commands: DataFrame) -> DataFrame:
    return (commands.withColumn("name", command_name(F.col("command")))
            .withColumn("args", command_arguments(F.col("command"))))


def terminal(messages: DataFrame) -> DataFrame:
    """Tasks that have ended, each once."""
    return messages.where(F.col("status") != "MSG").select("task_id").distinct()


def open_tasks(tasks: DataFrame, messages: DataFrame) -> DataFrame:
    return tasks.join(terminal(messages), "task_id", "left_anti")


def progress(tasks: DataFrame, messages: DataFrame) -> DataFrame:
    """``(total, finished, open)`` in one row."""
    ended = terminal(messages).withColumn("ended", F.lit(True))
    return tasks.join(ended, "task_id", "left").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("ended")).alias("finished"),
        F.count_if(F.col("ended").isNull()).alias("open"))


def history(commands: DataFrame) -> DataFrame:
    """Adds ``idx``, the 0-based position of each command on its host.

    A command appended twice counts once: copies are dropped first.
    """
    once = commands.dropDuplicates(["host", "id"])
    return ordering.number_rows(once, ["host"], [F.col("ts"), F.col("id")],
                                range_blocks(), "idx", first=0)


def history_lookup(commands: DataFrame, requests: DataFrame) -> DataFrame:
    """Commands asked for by ``(host, idx)``."""
    return requests.join(history(commands), ["host", "idx"])


def tail(log: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` lines of each task."""
    return ordering.last_rows(log, ["task_id"], [F.col("line_no")], n)


def step_gaps(steps: DataFrame) -> DataFrame:
    """Adds ``gap_us``, microseconds since the previous step of the same user."""
    ordered = ordering.previous(steps, ["user_id"], [F.col("ts"), F.col("event_id")],
                                range_blocks(), F.col("ts"), "__before", rising=True)
    return ordered.withColumn("gap_us", micros(F.col("ts") - F.col("__before"))).drop("__before")
