"""The result log: header rows of dispatched tasks and rows of their messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paramloom.operators.messages import legacy_row

HEADER = r"^(?:[^=,]+=[^,]*,)+$"


def header_rows(tasks: DataFrame) -> DataFrame:
    """``(task_id, value)``: ``id,k=v,k=v,`` per task, the last comma kept."""
    pairs = F.transform(F.map_entries("params"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"], F.lit(",")))
    return tasks.select("task_id", F.concat(
        F.col("task_id"), F.lit(","), F.array_join(pairs, "")).alias("value"))


def message_rows(messages: DataFrame) -> DataFrame:
    """``(task_id, seq, value)``: the log row of every message that leaves one."""
    return (messages.withColumn("value", legacy_row()).where(F.col("value").isNotNull())
            .select("task_id", "seq", "value"))


def write_headers(tasks: DataFrame, path: str) -> None:
    """Starts a new log with the header rows."""
    header_rows(tasks).select("value").write.mode("overwrite").text(path)


def append_messages(messages: DataFrame, path: str) -> None:
    message_rows(messages).select("value").write.mode("append").text(path)


def read_log(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(task_id, kind, params MAP, text)`` with kind header, row or plain.

    The text before the first comma is the task id. A row without a comma is plain
    text without an id. A value that holds a comma cannot be told from two values in
    this format; a header row naming a parameter twice is read as an ordinary row.
    """
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    value, comma = F.col("value"), F.instr("value", ",")
    rest = F.when(comma > 0, F.substring(value, comma + 1, F.length(value)))
    body = F.regexp_replace(rest, ",+$", "")
    names = F.transform(F.split(body, ","), lambda e: F.substring_index(e, "=", 1))
    is_header = F.coalesce(
        rest.rlike(HEADER) & (F.size(F.array_distinct(names)) == F.size(names)), F.lit(False))
    return reader.text(path).select(
        F.when(comma > 0, F.substring(value, F.lit(1), comma - 1)).alias("task_id"),
        F.when(is_header, "header").when(comma > 0, "row").otherwise("plain").alias("kind"),
        F.when(is_header, F.str_to_map(F.when(is_header, body), F.lit(","), F.lit("=")))
        .alias("params"),
        F.when(~is_header, F.coalesce(rest, value)).alias("text"))
