"""Messages of running tasks: routing, cleaning, framing.

Everything here works row by row, so it runs unchanged on batches and streams.
Message columns: ``task_id, seq, ts, status, out, err, text, result, detail``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paramloom.functions.text import lines, strip_control


def route(messages: DataFrame) -> DataFrame:
    """Adds ``route``: message, result or other."""
    return messages.withColumn(
        "route", F.when(F.col("status") == "MSG", "message")
        .when(F.col("status") == "SUCCESS", "result").otherwise("other"))


def decode_message(raw: DataFrame) -> DataFrame:
    """Message columns out of ``raw``, the JSON text ``{status, result, task_id, seq}``.

    While a task runs its result is ``{"message": {"out": ..., "err": ...}}`` or
    ``{"message": text}``; of a finished one it is any value, of others a dictionary
    (``detail``) or a value. What is no JSON has no status, so that it can be found.
    """
    fields = F.from_json(F.col("raw"), "status string, task_id string, seq bigint, result string")
    read = raw.select("raw", fields.alias("f"), F.try_parse_json("raw").alias("v"))
    in_message = F.from_json("f.result", "message string, out string")["message"]
    parts = F.from_json(in_message, "out string, err string")

    def is_a(kind, path):
        found = F.schema_of_variant(F.try_variant_get("v", path, "variant"))
        return F.coalesce(found.startswith(kind), F.lit(False))

    running, done = F.col("f.status") == "MSG", F.col("f.status") == "SUCCESS"
    streams = running & is_a("OBJECT", "$.result.message")
    detail = ~running & ~done & is_a("OBJECT", "$.result")
    return read.select(
        "f.task_id", "f.seq", "f.status",
        F.when(streams, parts["out"]).alias("out"), F.when(streams, parts["err"]).alias("err"),
        F.when(running & is_a("STRING", "$.result.message"), in_message).alias("text"),
        F.when(~running & ~detail, F.col("f.result")).alias("result"),
        F.when(detail, F.col("f.result")).alias("detail"))


def split_streams(messages: DataFrame, clean: bool = False) -> DataFrame:
    """``(task_id, seq, stream, line)`` of the out and err parts that are not empty.

    ``clean`` strips control bytes, from ``out`` only.
    """
    out = strip_control(F.col("out")) if clean else F.col("out")
    parts = F.array(F.struct(F.lit("out").alias("stream"), out.alias("line")),
                    F.struct(F.lit("err").alias("stream"), F.col("err").alias("line")))
    return (messages.where(F.col("status") == "MSG")
            .select("task_id", "seq", F.inline(parts))
            .where(F.length("line") > 0))


def plain_texts(messages: DataFrame) -> DataFrame:
    """``(task_id, seq, text, legacy_line)``; the old line had no task id."""
    return (messages.where((F.col("status") == "MSG") & F.col("text").isNotNull())
            .select("task_id", "seq", "text", F.col("text").alias("legacy_line")))


def results(messages: DataFrame) -> DataFrame:
    """``(task_id, seq, result, legacy_line)`` of finished tasks that returned something."""
    return (messages.where((F.col("status") == "SUCCESS") & F.col("result").isNotNull())
            .select("task_id", "seq", "result",
                    F.concat_ws(",", "task_id", "result").alias("legacy_line")))


def detail_lines(messages: DataFrame) -> DataFrame:
    """``(task_id, seq, line)`` of other states: an entry per row, else the value."""
    entries = F.from_json("detail", "map<string,string>")
    line = F.when(
        F.size(entries) > 0,
        F.transform(F.map_entries(entries),
                    lambda e: F.concat_ws(" : ", e["key"], F.coalesce(e["value"], F.lit("None"))))
    ).otherwise(F.array("result"))
    return (messages.where(~F.col("status").isin("MSG", "SUCCESS"))
            .select("task_id", "seq", F.explode(line).alias("line")))


def legacy_row() -> Column:
    """Row of the result log, NULL for messages that leave none."""
    out = strip_control(F.col("out"))
    return (F.when((F.col("status") == "MSG") & (F.length(out) > 0),
                   F.concat(F.col("task_id"), F.lit(","), out))
            .when((F.col("status") == "MSG") & F.col("text").isNotNull(), F.col("text"))
            .when((F.col("status") == "SUCCESS") & F.col("result").isNotNull(),
                  F.concat(F.col("task_id"), F.lit(","), F.col("result"))))


def strip_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, strip_control(F.col(column)))


def text_lines(df: DataFrame, column: str = "text") -> DataFrame:
    """``(task_id, line_no, line)``: the lines of each text in order, without empty ones.

    ``line_no`` counts all lines from 0.
    """
    return (df.select("task_id", F.posexplode(lines(F.col(column))).alias("line_no", "line"))
            .where(F.length("line") > 0)
            .withColumn("line_no", F.col("line_no").cast("bigint")))


def payload(messages: DataFrame) -> DataFrame:
    """Adds ``payload``, the parts of a message that are there."""
    parts = F.create_map(F.lit("out"), F.col("out"), F.lit("err"), F.col("err"))
    return messages.withColumn("payload", F.map_filter(parts, lambda _, v: v.isNotNull()))


def without_empty(messages: DataFrame) -> DataFrame:
    return messages.where(F.size("payload") > 0)
