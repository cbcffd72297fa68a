"""Comma-separated records kept as text: worker records, registry, settings, fleets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def split_records(texts: DataFrame, names: list[str], column: str = "text") -> DataFrame:
    """Lines of a text column to rows; the n-th field of a line gets the n-th name."""
    line = texts.select(F.explode(F.split(column, "\n")).alias("line")) \
        .where(F.length("line") > 0)
    fields = F.split("line", ",")
    return line.select(*[F.get(fields, F.lit(i)).alias(name) for i, name in enumerate(names)])


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Header-less CSV ``command,name,usage`` with its line order as ``ord``.

    ``ord`` rises within a file and over the files in the order of their names.
    """
    rows = spark.read.schema("command string, name string, usage string").csv(path)
    return rows.withColumn("ord", F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row")))


def settings_lines(lines: DataFrame) -> DataFrame:
    """``(file_id, key, value)`` from lines ``KEY="value"``.

    The last assignment of a key wins; a key that it leaves empty is not kept.
    """
    pattern = r'^(\w+)="(.*)"$'
    key = F.regexp_extract("line", pattern, 1)
    value = F.regexp_extract("line", pattern, 2)
    return (lines.select("file_id", "line_no", key.alias("key"), value.alias("value"))
            .where(F.col("key") != "")
            .groupBy("file_id", "key").agg(F.max_by("value", "line_no").alias("value"))
            .where(F.col("value") != ""))


def settings_rows(settings: DataFrame) -> DataFrame:
    """Settings back to ``KEY="value"`` lines, without empty values."""
    return settings.where(F.length("value") > 0).select(
        "file_id", F.concat(F.col("key"), F.lit('="'), F.col("value"), F.lit('"')).alias("line"))


def read_keyed_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(record_id, line)`` of ``key,v1,v2,…`` files; each file is one record."""
    return spark.read.option("pathGlobFilter", glob).text(path).select(
        F.col("_metadata.file_path").alias("record_id"), F.col("value").alias("line"))


def read_settings_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """``(file_id, key, value)`` of settings files, each small enough for one task."""
    lines = spark.read.option("pathGlobFilter", glob).option("wholetext", True).text(path)
    return settings_lines(lines.select(
        F.col("_metadata.file_path").alias("file_id"),
        F.posexplode(F.split("value", "\n")).alias("line_no", "line")))
