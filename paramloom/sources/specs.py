"""Parameter specifications as YAML text.

A folder holds any number of documents, one per file or many per file divided by
lines ``---``. Each document is one mapping ``name: value``; a first line
``# spec <id>`` names it, else its file does. Files with many documents are read
in splits, so a folder of specs needs neither one file per spec nor one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paramloom.operators.ordering import spread

DIVIDER = "\n---\n"
# Words that YAML reads as something else than text.
RESERVED = ["true", "false", "yes", "no", "on", "off", "y", "n", "null"]

RAW_SCHEMA = ("spec_id string, ord int, param string, type string, "
              "items array<string>, nested boolean")


def value_text(value) -> str:
    """Text of one value: 12 significant digits for a float, as a task receives it."""
    if isinstance(value, float):
        text = f"{value:.12g}"
        return text if any(c in text for c in ".en") else text + ".0"
    return str(value)


def _loader():
    """PyYAML and its safe loader (the compiled one if there), with the interval tag."""
    try:
        import yaml
    except ImportError as error:
        raise ImportError("reading parameter files needs PyYAML") from error

    class SpecLoader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        """Safe loading, plus the tag for intervals."""

    SpecLoader.add_constructor(
        "tag:yaml.org,2002:python/tuple",
        lambda loader, node: tuple(loader.construct_sequence(node, deep=True)))
    return yaml, SpecLoader


def parse_document(spec_id: str, text: str, yaml, loader) -> list[tuple]:
    """Raw parameter rows of one document; one ``unreadable`` row if it is not a mapping."""
    try:
        data = yaml.load(text, Loader=loader)
    except yaml.YAMLError:
        data = None
        unreadable = True
    else:
        unreadable = not isinstance(data, dict) and data is not None
    if unreadable:
        return [(spec_id, 0, None, "unreadable", None, False)]
    rows = []
    for position, (name, value) in enumerate((data or {}).items(), start=1):
        items, nested = None, False
        if isinstance(value, (list, tuple)):
            items = [value_text(v) for v in value]
            nested = any(isinstance(v, (list, tuple, dict)) for v in value)
        elif value is not None and not isinstance(value, dict):
            items = [value_text(value)]
        rows.append((spec_id, position, str(name), type(value).__name__, items, nested))
    return rows


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["spec_id", "ord", "param", "type", "items", "nested"]
    yaml, loader = _loader()
    for batch in batches:
        rows = [row for spec_id, text in zip(batch["spec_id"], batch["text"])
                for row in parse_document(spec_id, text, yaml, loader)]
        yield pd.DataFrame(rows, columns=columns)


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """Raw parameter rows of every document under ``path``.

    Parsing takes far longer than moving the text, so documents are spread evenly
    first, whatever the files' sizes.
    """
    documents = spark.read.option("lineSep", DIVIDER).text(path)
    named = F.regexp_extract("value", r"^(?:---\n)?# spec (.*)", 1)
    # An unnamed document is named by its file and its place: where its split of the file
    # starts, and its number in the task that reads the split.
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    place = F.concat_ws("#", F.col("_metadata.file_path"),
                        F.col("_metadata.file_block_start").cast("string"), number.cast("string"))
    texts = documents.select(F.when(named != "", named).otherwise(place).alias("spec_id"),
                             F.col("value").alias("text"))
    return spread(texts).mapInPandas(_parse_batches, RAW_SCHEMA)


def _yaml_list(items: Column, bare: Column) -> Column:
    """Items in brackets, quoted like JSON unless ``bare``."""
    return F.when(bare, F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))) \
        .otherwise(F.to_json(items))


def spec_documents(raw: DataFrame) -> DataFrame:
    """``(spec_id, text)``: one YAML document per spec, parameters in declared order.

    Whole numbers are written bare, texts quoted.
    """
    type_, items = F.col("type"), F.col("items")
    first = F.get(items, F.lit(0))
    whole = F.forall(items, lambda v: v.rlike(r"^(0|-?[1-9]\d{0,17})$"))
    numbers = F.forall(items, lambda v: v.try_cast("double").isNotNull())
    quoted = F.to_json(F.array(first))
    value = (
        F.when(type_ == "list", _yaml_list(items, whole))
        .when(type_ == "tuple", F.concat(F.lit("!!python/tuple "), _yaml_list(items, numbers)))
        .when(type_ == "bool", F.lower(first))
        .when(type_.isin("int", "float"), first)
        .when(type_ == "dict", F.lit("{}"))
        .when(items.isNull(), F.lit("null"))
        .otherwise(F.substring(quoted, F.lit(2), F.length(quoted) - 2)))
    bare = F.col("param").rlike(r"^[A-Za-z_][A-Za-z0-9_-]*$") & ~F.lower("param").isin(RESERVED)
    json = F.to_json(F.array("param"))
    name = F.when(bare, F.col("param")).otherwise(F.substring(json, F.lit(2), F.length(json) - 2))
    lines = F.array_sort(F.collect_list(F.struct(
        "ord", F.concat(name, F.lit(": "), value).alias("line"))))
    return raw.groupBy("spec_id").agg(F.concat(
        F.lit("# spec "), F.col("spec_id"), F.lit("\n"),
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("text"))


def write_specs(raw: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes documents that ``read_specs`` reads back to the same rows."""
    (spec_documents(raw).select("text")
     .write.mode(mode).option("lineSep", DIVIDER).text(path))
