"""Exact duplicates with a split for heavy hitters, in DataFrame functions alone.

Texts are compared by the SHA-256 of their normalised form. A Misra-Gries sketch over all rows
(Spark's ``approx_top_k``) names digests that may be frequent; their exact counts and first
rows are computed, and the at most ``CANDIDATES`` winners are broadcast: their rows are decided
where they lie. Only the remaining digests, none of which holds a large share of the rows, are
grouped by an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramloom.llm.tables import written

CANDIDATES = 200
COUNTERS = 2_000
MERGES = 32


def normalised(text: F.Column) -> F.Column:
    """White space runs become one space; null becomes empty."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\f\r", "     ")
    return F.when(F.contains(plain, F.lit("  ")),
                  F.regexp_replace(plain, " {2,}", " ")).otherwise(plain)


def digests(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"),
                       F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))


def heavy_hitters(rows: DataFrame, counters: int = COUNTERS,
                  candidates: int = CANDIDATES) -> DataFrame:
    """``text_sha256, keep_id, group_size`` of frequent digests, exact, ``candidates`` rows at most.

    Rows are counted in ``MERGES`` parts, and the parts' counters are added. A digest with more
    than ``2 / counters`` of all rows has as large a share of some part, and is named there.
    """
    parts = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("part")).agg(
        F.expr(f"approx_top_k(text_sha256, {candidates}, {counters})").alias("top"))
    top = (parts.select(F.explode("top").alias("top")).groupBy("top.item")
           .agg(F.sum("top.count").alias("n")).where("n > 1 and item is not null"))
    named = top.orderBy(F.desc("n"), "item").limit(candidates).select(
        F.col("item").alias("text_sha256"))
    return (rows.join(F.broadcast(named), "text_sha256").groupBy("text_sha256")
            .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for each row of ``docs`` (doc_id, text).

    Of equal texts the row with the smallest doc_id stays; null counts as empty, and empty texts
    are equal to each other. Repeated rows with one doc_id and one text share their fate and
    count in ``group_size``. A null doc_id is larger than any other; a group of nulls alone has a
    null keep_id and stays. Other columns are ignored; an empty table gives an empty result.
    """
    rows = written(digests(docs), "digests")
    heavy = written(heavy_hitters(rows), "heavy-digests")
    split = rows.join(F.broadcast(heavy), "text_sha256", "left")
    decided = split.where("group_size is not null")
    rest = split.where("group_size is null").select("text_sha256", "doc_id")
    groups = rest.groupBy("text_sha256").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    out = decided.unionByName(rest.join(groups, "text_sha256"))
    return out.select("doc_id", "keep_id", "group_size",
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows that ``exact_duplicates`` drops."""
    dropped = exact_duplicates(docs).where("not kept").select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__digest")).distinct()
    same = (F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
            & (F.sha2(normalised(F.col("text")), 256) == F.col("__digest")))
    return docs.join(dropped, same, "left_anti")


SQL = """
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t
  FROM documents
), d AS (SELECT doc_id, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
