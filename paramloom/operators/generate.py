"""Repeatable worker rows: ``name, i, text`` with text over a given alphabet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paramloom.operators import ordering


# Hex digits that pick one symbol, and symbols picked by one MD5.
DIGITS = 4
PER_HASH = 32 // DIGITS


def hex_number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("bigint")


def worker_rows(workers: DataFrame, rows: int, alphabet: str) -> DataFrame:
    """``(name, i, text)``: ``rows`` rows per worker, each text 1 to k symbols long.

    k is the size of the alphabet. Length and symbols follow from the MD5 of name, row
    and a counter, so a recomputed task gives the same rows.
    """
    size = len(alphabet)
    steps = ordering.positions(workers.select("name"), F.lit(rows), "i", ["name"])
    seed = F.concat_ws(":", "name", F.col("i").cast("string"))
    hashes = F.concat(*[F.md5(F.concat(seed, F.lit(f":{block}")))
                        for block in range(-(-(size + 1) // PER_HASH))])

    def pick(position):
        """Number below k out of the hash digits at a position."""
        digits = F.substring("__hash", position * DIGITS + 1, F.lit(DIGITS))
        return F.pmod(hex_number(digits), F.lit(size)).cast("int")

    symbols = F.transform(F.sequence(F.lit(1), pick(F.lit(0)) + 1),
                          lambda p: F.substring(F.lit(alphabet), pick(p) + 1, F.lit(1)))
    return steps.withColumn("__hash", hashes).select(
        "name", "i", F.array_join(symbols, "").alias("text"))
