"""Durations in whole microseconds."""

import datetime

from pyspark.sql import functions as F

from paramloom.functions.times import micros

EPOCH = datetime.datetime(1970, 1, 1)
TIMES = ["1969-12-31 23:59:59.999999", "1970-01-01 00:00:00", "2024-03-31 02:30:00.000001",
         "2024-10-27 02:30:00.123456", "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999"]


def test_times_in_any_zone(spark):
    df = spark.createDataFrame([(t,) for t in TIMES], "t string").withColumn(
        "ts", F.col("t").cast("timestamp_ntz"))
    expected = {t: (datetime.datetime.fromisoformat(t) - EPOCH) // datetime.timedelta(microseconds=1)
                for t in TIMES}
    try:
        for zone in ("UTC", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            since = F.col("ts") - F.lit("1970-01-01").cast("timestamp_ntz")
            assert dict(df.select("t", micros(since)).collect()) == expected
            gap = micros(F.lit(None).cast("timestamp_ntz") - F.col("ts"))
            assert df.select(gap.alias("g")).where("g IS NOT NULL").count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
