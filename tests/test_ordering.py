"""Blocked ordered computations against plain windows, with hot and NULL keys."""

import random

import pytest
from pyspark.sql import Window, functions as F

from paramloom.functions.buckets import search_sorted
from paramloom.operators import ordering


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    ids = rng.sample(range(-50, 5000), 900)
    data = [(None if i % 17 == 0 else "hot" if i % 3 else f"k{i % 20}", i, rng.randint(-9, 9))
            for i in ids]
    return spark.createDataFrame(data, "k string, id bigint, v int").cache()


def same(left, right):
    assert sorted(map(tuple, left.collect()), key=repr) == \
        sorted(map(tuple, right.select(left.columns).collect()), key=repr)


@pytest.mark.parametrize("width", [1, 7, 100, 10 ** 6])
def test_running_sum(rows, width):
    window = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    same(ordering.running_sum(rows, ["k"], [F.col("id")], ordering.id_blocks(F.col("id"), width),
                              F.col("v"), "s"),
         rows.withColumn("s", F.sum("v").over(window)))


@pytest.mark.parametrize("keys", [["k"], []])
def test_number_rows(rows, keys):
    window = Window.partitionBy(*keys).orderBy("id")
    same(ordering.number_rows(rows, keys, [F.col("id")], ordering.id_blocks(F.col("id"), 64),
                              "n", first=0),
         rows.withColumn("n", F.row_number().over(window).cast("bigint") - 1))


@pytest.mark.parametrize("column, rising", [("id", False), ("id", True), ("v", False)])
def test_previous(rows, column, rising):
    window = Window.partitionBy("k").orderBy("id")
    same(ordering.previous(rows, ["k"], [F.col("id")], ordering.id_blocks(F.col("id"), 10),
                           F.col(column), "before", rising),
         rows.withColumn("before", F.lag(column).over(window)))


def test_totals(rows):
    window = Window.partitionBy("k")
    same(ordering.with_totals(rows, ["k"], ordering.id_blocks(F.col("id"), 100),
                              {"a": F.col("v"), "b": F.lit(1)}),
         rows.withColumn("a", F.sum("v").over(window))
         .withColumn("b", F.count("id").over(window)))


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_range_blocks(rows, kind):
    """Also with tied and NULL times."""
    timed = rows.withColumn(
        "ts", F.when(F.col("id") % 3 > 0, F.lit("2024-01-01").cast(kind) + F.make_dt_interval(
            secs=F.floor(F.col("id") / 100).cast("decimal(18,6)"))))
    window = Window.partitionBy("k").orderBy("ts", "id")
    same(ordering.number_rows(timed, ["k"], [F.col("ts"), F.col("id")],
                              ordering.range_blocks(), "n"),
         timed.withColumn("n", F.row_number().over(window).cast("bigint")))
    same(ordering.previous(timed, ["k"], [F.col("ts"), F.col("id")], ordering.range_blocks(),
                           F.col("ts"), "before", rising=True),
         timed.withColumn("before", F.lag("ts").over(window)))


@pytest.mark.parametrize("time", ["2024-01-01", None])
def test_equal_times_are_split(spark, time):
    host = spark.range(20_000).select(
        F.lit("h").alias("k"), F.lit(time).cast("timestamp").alias("ts"), "id")
    cut = ordering._cut(host, ["k"], [F.col("ts"), F.col("id")], ordering.range_blocks())
    sizes = [r["count"] for r in cut.groupBy("__block").count().collect()]
    assert len(sizes) == 4
    assert max(sizes) < 10_000


def test_ranges_with_a_further_column(spark, tmp_path):
    """More rows than range sampling takes whole; the heads don't need ``command``, the rows do."""
    path = str(tmp_path / "commands")
    key = F.col("id") % 3
    spark.range(600_000).select(
        key.alias("k"), F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(10 ** 5))).alias("ts"),
        "id", F.concat(F.lit("c"), "id").alias("command")).write.parquet(path)
    commands = spark.read.parquet(path)
    order = [F.col("ts"), F.col("id")]
    numbered = ordering.number_rows(commands, ["k"], order, ordering.range_blocks(), "n")
    got = numbered.select("k", "command", "n").groupBy("k").agg(
        F.count_distinct("n"), F.min("n"), F.max("n"), F.count_distinct("command"))
    assert {tuple(r) for r in got.collect()} == {
        (k, 200_000, 1, 200_000, 200_000) for k in range(3)}
    window = Window.partitionBy("k").orderBy(*order)
    before = ordering.previous(commands, ["k"], order, ordering.range_blocks(), F.col("ts"), "b", True)
    plain = commands.withColumn("b", F.lag("ts").over(window)).select("k", "command", "b")
    assert before.select("k", "command", "b").exceptAll(plain).isEmpty()


def test_nothing_runs_while_building(spark, rows):
    spark.sparkContext.setJobGroup("build", "build")
    made = [ordering.number_rows(rows, ["k"], [F.col("id")], blocks, "n")
            for blocks in (ordering.id_blocks(F.col("id"), 10), ordering.range_blocks())]
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("build")
    assert [df.count() for df in made] == [900, 900]
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("build")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_input_is_scanned_twice_at_most(spark, sf_dir):
    log = spark.read.parquet(f"{sf_dir}/events.parquet")
    made = ordering.number_rows(log, ["user_id"], [F.col("event_id")],
                                ordering.id_blocks(F.col("event_id")), "n")
    assert made._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2


def test_last_rows(rows):
    window = Window.partitionBy("k").orderBy(F.col("id").desc())
    same(ordering.last_rows(rows, ["k"], [F.col("id")], 10),
         rows.withColumn("r", F.row_number().over(window)).where("r <= 10").drop("r"))


def test_positions_split_hot_rows(spark):
    df = spark.createDataFrame([("a", 25_000), ("b", 0), ("c", 3), ("d", None)],
                               "k string, n bigint")
    made = ordering.positions(df, F.col("n"), "i", ["k"], block=1000)
    got = {r["k"]: (r["c"], r["lo"], r["hi"], r["d"]) for r in made.groupBy("k").agg(
        F.count("i").alias("c"), F.min("i").alias("lo"), F.max("i").alias("hi"),
        F.count_distinct("i").alias("d")).collect()}
    assert got == {"a": (25_000, 0, 24_999, 25_000), "c": (3, 0, 2, 3)}


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 127, 128, 300])
@pytest.mark.parametrize("right", [False, True])
def test_search_sorted(spark, n, right):
    import bisect
    points = [3 * i for i in range(n)]
    values = [None, *range(-2, 3 * n + 2)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    side = bisect.bisect_right if right else bisect.bisect_left
    got = dict(df.select("v", search_sorted(F.col("v"), points, right)).collect())
    assert got == {v: None if v is None else side(points, v) for v in values}
