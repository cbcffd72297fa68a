"""Sweeps against brute force."""

import itertools
import operator
import random

import pytest
from pyspark.sql import functions as F

from paramloom.operators import folds
from paramloom.operators import sweep
from paramloom.operators.sweep import (Measure, Threshold, parameter_sweep, predicate_sweep,
                                       threshold_sweep)

OPS = {"<=": operator.le, "<": operator.lt, ">=": operator.ge, ">": operator.gt,
       "=": operator.eq}


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    pick = [None, *range(12)]
    return [(rng.choice(pick), rng.choice(pick), rng.choice([None, *range(100)]))
            for _ in range(600)]


def brute(data, conditions, values):
    rows = []
    for combo_id, combo in enumerate(itertools.product(*values)):
        hit = [v for *keys, v in data
               if all(k is not None and OPS[op](k, c)
                      for k, op, c in zip(keys, conditions, combo))]
        known = [v for v in hit if v is not None]
        rows.append((combo_id, *combo, len(hit), sum(known) if known else None,
                     min(known, default=None), max(known, default=None),
                     round(sum(known) / len(known), 9) if known else None))
    return rows


@pytest.mark.parametrize("ops", list(zip(OPS, [">", "=", "<", "<=", ">="])))
@pytest.mark.parametrize("values", [
    ([5, 2, 9], [3, 7]), ([2, 2, 4], [1, 1]), ([-5], [50]), (list(range(100)), [6])])
def test_threshold_sweep(spark, data, ops, values):
    df = spark.createDataFrame(data, "a int, b int, v int")
    v = F.col("v")
    swept = threshold_sweep(
        df, {"x": Threshold(F.col("a"), ops[0], values[0]),
             "y": Threshold(F.col("b"), ops[1], values[1])},
        {"n": Measure("count"), "s": Measure("sum", v), "lo": Measure("min", v),
         "hi": Measure("max", v), "m": Measure("avg", v)})
    got = [tuple(r) for r in swept.withColumn("m", F.round("m", 9)).orderBy("combo_id").collect()]
    assert got == brute(data, ops, values)


def test_one_parameter(spark, data):
    df = spark.createDataFrame(data, "a int, b int, v int")
    swept = threshold_sweep(df, {"x": Threshold(F.col("a"), "<", [4, 8])}, {"n": Measure("count")})
    expected = [sum(a is not None and a < x for a, _, _ in data) for x in (4, 8)]
    assert [r["n"] for r in swept.orderBy("combo_id").collect()] == expected


def test_wrong_thresholds():
    with pytest.raises(ValueError):
        Threshold(None, "!=", [1])
    with pytest.raises(ValueError):
        Threshold(None, "=", [])


def test_predicate_sweep_over_several_passes(spark, data):
    df = spark.createDataFrame(data, "a int, b int, v int")
    combinations = [{"m": m, "r": r} for m in range(1, 20) for r in range(m)]
    swept = predicate_sweep(df, combinations, lambda c: F.col("a") % c["m"] == c["r"],
                            {"n": Measure("count"), "s": Measure("sum", F.col("v"))})
    got = {r["combo_id"]: (r["n"], r["s"]) for r in swept.collect()}
    assert len(got) == len(combinations) == 190
    for i, c in enumerate(combinations):
        hit = [v for a, _, v in data if a is not None and a % c["m"] == c["r"]]
        known = [v for v in hit if v is not None]
        assert got[i] == (len(hit), sum(known) if known else None)


@pytest.mark.parametrize("k", [1, 2, 5])
def test_folds_are_disjoint_and_cover(spark, k):
    rows = folds.fold_rows(spark.range(50), "id", k).collect()
    test = [r["id"] for r in rows if r["part"] == "test"]
    assert sorted(test) == list(range(50))
    for f in range(k):
        train = {r["id"] for r in rows if r["fold"] == f and r["part"] == "train"}
        held = {r["id"] for r in rows if r["fold"] == f and r["part"] == "test"}
        assert train | held == set(range(50))
        assert (train == held) if k == 1 else not train & held


def test_many_predicates_are_one_scan(spark, sf_dir):
    from paramloom.operators.sweep import Measure, predicate_sweep
    facts = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    swept = predicate_sweep(
        facts, [{"q": i / 20} for i in range(1000)], lambda c: F.col("l_quantity") < c["q"],
        {"n": Measure("count"), "price": Measure("sum", F.col("l_extendedprice"))})
    assert swept._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert swept.count() == 1000


def _grid(spark, combos):
    return spark.createDataFrame([(f"s{i % 2}", i, c) for i, c in enumerate(combos)],
                                 "spec_id string, combo_id bigint, params map<string,string>")


CONDITIONS = {"m": lambda v: F.col("a") % int(v) == 0, "r": lambda v: F.col("b") > int(v),
              "odd": lambda v: (F.col("v") % 2 == 1) == (v == "true")}
PLAIN = {"m": lambda a, b, v, x: a is not None and a % int(x) == 0,
         "r": lambda a, b, v, x: b is not None and b > int(x),
         "odd": lambda a, b, v, x: v is not None and (v % 2 == 1) == (x == "true")}


@pytest.mark.parametrize("combos", [
    [{"m": str(m), "r": str(r), "odd": o} for m in range(1, 20) for r in (0, 3, 3, 50)
     for o in ("true", "false")],                                     # full, a value twice
    [{"m": "2", "r": "1", "odd": "true"}, {"m": "3", "r": "4", "odd": "false"}],   # no product
    [{"m": "2"}, {"r": "5", "other": "x"}, {}, {"m": "2"}],           # lacking, unknown, repeated
])
def test_parameter_sweep(spark, data, combos):
    df = spark.createDataFrame(data, "a int, b int, v int")
    swept = parameter_sweep(df, _grid(spark, combos), CONDITIONS, {
        "n": Measure("count"), "s": Measure("sum", F.col("v")), "lo": Measure("min", F.col("v")),
        "hi": Measure("max", F.col("v")), "mean": Measure("avg", F.col("v"))})
    got = {(r["spec_id"], r["combo_id"]): r[2:] for r in swept.collect()}
    assert len(got) == len(combos)
    for i, c in enumerate(combos):
        hit = [v for a, b, v in data
               if all(PLAIN[n](a, b, v, x) for n, x in c.items() if n in PLAIN)]
        known = [v for v in hit if v is not None]
        mean = sum(known) / len(known) if known else None
        assert got[f"s{i % 2}", i] == (len(hit), sum(known) if known else None, min(known, default=None),
                                       max(known, default=None), mean)


def test_parameter_sweep_without_rows_or_combinations(spark, data):
    df = spark.createDataFrame(data, "a int, b int, v int")
    n = {"n": Measure("count")}
    assert parameter_sweep(df, _grid(spark, [{}]).limit(0), CONDITIONS, n).collect() == []
    assert predicate_sweep(df, [], lambda c: F.lit(True), n).collect() == []
    empty = parameter_sweep(df.limit(0), _grid(spark, [{"m": "2"}]), CONDITIONS, n)
    assert [tuple(r) for r in empty.collect()] == [("s0", 0, 0)]


def test_rows_are_added_up_before_they_meet_combinations(spark, sf_dir):
    """Many combinations are one scan, and what is shuffled first is sums of rows."""
    facts = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    combos = [{"m": str(m), "r": str(r)} for m in range(100) for r in range(100)]
    swept = parameter_sweep(
        facts, _grid(spark, combos),
        {"m": lambda v: F.col("l_quantity") < float(v), "r": lambda v: F.col("l_linenumber") == int(v)},
        {"n": Measure("count")})
    plan = swept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert swept.count() == 10_000


def test_too_many_conditions_are_refused(spark, data, monkeypatch):
    monkeypatch.setattr(sweep, "MOST_CONDITIONS", 2)
    df = spark.createDataFrame(data, "a int, b int, v int")
    with pytest.raises(ValueError):
        parameter_sweep(df, _grid(spark, [{"m": str(m)} for m in range(1, 5)]), CONDITIONS,
                        {"n": Measure("count")})


@pytest.mark.parametrize("few", [0, 3, 32])
def test_rows_of_few_and_of_many_choices(spark, monkeypatch, few):
    """Rows are added to the same combinations at once or by their answers, NULL answers too."""
    monkeypatch.setattr(sweep, "FEW_CHOICES", few)
    rows = [(i, None if i % 9 == 4 else i % 7, float(i)) for i in range(60)] + [(None, 1, 1.0)]
    facts = spark.createDataFrame(rows, "a int, b int, x double")
    divisors, limits = range(1, 7), range(0, 6, 2)
    grid = spark.createDataFrame(
        [(10 * d + m, {"d": str(d), "m": str(m)}) for d in divisors for m in limits],
        "combo_id int, params map<string,string>")
    swept = sweep.parameter_sweep(
        facts, grid, {"d": lambda v: F.col("a") % int(v) == 0, "m": lambda v: F.col("b") > int(v)},
        {"n": sweep.Measure("count"), "x": sweep.Measure("sum", F.col("x"))})
    held = {10 * d + m: [x for a, b, x in rows if a is not None and a % d == 0
                         and b is not None and b > m] for d in divisors for m in limits}
    assert {r["combo_id"]: (r["n"], r["x"]) for r in swept.collect()} == {
        c: (len(xs), sum(xs) if xs else None) for c, xs in held.items()}
