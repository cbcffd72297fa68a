"""Grids: literal combinations, order, counts, dictionaries, options."""

import itertools
import json

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from paramloom.functions import params
from paramloom.operators import grid, ordering, specs

VALUES = "spec_id string, ord int, param string, kind string, values array<string>"


def values_of(spark, **specs):
    return spark.createDataFrame(
        [(spec, i, name, "list", [str(v) for v in options])
         for spec, dims in specs.items() for i, (name, options) in enumerate(dims.items())],
        VALUES)


def combos(df, spec="s"):
    rows = df.where(F.col("spec_id") == spec).orderBy("combo_id").select(
        "combo_id", F.map_values("params").alias("values")).collect()
    assert [r["combo_id"] for r in rows] == list(range(len(rows)))
    return [tuple(r["values"]) for r in rows]


def test_last_parameter_is_fastest(spark):
    dims = {"i": [0, 1], "c": ["a", "b"], "n": [1, 2, 3]}
    expected = [tuple(map(str, c)) for c in itertools.product(*dims.values())]
    made = values_of(spark, s=dims)
    assert len(expected) == 12
    assert combos(grid.grid(made)) == expected
    assert combos(grid.grid(made, block=5)) == expected
    folded = grid.grid_by_folding(made).orderBy("combo_id").collect()
    assert [tuple(r["combination"]) for r in folded] == expected
    ranged = grid.grid_range(spark, dims).orderBy("combo_id").collect()
    assert [tuple(map(str, r[1:])) for r in ranged] == expected


def test_documented_example_has_six(spark):
    made = values_of(spark, s={"gpu": [-1], "batchsize": [100, 500], "epoch": [5, 10, 15]})
    assert grid.cardinality(made).collect() == [("s", 6)]
    assert grid.grid(made).count() == 6


@settings(max_examples=8, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=4),
                         min_size=1, max_size=4), min_size=1, max_size=3))
def test_decoding_equals_folding_and_count(spark, specs):
    made = values_of(spark, **{f"s{i}": {f"p{j}": v for j, v in enumerate(dims)}
                               for i, dims in enumerate(specs)})
    decoded = sorted((r[0], r[1], tuple(r[2])) for r in grid.grid(made, block=3).select(
        "spec_id", "combo_id", F.map_values("params")).collect())
    folded = sorted((r[0], r[1], tuple(r[2])) for r in grid.grid_by_folding(made).collect())
    product = sorted((f"s{i}", c, tuple(map(str, v))) for i, dims in enumerate(specs)
                     for c, v in enumerate(itertools.product(*dims)))
    assert decoded == folded == product
    assert dict(grid.cardinality(made).collect()) == {
        f"s{i}": len(list(itertools.product(*dims))) for i, dims in enumerate(specs)}


def test_too_many_combinations(spark):
    made = values_of(spark, big={f"p{i}": range(10) for i in range(20)},
                     s={"a": [1]})
    assert dict(grid.cardinality(made).collect()) == {"big": None, "s": 1}
    assert grid.grid(made).count() == 1
    with pytest.raises(ValueError):
        grid.grid_range(spark, {f"p{i}": list(range(10)) for i in range(20)})


def test_filter_runs_before_anything_is_built(spark):
    dims = {f"p{i}": list(range(10)) for i in range(6)}
    assert grid.grid_range(spark, dims).where("p0 = 3 AND p5 = 4").count() == 10_000


def test_carry_forward(spark):
    steps = spark.createDataFrame([("r", c) for c in range(5)], "run string, c bigint")
    for width in (1, 2, 100):
        carried = grid.carry_forward(steps, "run", "c", "c", base=5, rows_per_block=width)
        assert [r["n"] for r in carried.orderBy("c").collect()] == [5, 6, 8, 11, 15]


def evaluate(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def dictionary(**entries):
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def test_overlay_keeps_base_and_prefers_top(spark):
    top = dictionary(n="7", m="1")
    laid = params.overlay(dictionary(n="5", base="b"), F.map_keys(top), top)
    assert evaluate(spark, laid) == {"base": "b", "n": "7", "m": "1"}


def test_options(spark):
    text = params.options_text(dictionary(batchsize="100", verbose="", epoch="5"))
    assert evaluate(spark, text) == "--batchsize 100 --verbose --epoch 5"


def test_json_both_ways(spark):
    entries = dictionary(a="1", b='x "y"')
    text = evaluate(spark, params.to_json(entries))
    assert json.loads(text) == {"a": "1", "b": 'x "y"'}
    assert evaluate(spark, params.from_json(F.lit(text))) == {"a": "1", "b": 'x "y"'}
    decoded = params.from_json(F.lit("not json"), dictionary(a="0"))
    assert evaluate(spark, decoded) == {"a": "0"}


def test_task_id_is_repeatable_and_distinct(spark):
    made = values_of(spark, s={"a": [1, 2], "b": [1, 2]}, t={"a": [1, 2], "b": [1, 2]})
    ids = [r["task_id"] for r in grid.tasks(grid.grid(made)).collect()]
    again = [r["task_id"] for r in grid.tasks(grid.grid(made, block=1)).collect()]
    assert sorted(ids) == sorted(again)
    assert len(set(ids)) == 8


def test_concat(spark):
    joined = grid.concat_values(F.array(F.lit("a")), F.array(F.lit("b"), F.lit("c")))
    assert evaluate(spark, joined) == ["a", "b", "c"]


def test_folding_takes_all_parameters(spark):
    made = values_of(spark, s={f"p{i}": [0, 1] for i in range(5)}, t={"a": [1]})
    assert grid.grid_by_folding(made).count() == 33


def test_positions_of_large_counts_make_no_large_arrays(spark):
    from paramloom.operators import ordering
    rows = spark.createDataFrame([("a", 10), ("b", 70_001)], "k string, n bigint")
    made = ordering.positions(rows, F.col("n"), "i", ["k"], block=1)
    assert made.groupBy("k").agg(F.count("*"), F.count_distinct("i"), F.max("i")).orderBy(
        "k").collect() == [("a", 10, 10, 9), ("b", 70_001, 70_001, 70_000)]


WIDE = "spec_id string, ord int, param string, type string, items array<string>, nested boolean"


def test_wide_intervals_stay_rules(spark):
    """Ten million values times three: rows stay small, and any combination can be read."""
    raw = spark.createDataFrame([
        ("s", 1, "epoch", "tuple", ["0", "10000000"], False),
        ("s", 2, "rate", "list", ["a", "b", "c"], False),
        ("t", 1, "part", "tuple", ["0.5", "-2", "-0.25"], False),
        ("t", 2, "none", "bool", ["False"], False)], WIDE)
    dims = specs.param_dimensions(raw)
    assert {r["param"]: (r["n"], r["items"]) for r in dims.collect()} == {
        "epoch": (10_000_000, None), "rate": (3, ["a", "b", "c"]), "part": (10, None)}
    made = grid.grid(dims)
    assert made.where("spec_id = 't'").orderBy("combo_id").select("params.part").collect() == [
        (v,) for v in "0.5 0.25 0 -0.25 -0.5 -0.75 -1 -1.25 -1.5 -1.75".split()]
    checked = made.where("spec_id = 's'").select(
        "combo_id", F.col("params")["epoch"].cast("bigint").alias("epoch"),
        F.col("params")["rate"].alias("rate"))
    right = (F.col("epoch") == F.expr("combo_id div 3")) & (
        F.col("rate") == F.expr("substr('abc', int(combo_id % 3) + 1, 1)"))
    assert checked.agg(F.count("*"), F.count_if(right)).first() == (30_000_000, 30_000_000)


def test_long_lists_are_carried_by_block(spark):
    long = [str(i) for i in range(30_000)]
    raw = spark.createDataFrame([("s", 1, "i", "list", long, False),
                                 ("s", 2, "j", "list", ["x", "y"], False)], WIDE)
    dims = specs.param_dimensions(raw)
    right = (F.col("params")["i"].cast("bigint") == F.expr("combo_id div 2")) & (
        F.col("params")["j"] == F.expr("if(combo_id % 2 = 0, 'x', 'y')"))
    made = grid.grid(dims, block=1 << 10)
    assert made.agg(F.count("*"), F.count_if(right)).first() == (60_000, 60_000)
    folded = grid.grid_by_folding(dims).select("combo_id", F.map_from_arrays(
        F.array(F.lit("i"), F.lit("j")), "combination").alias("params"))
    assert folded.agg(F.count("*"), F.count_if(right)).first() == (60_000, 60_000)
    # Blocks hold as many combinations as the spec lists values.
    blocks = ordering.position_blocks(grid.dimensions(dims), F.col("combinations"), ["spec_id"],
                                      F.lit(30_002))
    assert blocks.count() == 2
