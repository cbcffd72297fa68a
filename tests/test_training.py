"""Training: gradients, optimizer, repeatability, resuming."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paramloom.operators import batches, network, reports, training
from paramloom.operators.training import Combination
from paramloom.plans.registry import table
from paramloom.sources.vectors import labelled_split, read_snapshot, states_of, write_snapshot


@pytest.fixture(scope="module")
def split(spark, sf_dir):
    train, test = labelled_split(table(spark, sf_dir, "embeddings"), "vec_id")
    return train.cache(), test.cache()


def run(split, combinations, **more):
    return training.train(*split, "vec_id", "embedding", "label", combinations, 64, 10, **more)


def test_gradient_matches_differences():
    rng = np.random.default_rng(1)
    sizes = [5, 4, 3, 6]
    theta = training.initial_state(sizes, 2).theta + 0.1
    rows, labels = rng.standard_normal((7, 5)), rng.integers(0, 6, 7)
    loss, _, gradient = training.loss_and_gradient(sizes, theta, rows, labels)
    for i in range(0, len(theta), 5):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        up = training.loss_and_gradient(sizes, theta + step, rows, labels, False)[0]
        down = training.loss_and_gradient(sizes, theta - step, rows, labels, False)[0]
        assert gradient[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_zero_weights_give_the_loss_of_guessing(split):
    state = training.initial_state([64, 8, 8, 10], 0)
    done = training.summed(split[0], "embedding", "label", {0: (state.sizes, 0 * state.theta)}, True)
    loss, _, n, gradient = done[0]
    assert n == split[0].count()
    assert loss / n == pytest.approx(math.log(10))
    rows = split[0].select("embedding", "label").toPandas()
    direct = training.loss_and_gradient(
        state.sizes, 0 * state.theta, np.stack(rows["embedding"]).astype(float),
        rows["label"].to_numpy())
    assert gradient == pytest.approx(direct[2], abs=1e-9)


def test_cluster_sums_equal_direct_sums(split):
    """Also where a gradient takes several slices, and rows lie in several tasks."""
    state = training.initial_state([64, 32, 32, 10], 3)
    spread = split[0].repartition(5)
    done = training.summed(spread, "embedding", "label", {7: (state.sizes, state.theta)}, True)[7]
    rows = split[0].select("embedding", "label").toPandas()
    loss, correct, gradient = training.loss_and_gradient(
        state.sizes, state.theta, np.stack(rows["embedding"]).astype(float),
        rows["label"].to_numpy())
    assert len(gradient) > training.SLICE
    assert done[:3] == pytest.approx([loss, correct, len(rows)])
    assert done[3] == pytest.approx(gradient)


def in_one_process(split, combination, tasks):
    """The states after each epoch, by a plain loop over the same batches."""
    state = training.initial_state([64, combination.unit, combination.unit, 10], combination.seed)
    n = split[0].count()
    batches = max(1, math.ceil(n / combination.batchsize))
    rows = split[0].select(F.pmod(F.xxhash64(F.xxhash64("vec_id")), F.lit(batches)).alias("batch"),
                           "embedding", "label")
    out = []
    for epoch in range(1, combination.epochs + 1):
        keyed = rows.withColumn("key", F.xxhash64(F.lit(epoch), "batch")).toPandas()
        for _, batch in sorted(keyed.groupby("key")):
            _, _, gradient = training.loss_and_gradient(
                state.sizes, state.theta, np.stack(batch["embedding"]).astype(float),
                batch["label"].to_numpy())
            training.adam(state, gradient / len(batch), combination.alpha)
        out.append(state.theta.copy())
    return out, state


@pytest.mark.parametrize("tasks", [1, 5])
def test_barrier_epochs_equal_a_plain_loop(spark, split, tasks):
    """Also with networks of several slices, and with more tasks than some batches have rows."""
    combinations = [Combination(0, unit=24, batchsize=7, epochs=2, alpha=0.01, seed=4),
                    Combination(1, unit=5, batchsize=7, epochs=2, alpha=0.02, seed=5)]
    done = run(split, combinations, tasks=tasks)
    states = states_of(done.snapshot(spark))
    assert done.snapshot(spark).count() >= 4
    for c in combinations:
        _, state = in_one_process(split, c, tasks)
        assert states[c.combo_id].step == state.step > 50
        for name in ("theta", "first", "second"):
            assert np.abs(getattr(states[c.combo_id], name) - getattr(state, name)).max() < 1e-9


def test_jobs_follow_epochs_not_batches(spark, split):
    def jobs(batchsize):
        spark.sparkContext.setJobGroup(f"train-{batchsize}", "")
        run(split, [Combination(0, unit=4, batchsize=batchsize, epochs=2)])
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"train-{batchsize}"))
    assert jobs(4) == jobs(400)


def test_loss_falls_and_reruns_agree(spark, split):
    combinations = [Combination(i, unit=8, alpha=a, batchsize=80, epochs=3, seed=1)
                    for i, a in enumerate([0.01, 0.03])]
    first, second = run(split, combinations), run(split, combinations)
    assert [r[:6] for r in first.report] == [r[:6] for r in second.report]
    for combo_id in (0, 1):
        losses = [r[2] for r in first.report if r[0] == combo_id]
        assert len(losses) == 3 and losses[0] > losses[-1]
    assert states_of(first.snapshot(spark))[0].step == 3 * math.ceil(split[0].count() / 80)


def test_resume_equals_uninterrupted(spark, split, tmp_path):
    combinations = [Combination(0, unit=6, alpha=0.02, batchsize=100, epochs=2),
                    Combination(1, unit=9, alpha=0.02, batchsize=1000, epochs=2)]
    whole = run(split, combinations)
    half = run(split, [Combination(c.combo_id, c.unit, c.batchsize, 1, c.alpha)
                       for c in combinations])
    write_snapshot(spark, half, str(tmp_path / "snapshot"))
    resumed = run(split, combinations, resume=read_snapshot(spark, str(tmp_path / "snapshot")))
    states = [states_of(done.snapshot(spark)) for done in (whole, resumed)]
    for c in (0, 1):
        assert np.array_equal(states[0][c].theta, states[1][c].theta)
        assert np.array_equal(states[0][c].second, states[1][c].second)
        assert states[1][c].epoch == 2
    assert [r[1] for r in resumed.report] == [2, 2]
    report = training.report_frame(spark, whole)
    assert report.count() == 4


def test_snapshots_after_each_epoch(spark, split):
    seen = []
    run(split, [Combination(0, unit=4, batchsize=1000, epochs=2)],
        after_epoch=lambda epoch, path: seen.append(
            (epoch, read_snapshot(spark, path).where("slice = 0").first()["epoch"])))
    assert seen == [(1, 1), (2, 2)]


def test_many_combinations_are_trained_in_turns(spark, split, monkeypatch):
    """A network that is larger than the bound is trained alone."""
    combinations = [Combination(i, unit=4, alpha=0.01 * (i + 1), batchsize=1000, epochs=2)
                    for i in range(3)] + [Combination(3, unit=20, batchsize=1000, epochs=2)]
    at_once = run(split, combinations)
    monkeypatch.setattr(training, "HELD", 700)
    in_turns = run(split, combinations)
    assert [len(d.paths) for d in (at_once, in_turns)] == [1, 3]
    assert [r[:6] for r in in_turns.report] == [r[:6] for r in at_once.report]
    states = [states_of(done.snapshot(spark)) for done in (at_once, in_turns)]
    assert set(states[0]) == set(states[1]) == {0, 1, 2, 3}
    for c in range(4):
        assert np.allclose(states[0][c].theta, states[1][c].theta, atol=1e-12, rtol=0)


def test_scoring_keeps_rows_without_a_vector(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [3.0, -4.0])],
                               "id int, v array<double>")
    layers = [(np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([0.5, 0.5])),
              (np.array([[1.0], [1.0]]), np.array([0.0]))]
    assert dict(network.score(df, "v", layers, "z").collect()) == {
        1: [4.0], 2: None, 3: None, 4: [3.5]}


@pytest.mark.parametrize("per_block", [3, 10 ** 6])
def test_minibatches(spark, per_block):
    df = spark.range(0, 100, 3)
    rows = batches.minibatches(df, "id", 10, per_block).collect()
    assert {r["id"]: r["batch"] for r in rows} == {3 * i: i // 10 for i in range(34)}


def test_epoch_batches(spark):
    rows = batches.epoch_batches(spark.range(50), "id", 2, 20).collect()
    by_epoch = {e: [set(r["id"] for r in rows if (r["epoch"], r["batch"]) == (e, b))
                    for b in range(3)] for e in (1, 2)}
    assert [len(s) for s in by_epoch[1]] == [20, 20, 10]
    assert set().union(*by_epoch[1]) == set().union(*by_epoch[2]) == set(range(50))
    assert by_epoch[1] != by_epoch[2]


def test_defaults(spark):
    given = spark.createDataFrame([({"batchsize": "400", "out": "r"},), ({},)],
                                  "params map<string,string>")
    rows = [tuple(r) for r in reports.options(given).orderBy("batchsize").collect()]
    assert rows == [(100, 20, -1, "result", "", 1000), (400, 20, -1, "r", "", 1000)]


def test_report_of_several_runs(spark):
    df = spark.createDataFrame(
        [(c, e, s, float(e + c), 1.0, f"2024-01-01 00:0{e}:00") for c in (1, 2) for e in (0, 1)
         for s in ("main", "validation")],
        "combo_id int, epoch int, split string, loss double, acc double, ts string"
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    report = reports.report(df, ["combo_id"]).orderBy("combo_id", "epoch")
    assert [(r["main_loss"], r["elapsed_time"]) for r in report.collect()] == [
        (1.0, 0.0), (2.0, 60.0), (2.0, 0.0), (3.0, 60.0)]
    assert reports.series(report, ["combo_id"]).count() == 16
    assert reports.evaluate(df, ["combo_id"]).count() == 4


def test_unusable_labels_are_left_out_and_counted(split, spark):
    odd = split[0].withColumn("label", F.when(F.col("vec_id") % 3 == 0, None).when(
        F.col("vec_id") % 3 == 1, F.col("label") + 100).otherwise(F.col("label")))
    done = training.train(odd, split[1], "vec_id", "embedding", "label",
                          [Combination(0, unit=4, batchsize=50, epochs=1)], 64, 10)
    assert done.left_out == odd.where("label is null or label > 9").count() > 0
    assert math.isfinite(done.report[0][2])


def test_wrong_options_are_named(spark):
    given = spark.createDataFrame([({"batchsize": "abc"},), ({},)], "params map<string,string>")
    rows = reports.options(given, wrong="wrong").collect()
    assert [(r["batchsize"], r["wrong"]) for r in rows] == [(None, ["batchsize"]), (100, [])]
