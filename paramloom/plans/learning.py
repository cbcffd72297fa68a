"""Queries on mini-batches, scoring, evaluation, reports and training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from paramloom.functions.vectors import relu
from paramloom.operators import batches, network, reports, training
from paramloom.operators.training import Combination
from paramloom.plans import fixtures as fx
from paramloom.plans.registry import query, table
from paramloom.session import work_path
from paramloom.sources.vectors import labelled_split, read_snapshot, states_of, write_snapshot

DIMENSIONS, HIDDEN, CLASSES = 64, 16, 10
# Rows of a training step, whatever the size of the table.
BATCH = 400


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _network():
    return [fx.layer_weights(DIMENSIONS, HIDDEN), fx.layer_weights(HIDDEN, HIDDEN),
            fx.layer_weights(HIDDEN, CLASSES)]


def _scored(spark, sf_dir):
    return network.score(_embeddings(spark, sf_dir), "embedding", _network())


def _hidden(spark, sf_dir):
    return network.score(_embeddings(spark, sf_dir), "embedding", _network()[:1], "z")


def _units(scored, column):
    # Adding 0 takes the sign off a zero.
    return network.unit_rows(scored, "vec_id", column).withColumn(
        "value", F.round("value", 6) + F.lit(0.0))


UNITS_SQL = """
    SELECT vec_id, unnest(range(0, len({0})))::integer AS unit,
           unnest(list_transform({0}, lambda x: round(x, 6) + 0.0)) AS value FROM {1}
"""


@query("src_labelled_split", """
    SELECT vec_id, label, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS part
    FROM embeddings
""")
def src_labelled_split(spark, sf_dir):
    train, test = labelled_split(_embeddings(spark, sf_dir), "vec_id")
    return train.select("vec_id", "label", F.lit("train").alias("part")).unionByName(
        test.select("vec_id", "label", F.lit("test").alias("part")))


@query("ml_minibatch", """
    SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 100 AS batch FROM embeddings
    WHERE vec_id % 5 = 0
""")
def ml_minibatch(spark, sf_dir):
    _, test = labelled_split(_embeddings(spark, sf_dir).select("vec_id"), "vec_id")
    return batches.minibatches(test, "vec_id", 100)


@query("ml_epoch_shuffle", """
    SELECT vec_id, epoch, (row_number() OVER (
        PARTITION BY epoch ORDER BY md5(epoch || ':' || vec_id), vec_id) - 1) // 100 AS batch
    FROM embeddings, (SELECT unnest([1, 2, 3]) AS epoch) WHERE vec_id % 5 <> 0
""")
def ml_epoch_shuffle(spark, sf_dir):
    train, _ = labelled_split(_embeddings(spark, sf_dir).select("vec_id"), "vec_id")
    return batches.epoch_batches(train, "vec_id", epochs=3, batchsize=100)


@query("ml_linear", UNITS_SQL.format("z", "fx_hidden"), ("fx_hidden",))
def ml_linear(spark, sf_dir):
    return _units(_hidden(spark, sf_dir), "z")


@query("ml_relu", UNITS_SQL.format("h", """(
    SELECT vec_id, list_transform(z, lambda x: greatest(x, 0.0)) AS h FROM fx_hidden)"""),
       ("fx_hidden",))
def ml_relu(spark, sf_dir):
    return _units(_hidden(spark, sf_dir).withColumn("h", relu(F.col("z"))), "h")


@query("ml_forward", UNITS_SQL.format("z", "fx_logits"), ("fx_logits",))
def ml_forward(spark, sf_dir):
    return _units(_scored(spark, sf_dir), "logits")


def _judged(spark, sf_dir):
    return network.with_loss(_scored(spark, sf_dir), F.col("label"))


@query("ml_cross_entropy", "SELECT vec_id, round(loss, 6) AS loss FROM fx_judged", ("fx_judged",))
def ml_cross_entropy(spark, sf_dir):
    return _judged(spark, sf_dir).select("vec_id", F.round("loss", 6).alias("loss"))


@query("ml_accuracy", """
    SELECT label, count(*) AS n_rows, cast(sum(correct) AS bigint) AS n_correct
    FROM fx_judged GROUP BY label
""", ("fx_judged",))
def ml_accuracy(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("correct").alias("n_correct"))


@query("ml_validation", """
    SELECT round(avg(loss), 6) AS loss, round(avg(correct), 6) AS accuracy, count(*) AS n_rows
    FROM fx_judged WHERE vec_id % 5 = 0
""", ("fx_judged",))
def ml_validation(spark, sf_dir):
    """One validation pass of a given network over the test rows."""
    _, test = labelled_split(_embeddings(spark, sf_dir), "vec_id")
    judged = network.with_loss(network.score(test, "embedding", _network()), F.col("label"))
    return judged.agg(F.round(F.avg("loss"), 6).alias("loss"),
                      F.round(F.avg("correct"), 6).alias("accuracy"),
                      F.count(F.lit(1)).alias("n_rows"))


def _last_layer_sums(spark, sf_dir):
    """Row count and gradient sums of the whole table under the given network."""
    sizes = [DIMENSIONS, HIDDEN, HIDDEN, CLASSES]
    theta = np.concatenate([part.ravel() for layer in _network() for part in layer])
    _, _, n, gradient = training.summed(
        _embeddings(spark, sf_dir), "embedding", "label", {0: (sizes, theta)}, gradient=True)[0]
    return training.State(sizes, theta, 0 * theta, 0 * theta), n, gradient


def _last_layer_frame(spark, values, name):
    """The last layer of a parameter vector, which is model-sized, as rows."""
    last = values[-(HIDDEN + 1) * CLASSES:].reshape(HIDDEN + 1, CLASSES)
    rows = [(i, j, round(float(last[i, j]), 6) + 0.0)
            for i in range(HIDDEN + 1) for j in range(CLASSES)]
    return spark.createDataFrame(rows, f"input int, class int, {name} double")


@query("ml_gradient", """
    SELECT input, class, round(gradient, 6) + 0.0 AS gradient FROM fx_gradient
""", ("fx_gradient",))
def ml_gradient(spark, sf_dir):
    """Gradient sums of the last layer, added up over the cluster."""
    _, _, gradient = _last_layer_sums(spark, sf_dir)
    return _last_layer_frame(spark, gradient, "gradient")


@query("ml_adam_step", """
    SELECT input, class, round(CASE WHEN input < 16
               THEN ((input * 31 + class * 17) % 7 - 3) / 64.0 ELSE (class % 3 - 1) / 10.0 END
           - 0.01 * sqrt(1 - 0.999) / (1 - 0.9) * 0.1 * g / (sqrt(0.001 * g * g) + 1e-4), 6) + 0.0
           AS weight
    FROM (SELECT input, class, gradient / n AS g FROM fx_gradient)
""", ("fx_gradient",))
def ml_adam_step(spark, sf_dir):
    """The last layer after one full-batch step."""
    state, n, gradient = _last_layer_sums(spark, sf_dir)
    training.adam(state, gradient / n, alpha=0.01, eps=1e-4)
    return _last_layer_frame(spark, state.theta, "weight")


def _rounded(df, names):
    return df.withColumns({name: F.round(name, 6) for name in names})


@query("ml_evaluate", """
    SELECT epoch, round(avg(loss), 6) AS loss, round(avg(acc), 6) AS accuracy, count(*) AS n_rows
    FROM fx_report WHERE split = 'validation' GROUP BY epoch
""", ("fx_report",))
def ml_evaluate(spark, sf_dir):
    return _rounded(reports.evaluate(fx.fx_report(spark, sf_dir)), ["loss", "accuracy"])


@query("ml_epoch_log", """
    SELECT epoch, split, round(avg(loss), 6) AS loss, round(avg(acc), 6) AS accuracy
    FROM fx_report GROUP BY epoch, split
""", ("fx_report",))
def ml_epoch_log(spark, sf_dir):
    return _rounded(reports.epoch_log(fx.fx_report(spark, sf_dir)), ["loss", "accuracy"])


REPORT_SQL = """
    SELECT epoch, round(avg(loss) FILTER (split = 'main'), 6) AS main_loss,
           round(avg(loss) FILTER (split = 'validation'), 6) AS validation_main_loss,
           round(avg(acc) FILTER (split = 'main'), 6) AS main_accuracy,
           round(avg(acc) FILTER (split = 'validation'), 6) AS validation_main_accuracy,
           round((epoch_us(max(ts)) - min(epoch_us(min(ts))) OVER ()) / 1e6, 6) AS elapsed_time
    FROM fx_report GROUP BY epoch
"""


@query("ml_report", REPORT_SQL, ("fx_report",))
def ml_report(spark, sf_dir):
    return _rounded(reports.report(fx.fx_report(spark, sf_dir)),
                    [*reports.SERIES, "elapsed_time"])


@query("ml_series", f"""
    UNPIVOT (SELECT epoch, main_loss, validation_main_loss, main_accuracy,
                    validation_main_accuracy FROM ({REPORT_SQL}))
    ON main_loss, validation_main_loss, main_accuracy, validation_main_accuracy
    INTO NAME series VALUE value
""", ("fx_report",))
def ml_series(spark, sf_dir):
    return reports.series(ml_report(spark, sf_dir))


@query("ml_defaults", """
    SELECT c_custkey AS id,
           CASE WHEN c_custkey % 2 = 0 THEN cast(50 + c_custkey % 100 AS integer) ELSE 100 END
               AS batchsize,
           20 AS epoch, -1 AS gpu,
           CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'result' END AS "out",
           '' AS resume, 1000 AS unit
    FROM customer
""")
def ml_defaults(spark, sf_dir):
    key = F.col("c_custkey")
    given = F.map_filter(F.create_map(
        F.lit("batchsize"), F.when(key % 2 == 0, (key % 100 + 50).cast("string")),
        F.lit("out"), F.when(key % 3 == 0, F.col("c_name"))), lambda _, v: v.isNotNull())
    return reports.options(table(spark, sf_dir, "customer").select(
        key.alias("id"), given.alias("params")))


def _combinations(epochs, batchsize):
    """A small grid of network width and learning rate."""
    grid = [(unit, alpha) for unit in (8, HIDDEN) for alpha in (0.002, 0.01)]
    return [Combination(i, unit=unit, alpha=alpha, batchsize=batchsize, epochs=epochs, seed=7)
            for i, (unit, alpha) in enumerate(grid)]


def _train(spark, sf_dir, epochs, **more):
    train, test = labelled_split(_embeddings(spark, sf_dir), "vec_id")
    return training.train(train, test, "vec_id", "embedding", "label",
                          _combinations(epochs, BATCH), DIMENSIONS, CLASSES, **more)


@query("run_train_per_combo")
def run_train_per_combo(spark, sf_dir):
    """Every combination trained; its report per epoch."""
    return training.report_frame(spark, _train(spark, sf_dir, epochs=2)).drop("elapsed_time")


@query("ml_train_data_parallel")
def ml_train_data_parallel(spark, sf_dir):
    """One network trained, then used to score the test rows."""
    train, test = labelled_split(_embeddings(spark, sf_dir), "vec_id")
    done = training.train(
        train, test, "vec_id", "embedding", "label",
        [Combination(0, unit=HIDDEN, alpha=0.01, batchsize=BATCH, epochs=3)],
        DIMENSIONS, CLASSES)
    judged = network.with_loss(
        network.score(test, "embedding", states_of(done.snapshot(spark))[0].layers()), F.col("label"))
    return judged.groupBy("label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("loss"), 6).alias("loss"),
        F.avg("correct").alias("accuracy"))


@query("train_snapshot")
def train_snapshot(spark, sf_dir):
    """A run stopped after one epoch, written, read back and gone on with."""
    path = work_path(spark, "snapshot")
    write_snapshot(spark, _train(spark, sf_dir, epochs=1), path)
    resumed = _train(spark, sf_dir, epochs=2, resume=read_snapshot(spark, path))
    end = work_path(spark, "snapshot")
    write_snapshot(spark, resumed, end)
    return spark.read.parquet(end).groupBy("combo_id", "epoch", "step").agg(
        F.sum(F.size("theta")).alias("n_parameters"),
        F.round(F.sum(F.aggregate("theta", F.lit(0.0), lambda a, x: a + x * x)), 6)
        .alias("squares"))
