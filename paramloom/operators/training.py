"""Data-parallel training of networks, for many combinations at once.

An epoch is one barrier job. Its tasks hold the parameters, walk through the mini-batches in
step, and each adds up the gradients of its own rows. Parameters, moments and gradients are cut
into slices, and every task owns some: it adds the tasks' gradients of its slices, applies Adam to
them and hands the new parameters out. What tasks exchange lies in the shared folder, the files
of two steps at a time. The states are tables of slices that the cluster writes and reads:
neither rows nor anything of a network's size reaches the driver.
"""

from __future__ import annotations

import itertools
import json
import math
import time
import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from paramloom.operators.network import Layer, forward, usable_rows
from paramloom.session import work_path

# Doubles of one slice, and parameters of the networks that a task holds at a time; a larger
# network is trained alone.
SLICE = 1024
PARTS_ADDED = 256
HELD = 64_000_000

# The defaults of the Adam optimizer.
ALPHA, BETA1, BETA2, EPS = 0.001, 0.9, 0.999, 1e-8


@dataclass
class State:
    """Parameters and optimizer moments of one combination."""

    sizes: list[int]
    theta: np.ndarray
    first: np.ndarray
    second: np.ndarray
    step: int = 0
    epoch: int = 0

    def layers(self) -> list[Layer]:
        return _layers(self.sizes, self.theta)


@dataclass
class Combination:
    combo_id: int
    unit: int = 1000
    batchsize: int = 100
    epochs: int = 20
    alpha: float = ALPHA
    seed: int = 0


SNAPSHOT = ("combo_id bigint, epoch int, step int, sizes array<int>, slice int, "
            "theta array<double>, first array<double>, second array<double>")


@dataclass
class Training:
    """Tables of the trained states, the report by epoch, and rows that were left out."""

    paths: list[str] = field(default_factory=list)
    report: list[tuple] = field(default_factory=list)
    left_out: int = 0

    def snapshot(self, spark: SparkSession) -> DataFrame:
        """The states as rows of slices (``SNAPSHOT``), as the cluster wrote them."""
        return spark.read.schema(SNAPSHOT).parquet(*self.paths).where("slice >= 0")


REPORT_SCHEMA = ("combo_id bigint, epoch int, main_loss double, validation_main_loss double, "
                 "main_accuracy double, validation_main_accuracy double, elapsed_time double")


def _layers(sizes: list[int], theta: np.ndarray) -> list[Layer]:
    layers, start = [], 0
    for inputs, outputs in zip(sizes, sizes[1:]):
        weights = theta[start:start + inputs * outputs].reshape(inputs, outputs)
        start += inputs * outputs
        layers.append((weights, theta[start:start + outputs]))
        start += outputs
    return layers


def initial_state(sizes: list[int], seed: int) -> State:
    """Normal weights scaled by the number of inputs, zero biases."""
    rng = np.random.default_rng(seed)
    parts = []
    for inputs, outputs in zip(sizes, sizes[1:]):
        parts += [rng.standard_normal(inputs * outputs) / math.sqrt(inputs), np.zeros(outputs)]
    theta = np.concatenate(parts)
    return State(sizes, theta, np.zeros_like(theta), np.zeros_like(theta))


def loss_and_gradient(sizes: list[int], theta: np.ndarray, rows: np.ndarray,
                      labels: np.ndarray, gradient: bool = True):
    """Sums over the rows: (loss, number correct), gradient of the loss or None."""
    layers = _layers(sizes, theta)
    inputs, hidden = [rows], rows
    for weights, bias in layers[:-1]:
        hidden = np.maximum(hidden @ weights + bias, 0.0)
        inputs.append(hidden)
    logits = forward(layers[-1:], hidden)
    shifted = logits - logits.max(axis=1, keepdims=True)
    exps = np.exp(shifted)
    totals = exps.sum(axis=1)
    picked = np.arange(len(labels)), labels
    loss = float((np.log(totals) - shifted[picked]).sum())
    correct = int((logits.argmax(axis=1) == labels).sum())
    if not gradient:
        return loss, correct, None
    delta = exps / totals[:, None]
    delta[picked] -= 1.0
    parts = []
    for position in range(len(layers) - 1, -1, -1):
        parts = [(inputs[position].T @ delta).ravel(), delta.sum(axis=0), *parts]
        if position:
            delta = (delta @ layers[position][0].T) * (inputs[position] > 0)
    return loss, correct, np.concatenate(parts)


def adam(state: State, gradient: np.ndarray, alpha: float = ALPHA, eps: float = EPS) -> None:
    """One step of the optimizer, in place."""
    state.step += 1
    adam_slice(state.theta, state.first, state.second, gradient, state.step, alpha, eps)


def adam_slice(theta: np.ndarray, first: np.ndarray, second: np.ndarray, gradient: np.ndarray,
               step: int, alpha: float = ALPHA, eps: float = EPS) -> None:
    """Step number ``step`` on any slice of the arrays, in place."""
    first += (1 - BETA1) * (gradient - first)
    second += (1 - BETA2) * (gradient * gradient - second)
    rate = alpha * math.sqrt(1 - BETA2 ** step) / (1 - BETA1 ** step)
    theta -= rate * first / (np.sqrt(second) + eps)


_PARTIAL = "combo_id bigint, slice int, part int, sums array<double>"


def _partial_sums(models, gradient: bool):
    """Task function: one row per combination and slice; slice -1 holds the counts."""
    def run(batches):
        counts = defaultdict(lambda: np.zeros(3))
        gradients: dict[int, np.ndarray] = {}
        current = models.value
        for batch in batches:
            # All networks read the same vectors.
            width = next(iter(current.values()))[0][0]
            good, rows = usable_rows(batch.column(0), width)
            labels = batch.column(1).filter(pa.array(good)).to_numpy(zero_copy_only=False)
            # A NULL label, NaN here, and one beyond the classes can't be learned.
            classes = next(iter(current.values()))[0][-1]
            known = (labels >= 0) & (labels < classes)
            rows, labels = rows[known], labels[known].astype(np.int64)
            if not len(rows):
                continue
            for combo_id, (sizes, theta) in current.items():
                loss, correct, sums = loss_and_gradient(sizes, theta, rows, labels, gradient)
                counts[combo_id] += (loss, correct, len(rows))
                if gradient:
                    gradients[combo_id] = gradients.get(combo_id, 0.0) + sums
        part = TaskContext.get().partitionId()
        for combo_id, count in counts.items():
            yield _partial_batch(combo_id, part, -1, count)
            if gradient:
                yield _partial_batch(combo_id, part, 0, gradients[combo_id])
    return run


def _partial_batch(combo_id: int, part: int, first: int, values: np.ndarray) -> pa.RecordBatch:
    """``values`` cut into numbered slices."""
    ends = np.append(np.arange(0, len(values), SLICE), len(values)).astype(np.int32)
    n = len(ends) - 1
    return pa.RecordBatch.from_arrays(
        [pa.array([combo_id] * n, pa.int64()), pa.array(range(first, first + n), pa.int32()),
         pa.array([part] * n, pa.int32()),
         pa.ListArray.from_arrays(pa.array(ends), pa.array(values))],
        names=["combo_id", "slice", "part", "sums"])


def _add_parts(table: pa.Table) -> pa.Table:
    """Adds the slices of tasks, in task order so that a rerun adds up alike."""
    table = table.sort_by("part")
    total = np.zeros(len(table.column("sums")[0]))
    for sums in table.column("sums"):
        total += sums.values.to_numpy()
    return pa.table({"combo_id": table.column("combo_id")[:1], "slice": table.column("slice")[:1],
                     "part": table.column("part")[:1],
                     "sums": pa.ListArray.from_arrays(
                         pa.array([0, len(total)], pa.int32()), pa.array(total))})


def summed(rows: DataFrame, vector: str, label: str, models: dict, gradient: bool) -> dict:
    """Combination -> (loss sum, correct, rows, gradient sum or None) over all rows.

    ``models``: combination -> (layer sizes, parameter vector).
    """
    shared = rows.sparkSession.sparkContext.broadcast(models)
    try:
        parts = rows.select(vector, F.col(label).cast("bigint").alias(label)) \
            .mapInArrow(_partial_sums(shared, gradient), _PARTIAL)
        # In two levels, so that no group gathers the slices of all tasks.
        some = parts.groupBy("combo_id", "slice", F.expr(f"part div {PARTS_ADDED}")) \
            .applyInArrow(lambda t: _add_parts(t), _PARTIAL)
        added = some.groupBy("combo_id", "slice").applyInArrow(
            lambda t: _add_parts(t), _PARTIAL).collect()
    finally:
        shared.unpersist()
    result = {}
    slices = defaultdict(dict)
    for row in added:
        if row["slice"] < 0:
            result[row["combo_id"]] = [*row["sums"], None]
        else:
            slices[row["combo_id"]][row["slice"]] = row["sums"]
    for combo_id, pieces in slices.items():
        result[combo_id][3] = np.concatenate([pieces[i] for i in sorted(pieces)])
    return result


@dataclass
class _Plan:
    """What the tasks of an epoch know: combinations, their slices, and who owns which."""

    combinations: list[Combination]
    sizes: list[list[int]]
    epoch: int
    steps: list[int]
    folder: str
    tasks: int

    def __post_init__(self):
        lengths = [sum((i + 1) * o for i, o in zip(s, s[1:])) for s in self.sizes]
        self.starts = [0, *itertools.accumulate(lengths)]
        #: combination, number within it, begin and end in the joined vector
        self.slices = [(c, i, self.starts[c] + at, min(self.starts[c] + at + SLICE, self.starts[c + 1]))
                       for c, n in enumerate(lengths) for i, at in enumerate(range(0, n, SLICE))]

    def owned(self, task: int) -> list[tuple]:
        return [s for g, s in enumerate(self.slices) if g * self.tasks // len(self.slices) == task]

    def owner_of(self, combo_id, number):
        """Column of the task that owns a slice."""
        before = list(itertools.accumulate(
            [0] + [-(-(b - a) // SLICE) for a, b in zip(self.starts, self.starts[1:])]))
        places = F.create_map(*[F.lit(x) for c, n in zip(self.combinations, before)
                                for x in (c.combo_id, n)])
        return F.call_function("div", (F.element_at(places, combo_id) + number) * self.tasks,
                               F.lit(len(self.slices))).cast("int")


class _Exchange:
    """What tasks leave for each other in the shared folder: a note and an array, by name.

    Barrier calls take a second each, so tasks wait for each other's files instead; a file appears
    whole. Once a task has seen what all left in a step, none needs files of the step before.
    """

    def __init__(self, plan: _Plan, attempt: str, task: int):
        self.fs, root = pa.fs.FileSystem.from_uri(plan.folder)
        self.root = f"{root}/epoch-{plan.epoch}-{attempt}"
        self.task, self.left = task, []
        self.fs.create_dir(self.root, recursive=True)

    def put(self, name: str, note=None, values: np.ndarray | None = None) -> None:
        text = json.dumps(note).encode()
        array = b"" if values is None else np.ascontiguousarray(values).tobytes()
        path = f"{self.root}/{name}-{self.task}"
        with self.fs.open_output_stream(path + ".part") as out:
            out.write(len(text).to_bytes(8, "little") + text)
            out.write(array)
        self.fs.move(path + ".part", path)
        self.left.append(path)

    def _open(self, path: str):
        pause = 0.001
        while True:
            try:
                return self.fs.open_input_file(path)
            except FileNotFoundError:
                time.sleep(pause)
                pause = min(2 * pause, 0.1)

    def get(self, name: str, task: int, begin: int = 0, end: int = 0) -> tuple:
        """The note of a task, and values ``begin`` to ``end`` of its array."""
        with self._open(f"{self.root}/{name}-{task}") as file:
            length = int.from_bytes(file.read(8), "little")
            note = json.loads(file.read(length))
            file.seek(8 + length + 8 * begin)
            return note, np.frombuffer(file.read(8 * (end - begin)), np.float64)

    def forget(self, but: int) -> None:
        """Removes own files, except for the last ones."""
        while len(self.left) > but:
            self.fs.delete_file(self.left.pop(0))


def _segments(batches):
    """``kind, key, rows`` for each stretch of equal kind and key."""
    for batch in batches:
        kind, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
        cuts = np.flatnonzero((kind[1:] != kind[:-1]) | (key[1:] != key[:-1])) + 1
        ends = [*cuts.tolist(), len(kind)]
        for begin, end in zip([0, *cuts.tolist()], ends):
            if end > begin:
                yield int(kind[begin]), int(key[begin]), batch.slice(begin, end - begin)


_STATE, _TRAIN, _TEST = range(3)


def _epoch(plan: _Plan):
    """Task function of one epoch: training, then a look at the test rows, then its slices."""
    def run(batches):
        context = BarrierTaskContext.get()
        me = context.partitionId()
        # A folder that all tasks of this attempt, and none of an earlier one, agree on.
        attempt = context.allGather(uuid.uuid4().hex)[0]
        exchange = _Exchange(plan, attempt, me)
        mine = plan.owned(me)
        low, high = (mine[0][2], mine[-1][3]) if mine else (0, 0)
        spans = [plan.owned(t) for t in range(plan.tasks)]
        spans = [(s[0][2], s[-1][3]) if s else (0, 0) for s in spans]
        theta = np.concatenate([initial_state(s, c.seed).theta
                                for s, c in zip(plan.sizes, plan.combinations)])
        first, second = np.zeros(high - low), np.zeros(high - low)
        steps = list(plan.steps)

        def hand_out(step):
            """Everybody's slices of the parameters into everybody's ``theta``."""
            exchange.put(f"theta-{step}", None, theta[low:high])
            for task, (begin, end) in enumerate(spans):
                if task != me and end > begin:
                    _, theta[begin:end] = exchange.get(f"theta-{step}", task, 0, end - begin)

        groups = itertools.groupby(_segments(batches), key=lambda s: s[:2])
        now = next(groups, None)
        place = {c.combo_id: i for i, c in enumerate(plan.combinations)}
        if any(steps):
            while now is not None and now[0][0] == _STATE:
                for _, _, rows in now[1]:
                    for row in rows.to_pylist():
                        at = plan.starts[place[row["combo_id"]]] + row["at"] * SLICE
                        here = slice(at - low, at - low + len(row["v"]))
                        theta[at:at + len(row["v"])] = row["v"]
                        first[here], second[here] = row["first"], row["second"]
                now = next(groups, None)
            hand_out("first")

        def sums(parts, gradient):
            counts, total = np.zeros((len(plan.sizes), 3)), None
            for _, _, rows in parts:
                good, vectors = usable_rows(rows.column(4), plan.sizes[0][0])
                labels = rows.column(3).filter(pa.array(good)).to_numpy(zero_copy_only=False)
                known = (labels >= 0) & (labels < plan.sizes[0][-1])
                vectors, labels = vectors[known], labels[known].astype(np.int64)
                if not len(vectors):
                    continue
                total = np.zeros(len(theta)) if gradient and total is None else total
                for c, s in enumerate(plan.sizes):
                    begin, end = plan.starts[c], plan.starts[c + 1]
                    loss, right, part = loss_and_gradient(s, theta[begin:end], vectors, labels, gradient)
                    counts[c] += (loss, right, len(vectors))
                    if gradient:
                        total[begin:end] += part
            return counts, total

        def next_key():
            return now[0][1] if now is not None and now[0][0] == _TRAIN else None

        seen = np.zeros((len(plan.sizes), 3))
        exchange.put("begin", next_key())
        keys = [exchange.get("begin", task)[0] for task in range(plan.tasks)]
        step = 0
        while known := [k for k in keys if k is not None]:
            counts, gradient = np.zeros((len(plan.sizes), 3)), None
            if now is not None and now[0] == (_TRAIN, min(known)):
                counts, gradient = sums(now[1], True)
                now = next(groups, None)
            exchange.put(f"gradient-{step}", [next_key(), counts.tolist()], gradient)
            added, total, keys = np.zeros(high - low), np.zeros((len(plan.sizes), 3)), []
            for task in range(plan.tasks):
                (key, counts), part = exchange.get(f"gradient-{step}", task, low, high)
                keys.append(key)
                total += counts
                if len(part):
                    added += part
            exchange.forget(but=2)
            seen += total
            for c, combination in enumerate(plan.combinations):
                n = total[c, 2]
                if n:
                    steps[c] += 1
                    begin, end = max(low, plan.starts[c]), min(high, plan.starts[c + 1])
                    if begin < end:
                        own = slice(begin - low, end - low)
                        adam_slice(theta[begin:end], first[own], second[own], added[own] / n,
                                   steps[c], combination.alpha)
            hand_out(step)
            step += 1
        while now is not None and now[0][0] != _TEST:
            now = next(groups, None)
        tested, _ = sums(now[1] if now is not None else (), False)

        out = [(c, i, theta[a:b], first[a - low:b - low], second[a - low:b - low])
               for c, i, a, b in mine]
        none = np.zeros(0)
        out += [(c, -2, tested[c], none, none) for c in range(len(plan.sizes))]
        if me == 0:
            out += [(c, -1, seen[c], none, none) for c in range(len(plan.sizes))]
        for some in itertools.batched(out, 256):
            numbers, slices, *arrays = zip(*some)
            yield pa.RecordBatch.from_arrays(
                [pa.array([plan.combinations[c].combo_id for c in numbers], pa.int64()),
                 pa.array([plan.epoch] * len(some), pa.int32()),
                 pa.array([steps[c] for c in numbers], pa.int32()),
                 pa.array([plan.sizes[c] for c in numbers], pa.list_(pa.int32())),
                 pa.array(slices, pa.int32()),
                 *(pa.array(list(a), pa.list_(pa.float64())) for a in arrays)],
                ["combo_id", "epoch", "step", "sizes", "slice", "theta", "first", "second"])
    return run


def _keyed_rows(rows: DataFrame, row_id: str, vector: str, label: str, tasks: int) -> DataFrame:
    """What an epoch reads of rows: ``at`` orders them within a task, ``task`` is theirs."""
    return rows.select(F.xxhash64(row_id).alias("at"), F.col(label).cast("bigint").alias("label"),
                       F.col(vector).cast("array<double>").alias("v"),
                       F.pmod(F.xxhash64(F.lit("task"), row_id), F.lit(tasks)).cast("int").alias("task"))


def _batch_table(rows: DataFrame, row_id: str, batchsize: int, classes: int, vector: str,
                 label: str, tasks: int):
    """Training rows with their batch, written once, and the number of rows left out.

    A row's batch is a hash of its id, so batches have about ``batchsize`` rows. Rows whose label
    is NULL or none of the classes are left out and counted.
    """
    known = F.coalesce(F.col(label).cast("bigint").between(0, classes - 1), F.lit(False))
    counted = rows.agg(F.count_if(known).alias("n"), F.count_if(~known).alias("out")).first()
    batches = max(1, math.ceil(counted["n"] / batchsize))
    path = work_path(rows.sparkSession, "train-batches")
    keyed = _keyed_rows(rows.where(known), row_id, vector, label, tasks)
    keyed.withColumn("batch", F.pmod(F.xxhash64("at"), F.lit(batches))).write.parquet(path)
    return rows.sparkSession.read.parquet(path), counted["out"]


def train(train_rows: DataFrame, test_rows: DataFrame, row_id: str, vector: str, label: str,
          combinations: list[Combination], inputs: int, classes: int,
          resume: DataFrame | None = None, tasks: int | None = None,
          after_epoch: Callable[[int, str], None] | None = None) -> Training:
    """Trains every combination and reports each epoch.

    Combinations with equal ``batchsize`` and ``epochs`` share their passes, as many at
    a time as a task may hold. Batches are fixed by a hash of the row id; their order, also by a
    hash, changes per epoch. ``resume`` is a snapshot to go on from; ``after_epoch`` is told the
    path of the table with the states after each epoch. ``tasks`` train at the same time, by
    default as many as there are slots, since a barrier job must have them all. A lost executor
    takes its epoch back to the states at the epoch's beginning.
    """
    spark = train_rows.sparkSession
    training = Training()
    tasks = tasks or spark.sparkContext.defaultParallelism
    known = {}
    if resume is not None:
        known = {r["combo_id"]: (r["epoch"], r["step"]) for r in
                 resume.select("combo_id", "epoch", "step").distinct().collect()}

    def sizes(c: Combination) -> list[int]:
        return [inputs, c.unit, c.unit, classes]

    groups = defaultdict(list)
    for c in combinations:
        groups[c.batchsize, c.epochs, known.get(c.combo_id, (0, 0))[0]].append(c)
    for (batchsize, epochs, done), group in groups.items():
        table, training.left_out = _batch_table(
            train_rows, row_id, batchsize, classes, vector, label, tasks)
        test = _keyed_rows(test_rows, row_id, vector, label, tasks)
        for chunk in _chunks(group, sizes):
            plan = _Plan(chunk, [sizes(c) for c in chunk], done,
                         [known.get(c.combo_id, (0, 0))[1] for c in chunk],
                         work_path(spark, "train-exchange"), tasks)
            states = resume.where(F.col("combo_id").isin([c.combo_id for c in chunk])) \
                if done else None
            path = _train_group(training, plan, states, table, test, epochs, after_epoch)
            if path:
                training.paths.append(path)
    training.report.sort()
    return training


def _chunks(group: list[Combination], sizes) -> list[list[Combination]]:
    """Combinations whose parameters a task holds together."""
    chunks, held = [[]], 0
    for c in group:
        n = sum((i + 1) * o for i, o in zip(sizes(c), sizes(c)[1:]))
        if chunks[-1] and held + n > HELD:
            chunks.append([])
            held = 0
        chunks[-1].append(c)
        held += n
    return chunks


_EPOCH_ROWS = ("kind", "key", "at", "label", "v", "combo_id", "first", "second", "task")


def _epoch_rows(plan: _Plan, states: DataFrame | None, table: DataFrame,
                test: DataFrame) -> DataFrame:
    """States, training rows by batch and test rows, each in its task and in order."""
    none = F.lit(None).cast("array<double>")
    zero = F.lit(0).cast("bigint")

    def of(rows, kind, key):
        return rows.select(F.lit(kind).alias("kind"), key.alias("key"), "at", "label", "v",
                           zero.alias("combo_id"), none.alias("first"), none.alias("second"), "task")
    both = of(table, _TRAIN, F.xxhash64(F.lit(plan.epoch), "batch")).unionByName(
        of(test, _TEST, zero))
    if states is not None:
        both = both.unionByName(states.where("slice >= 0").select(
            F.lit(_STATE).alias("kind"), zero.alias("key"), F.col("slice").cast("bigint").alias("at"),
            zero.alias("label"), F.col("theta").alias("v"), "combo_id", "first", "second",
            plan.owner_of(F.col("combo_id"), F.col("slice")).alias("task")))
    return both.select(*_EPOCH_ROWS).repartitionById(plan.tasks, "task").sortWithinPartitions(
        "kind", "key", "at", "label")


def _sum_in_order(value):
    """The sum of a number per task, always in the same order, so that reruns agree."""
    return F.aggregate(F.array_sort(F.collect_list(value)), F.lit(0.0), lambda a, x: a + x)


def _train_group(training, plan, states, table, test, epochs, after_epoch) -> str | None:
    """Trains one plan's combinations; the path of their last states."""
    spark, began, path = table.sparkSession, time.monotonic(), None
    for epoch in range(plan.epoch + 1, epochs + 1):
        plan = _Plan(plan.combinations, plan.sizes, epoch, plan.steps, plan.folder, plan.tasks)
        path = work_path(spark, "train-states")
        _epoch_rows(plan, states, table, test).mapInArrow(
            _epoch(plan), SNAPSHOT, barrier=True).write.parquet(path)
        states = spark.read.schema(SNAPSHOT).parquet(path)
        told = states.where("slice < 0").groupBy("combo_id", "slice").agg(
            F.max("step").alias("step"),
            *[_sum_in_order(F.get("theta", F.lit(i))).alias(n)
              for i, n in enumerate(("loss", "right", "n"))])
        sums = {(r["combo_id"], r["slice"]): r for r in told.collect()}
        for c in plan.combinations:
            main, held_out = sums[c.combo_id, -1], sums[c.combo_id, -2]
            training.report.append((
                c.combo_id, epoch, _mean(main["loss"], main["n"]),
                _mean(held_out["loss"], held_out["n"]), _mean(main["right"], main["n"]),
                _mean(held_out["right"], held_out["n"]), time.monotonic() - began))
        plan.steps = [sums[c.combo_id, -1]["step"] for c in plan.combinations]
        if after_epoch:
            after_epoch(epoch, path)
    return path


def _mean(total: float, n: float) -> float | None:
    return float(total / n) if n else None


def report_frame(spark: SparkSession, training: Training) -> DataFrame:
    """The epoch report, a row per combination and epoch."""
    return spark.createDataFrame(training.report, REPORT_SCHEMA)
