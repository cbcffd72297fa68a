"""Tasks: echo, user functions, failures, redelivery, whole sweeps."""

import pytest
from pyspark.sql import functions as F

from paramloom import job
from paramloom.operators import tasks


def params_frame(spark, entries):
    return spark.createDataFrame(
        [(str(i), e) for i, e in enumerate(entries)], "task_id string, params map<string,string>")


def test_echo_run(spark):
    """The echo run sends 5, 6, 8, 11 and 15 messages."""
    counts = [5, 6, 8, 11, 15]
    sent = tasks.echo(spark.createDataFrame(
        [(str(i), n) for i, n in enumerate(counts)], "task_id string, n int")).collect()
    texts = [r["text"] for r in sorted(sent, key=lambda r: (r["task_id"], r["seq"]))
             if r["status"] == "MSG" and r["task_id"] == "2"]
    assert sum(r["status"] == "MSG" for r in sent) == 45
    assert texts == [f"i={i}" for i in range(8)]
    results = {r["task_id"]: r["text"] for r in sent if r["status"] == "SUCCESS"}
    assert results["4"] == '{"n":15,"i":14}'


def test_echo_of_nothing(spark):
    df = spark.createDataFrame([("a", 0), ("b", -2)], "task_id string, n int")
    rows = [tuple(r) for r in tasks.echo(df).orderBy("task_id").collect()]
    assert rows == [("a", 0, "SUCCESS", '{"n":0}'), ("b", 0, "SUCCESS", '{"n":-2}')]
    assert tasks.echo_by_table_function(spark, df).count() == 0


def test_table_function_gives_the_same_messages(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1)], "task_id string, n int")
    rows = sorted(map(tuple, tasks.echo_by_table_function(spark, df).collect()))
    plain = tasks.echo(df).where("status = 'MSG'").drop("status")
    assert rows == sorted(map(tuple, plain.collect()))


def test_failure_stays_with_its_task(spark):
    def invert(params):
        return {"share": 1.0 / int(params["n"]), "text": None}

    df = params_frame(spark, [{"n": "4"}, {"n": "0"}, {"n": "x"}, {}])
    rows = {r["task_id"]: r for r in tasks.run_map(df, invert, "share double, text string").collect()}
    assert (rows["0"]["status"], rows["0"]["share"]) == ("SUCCESS", 0.25)
    assert rows["1"]["error"].startswith("ZeroDivisionError")
    assert rows["2"]["error"].startswith("ValueError")
    assert rows["3"]["error"].startswith("KeyError")
    assert {rows[k]["status"] for k in "123"} == {"FAILURE"}


def test_task_with_many_rows(spark):
    def count(params):
        return ({"i": i} for i in range(int(params["n"])))

    done = tasks.run_map(params_frame(spark, [{"n": "25000"}, {"n": "0"}]), count, "i bigint",
                         partitions=2)
    assert done.count() == 25_000
    assert done.agg(F.sum("i")).first()[0] == 25_000 * 24_999 // 2


def test_every_kind_of_result(spark):
    def answer(params):
        return {"none": None, "plain": 5, "dict": {"v": 6}, "rows": [{"v": 7}, {"v": 8}],
                "wrong": {"v": "zz"}, "text": "zz"}[params["n"]]

    kinds = ["none", "plain", "dict", "rows", "wrong", "text"]
    done = tasks.run_map(params_frame(spark, [{"n": k} for k in kinds]), answer, "v int")
    got = sorted((int(r["task_id"]), r["status"], r["v"]) for r in done.collect()
                 if r["v"] is not None or r["status"] == "FAILURE")
    assert got == [(1, "SUCCESS", 5), (2, "SUCCESS", 6), (3, "SUCCESS", 7), (3, "SUCCESS", 8),
                   (4, "FAILURE", None), (5, "FAILURE", None)]
    assert done.where("task_id = '0' and status = 'SUCCESS' and v is null").count() == 1


def test_plain_value_needs_one_column(spark):
    done = tasks.run_map(params_frame(spark, [{}]), lambda p: 5, "a int, b int").first()
    assert (done["status"], done["a"]) == ("FAILURE", None)


def test_placement_counts_every_task(spark):
    rows = tasks.placement(params_frame(spark, [{}] * 40), 4).collect()
    assert sum(r["tasks"] for r in rows) == 40
    assert len({r["partition_id"] for r in rows}) == 4


def test_redelivery(spark):
    sent = [("a", 1), ("a", 2), ("a", 1), ("b", 1), ("b", 1)]
    once = tasks.without_redelivery(spark.createDataFrame(sent, "task_id string, seq bigint"))
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("a", 2), ("b", 1)]


def test_whole_sweep(spark, tmp_path):
    def train(params):
        if params["model"] == "broken":
            raise RuntimeError("no such model")
        return {"score": int(params["epoch"]) * 2, "gpu": params["gpu"]}

    specs = tmp_path / "specs"
    specs.mkdir()
    (specs / "a.yml").write_text(
        "# spec a\nepoch: !!python/tuple [5, 20, 5]\nmodel: [mlp, broken]\nverbose: true\n")
    (specs / "b.yml").write_text("# spec b\nepoch: []\nmodel: [mlp]\n")
    sweep = job.run_sweep(spark, str(specs), str(tmp_path / "out"), train,
                          "score int, gpu string", base={"gpu": "-1", "epoch": "1"})
    assert sweep.tasks.count() == 6
    assert [tuple(r) for r in sweep.errors.collect()] == [("b", "epoch", "empty")]
    good = sweep.results.where("status = 'SUCCESS'").orderBy("score").collect()
    assert [(r["score"], r["gpu"]) for r in good] == [(10, "-1"), (20, "-1"), (30, "-1")]
    assert sweep.results.where("status = 'FAILURE'").count() == 3
    kinds = dict(sweep.log.groupBy("kind").count().collect())
    assert kinds == {"header": 6, "row": 3}
    header = sweep.log.where("kind = 'header'").first()
    assert set(header["params"]) == {"gpu", "epoch", "model", "verbose"}
    joined = sweep.log.where("kind = 'row'").join(sweep.tasks, "task_id")
    assert joined.count() == 3
    # The same task again overwrites what it wrote.
    again = job.run_sweep(spark, str(specs), str(tmp_path / "out"), train, "score int, gpu string",
                          base={"gpu": "-1", "epoch": "1"})
    assert again.log.count() == 9


@pytest.mark.parametrize("partitions", [None, 3])
def test_kept_columns(spark, partitions):
    df = params_frame(spark, [{"n": "1"}, {"n": "2"}]).withColumn("spec_id", F.lit("s"))
    done = tasks.run_map(df, lambda p: {"n": int(p["n"])}, "n int", partitions,
                         keep=["spec_id", "task_id"])
    assert done.columns == ["spec_id", "task_id", "status", "error", "n"]
    assert sorted(r["n"] for r in done.collect()) == [1, 2]


def test_tasks_are_called_by_name(spark):
    call = tasks.by_name({"double": lambda p: 2 * int(p["n"]), "size": lambda p: len(p)}, default="size")
    df = params_frame(spark, [{"task": "double", "n": "4"}, {"task": "nobody"}, {"a": "1"}, {}])
    rows = {r["task_id"]: (r["status"], r["error"], r["v"])
            for r in tasks.run_map(df, call, "v int").collect()}
    assert rows == {"0": ("SUCCESS", None, 8), "1": ("FAILURE", "UnknownTask: nobody", None),
                    "2": ("SUCCESS", None, 1), "3": ("SUCCESS", None, 0)}


def test_supervised_tasks_end_alone(spark):
    import os
    import time

    def work(params):
        kind = params["k"]
        if kind == "exit":
            os._exit(3)
        if kind == "hang":
            time.sleep(600)
        if kind == "grow":
            return {"v": len(bytearray(2_000_000_000))}
        if kind == "leave":
            raise SystemExit("bye")
        if kind == "raise":
            raise ValueError("no")
        return ({"v": i} for i in range(25_000)) if kind == "many" else 7

    kinds = ["exit", "hang", "grow", "leave", "raise", "many", "fine", "exit"]
    done = tasks.run_map(params_frame(spark, [{"k": k} for k in kinds]), work, "v bigint",
                         limits=tasks.Limits(seconds=3, megabytes=500)).cache()
    failed = {r["task_id"]: r["error"] for r in done.where("status = 'FAILURE'").collect()}
    assert failed == {"0": "TaskEnded: exit code 3", "1": "TaskEnded: no answer in 3 seconds",
                      "2": "MemoryError: ", "3": "SystemExit: bye", "4": "ValueError: no",
                      "7": "TaskEnded: exit code 3"}
    assert done.where("task_id = '5'").count() == 25_000
    assert done.where("task_id = '6'").first()["v"] == 7


def test_interrupted_sweep_goes_on(spark, tmp_path):
    """Killed in its third batch; the rerun calls only what was not committed."""
    specs, calls, stop = tmp_path / "specs", tmp_path / "calls", tmp_path / "stop"
    specs.mkdir()
    calls.mkdir()
    (specs / "a.yaml").write_text("# spec a\nn: !!python/tuple [0, 40]\n")
    stop.write_text("")

    def work(params):
        import os
        import uuid
        if os.path.exists(str(stop)) and len(os.listdir(str(calls))) >= 22:
            os._exit(1)  # takes its worker along, and so the job
        open(f"{calls}/{params['n']}-{uuid.uuid4().hex}", "w").close()
        return {"v": int(params["n"])}

    def sweep(**more):
        return job.run_sweep(spark, str(specs), str(tmp_path / "out"), work, "v int",
                             partitions=1, batches=8, **more)

    with pytest.raises(Exception):
        sweep()
    committed = job._committed(spark, str(tmp_path / "out")).count()
    assert 0 < committed < 40
    before = {p.name.split("-")[0] for p in calls.iterdir()}
    stop.unlink()
    done = sweep(resume=True)
    assert sorted(r["v"] for r in done.results.collect()) == list(range(40))
    names = [p.name.split("-")[0] for p in calls.iterdir()]
    again = {n for n in names if names.count(n) > 1}
    assert set(names) == {str(i) for i in range(40)}
    assert len(again) == len(before) - committed < 10
    total = len(names)
    assert sweep(resume=True).results.count() == 40
    assert len(list(calls.iterdir())) == total
    assert done.log.where("kind = 'header'").count() == 40
