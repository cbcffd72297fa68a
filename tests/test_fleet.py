"""Fleet files, settings, registries, paths, generated rows."""

import pytest
from pyspark.sql import functions as F

from paramloom.functions import text
from paramloom.operators import fleet, generate
from paramloom.sources import records

FLEET = """hosts,localhost,admin@10.0.0.1,north,south
master,1
broker,1
workers,0,2,7,local
remote_path,jobs/proj
folder,proj
"""


@pytest.fixture()
def keyed(spark, tmp_path):
    (tmp_path / "fleet.csv").write_text(FLEET)
    return fleet.keyed_list(records.read_keyed_files(spark, str(tmp_path), "*.csv"))


def test_keyed_lists_and_references(keyed):
    hosts = [r["value"] for r in keyed.where("key = 'hosts'").orderBy("pos").collect()]
    assert hosts == ["localhost", "admin@10.0.0.1", "north", "south"]
    resolved = fleet.resolve_hosts(keyed).orderBy("pos").collect()
    assert [(r["ref"], r["host"]) for r in resolved] == [
        (0, "localhost"), (2, "north"), (7, None), (0, "localhost")]
    master = fleet.resolve_hosts(keyed, "master").first()
    assert master["host"] == "admin@10.0.0.1"


def test_required_fields_and_host_list(keyed):
    missing = fleet.missing_fields(keyed, ["remote_path", "folder", "key"]).first()["missing"]
    assert missing == ["key"]
    assert fleet.host_list(keyed).first()["hosts"] == "admin@10.0.0.1, north, south"


def test_settings(spark, tmp_path):
    (tmp_path / "settings_a.sh").write_text(
        'REMOTE_PATH="jobs/one"\nKEY=""\n# note\nSTART_WORKER="local,1,2"\nREMOTE_PATH="jobs/two"')
    settings = records.read_settings_files(spark, str(tmp_path), "settings_*.sh")
    assert {(r["key"], r["value"]) for r in settings.collect()} == {
        ("REMOTE_PATH", "jobs/two"), ("START_WORKER", "local,1,2")}
    lines = {r["line"] for r in records.settings_rows(settings).collect()}
    assert lines == {'REMOTE_PATH="jobs/two"', 'START_WORKER="local,1,2"'}


def test_precedence(spark):
    def pairs(rows):
        return spark.createDataFrame(rows, "key string, value string")

    laid = fleet.with_precedence(pairs([("a", "given"), ("c", None)]),
                                 pairs([("a", "old"), ("b", "old"), ("c", "old")]), ["key"])
    assert dict(laid.collect()) == {"a": "given", "b": "old", "c": "old"}


def test_registry_file(spark, tmp_path):
    (tmp_path / "registry.csv").write_text(
        'test_gpu.sh,get_nv,"versions, all"\nls.sh,,List files.\nnew.sh,get_nv,newer\n')
    entries = records.read_registry(spark, str(tmp_path / "registry.csv"))
    known = {r["name"]: (r["command"], r["usage"]) for r in fleet.registry(entries).collect()}
    assert known == {"get_nv": ("new.sh", "newer"), "ls.sh": ("ls.sh", "List files.")}
    calls = spark.createDataFrame([(1, "get_nv"), (2, "rm"), (3, "ls.sh")], "id int, name string")
    assert {r["id"] for r in fleet.known_calls(calls, entries).collect()} == {1, 3}
    assert {r["id"] for r in fleet.unknown_calls(calls, entries).collect()} == {2}
    assert fleet.usages(entries).columns == ["name", "usage"]
    paths = fleet.call_paths(calls, entries, "scripts")
    assert {(r["id"], r["path"]) for r in paths.collect()} == {
        (1, "scripts/new.sh"), (2, None), (3, "scripts/ls.sh")}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("given, host", [
    ("admin@10.0.0.2", "10.0.0.2"), ("north", "north"), ("", ""), ("a@b@c", "b")])
def test_host_of_address(spark, given, host):
    assert one(spark, text.host_of(F.lit(given))) == host


def test_address(spark):
    assert one(spark, text.address(F.lit("u"), F.lit("h"))) == "u@h"
    assert one(spark, text.address(F.lit(""), F.lit("h"))) == "h"
    assert one(spark, text.address(F.lit(None).cast("string"), F.lit("h"))) == "h"


def test_state_and_version(spark):
    line = F.lit("NVDRV:390.48,CUDA:x,cuDNN:7.0.5.15-1")
    assert one(spark, text.state(line, "NVDRV")) == "390.48"
    assert one(spark, text.state(line, "CUDA")) is None
    assert one(spark, text.state(line, "other")) is None
    assert one(spark, text.version(F.lit("Kernel Module  390.48  Thu"))) == "390.48"
    assert one(spark, text.version(F.lit("none"))) is None


def test_path_globs(spark):
    names = [".git", "a/.hidden", "x.pyc", "a/b.csv", "c.csv.bak", "plain", "run_ai1.sh"]
    paths = spark.createDataFrame([(n,) for n in names], "path string")
    kept = {r[0] for r in fleet.keep_paths(paths, exclude=[".*", "*.pyc", "*_ai?.sh"]).collect()}
    assert kept == {"a/b.csv", "c.csv.bak", "plain"}
    assert [r[0] for r in fleet.keep_paths(paths, include=["*.csv"]).collect()] == ["a/b.csv"]


def test_worker_rows(spark):
    workers = spark.createDataFrame([("А",), ("Б",)], "name string")
    made = generate.worker_rows(workers, 200, "qwerty")
    rows = made.collect()
    assert len(rows) == 400
    assert {len(r["text"]) for r in rows} == set(range(1, 7))
    assert set("".join(r["text"] for r in rows)) == set("qwerty")
    assert sorted(rows) == sorted(made.collect())


def test_conditional_fields(spark):
    rows = spark.createDataFrame(
        [("a", "remote", "x"), ("a", "path", "p"), ("b", "master", "1"), ("c", "key", "k")],
        "record_id string, key string, value string")
    missing = dict(fleet.missing_fields(
        rows, with_key={"remote": ["path", "folder"]}, without_key={"master": ["broker"]},
        one_of=[["master", "worker"]]).collect())
    assert missing == {"a": ["folder", "broker", "master or worker"], "b": [],
                       "c": ["broker", "master or worker"]}
