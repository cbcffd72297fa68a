"""Specifications: reading, classification, rejection, value expansion."""

import pytest

from paramloom.operators import specs
from paramloom.sources.specs import read_specs, spec_documents, value_text, write_specs

EXAMPLE = """gpu: -1
batchsize: [100, 500]
epoch: !!python/tuple [5, 20, 5]
"""


def read(spark, tmp_path, **documents):
    for name, text in documents.items():
        (tmp_path / f"{name}.yml").write_text(text)
    return read_specs(spark, str(tmp_path))


def values(raw, **options):
    rows = specs.param_values(raw, **options).collect()
    return {r["param"]: (r["kind"], r["values"]) for r in sorted(rows, key=lambda r: r["ord"])}


def errors(raw, **options):
    return {(r["param"], r["reason"]) for r in specs.spec_errors(raw, **options).collect()}


def test_documented_example(spark, tmp_path):
    raw = read(spark, tmp_path, example=EXAMPLE)
    assert values(raw) == {
        "gpu": ("scalar", ["-1"]), "batchsize": ("list", ["100", "500"]),
        "epoch": ("interval", ["5", "10", "15"])}
    assert list(values(raw)) == ["gpu", "batchsize", "epoch"]
    assert errors(raw) == set()


@pytest.mark.parametrize("bounds, expected", [
    ("[0, 3]", ["0", "1", "2"]),
    ("[10, 0, -4]", ["10", "6", "2"]),
    ("[0, 1, 0.25]", ["0", "0.25", "0.5", "0.75"]),
    ("[0.1, 0.4, 0.1]", ["0.1", "0.2", "0.3"]),
    ("[1, 2, 0.3]", ["1", "1.3", "1.6", "1.9"]),
    ("[1000000, 3000000, 1000000]", ["1000000", "2000000"]),
    ("[-0.5, 0.6, 0.5]", ["-0.5", "0", "0.5"]),
])
def test_intervals(spark, tmp_path, bounds, expected):
    raw = read(spark, tmp_path, s=f"x: !!python/tuple {bounds}\n")
    assert values(raw) == {"x": ("interval", expected)}
    as_list = read(spark, tmp_path, s=f"x: {bounds}\n")
    assert values(as_list, list_as_interval=True) == {"x": ("interval", expected)}


@pytest.mark.parametrize("value, reason", [
    ("!!python/tuple [5]", "short"), ("!!python/tuple [5, 5]", "empty"),
    ("!!python/tuple [9, 2]", "empty"), ("[]", "empty"), ("[[1, 2], 3]", "nested"),
    ("!!python/tuple [1, 5, 0]", "step"), ("!!python/tuple [a, b]", "number"),
    ("!!python/tuple [0, 1000000000000000, 1000000000000000]", "range"),
    ("!!python/tuple [0, 1, 0.000000000001]", "too_many"),
    ("!!python/tuple [0, 10000000000]", "too_many"),
])
def test_bad_parameter_rejects_its_spec(spark, tmp_path, value, reason):
    raw = read(spark, tmp_path, s=f"a: 1\nx: {value}\nb: 2\n")
    assert errors(raw) == {("x", reason)}
    assert values(raw) == {}


@pytest.mark.parametrize("value, reason", [
    ("{k: v}", "dict"), ("null", "type"), ("2020-01-01", "type")])
def test_unusable_parameter_is_left_out(spark, tmp_path, value, reason):
    raw = read(spark, tmp_path, s=f"a: 1\nx: {value}\nb: two\n")
    assert errors(raw) == {("x", reason)}
    assert values(raw) == {"a": ("scalar", ["1"]), "b": ("scalar", ["two"])}


def test_flags_and_floats(spark, tmp_path):
    raw = read(spark, tmp_path, s="loud: true\nquiet: false\nrate: 0.5\nwhole: 2.0\n")
    assert values(raw) == {"loud": ("flag", [""]), "rate": ("scalar", ["0.5"]),
                           "whole": ("scalar", ["2.0"])}


def test_unreadable_document_does_not_stop_the_others(spark, tmp_path):
    raw = read(spark, tmp_path, good="a: 1\n", bad="a: [1\n", listed="- 1\n",
               unsafe="a: !!python/object:os.x {}\n", empty="")
    assert errors(raw) == {(None, "unreadable")}
    assert specs.spec_errors(raw).count() == 3
    assert values(raw) == {"a": ("scalar", ["1"])}


def test_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    raw = read(spark, tmp_path / "in",
               s='# spec one\nname: "a \\"b\\" \\\\ c: #"\nnums: [1, -2]\nmix: ["1", x, 0.5]\n'
                 "t: !!python/tuple [0.1, 0.5, 0.1]\nf: 1.5\nd: {}\nn: null\nflag: true\n",
               t="# spec two\na: '007'\nb: yes\nc: [true, 'null']\n")
    write_specs(raw, str(tmp_path / "out"))
    back = read_specs(spark, str(tmp_path / "out"))
    # A dictionary keeps its name only; an item keeps its text.
    assert sorted(map(tuple, back.collect()), key=repr) == \
        sorted(map(tuple, raw.collect()), key=repr)


def test_many_documents_per_file(spark, tmp_path):
    text = "\n---\n".join(f"# spec s{i}\na: [{i}, {i + 1}]" for i in range(50))
    raw = read(spark, tmp_path, many=text + "\n")
    assert {r["spec_id"] for r in raw.collect()} == {f"s{i}" for i in range(50)}
    assert spec_documents(raw).count() == 50


@pytest.mark.parametrize("value, text", [
    (0.1 + 0.2, "0.3"), (1.0, "1.0"), (1e20, "1e+20"), (5, "5"), (True, "True"), ("x", "x")])
def test_value_text(value, text):
    assert value_text(value) == text


def test_unnamed_documents_stay_apart(spark, tmp_path):
    raw = read(spark, tmp_path, many="a: 1\n---\na: 2\n---\na: [3, 4]\n", other="a: 5\n")
    assert raw.select("spec_id").distinct().count() == 4
    assert specs.param_values(raw).count() == 4


def test_shared_name_is_an_error(spark, tmp_path):
    raw = read(spark, tmp_path, one="# spec x\na: [1, 2]\n", two="# spec x\nb: [1, 2, 3]\nc: 1\n",
               three="# spec y\na: 1\n")
    assert errors(raw) == {(None, "repeated")}
    assert [r["spec_id"] for r in specs.param_values(raw).collect()] == ["y"]


def test_too_many_combinations_is_an_error(spark, tmp_path):
    text = "".join(f"p{i}: [0, 1]\n" for i in range(64))
    raw = read(spark, tmp_path, big=text, small="a: [1, 2]\n")
    assert errors(raw) == {(None, "too_many")}
    assert specs.param_values(raw).count() == 1


def test_names_are_quoted(spark, tmp_path):
    raw = spark.createDataFrame(
        [("s", i, name, "int", ["1"], False) for i, name in enumerate(
            ["a: b", "#c", "true", "é", "d e", '"q"', "plain-1"], start=1)],
        "spec_id string, ord int, param string, type string, items array<string>, nested boolean")
    write_specs(raw, str(tmp_path / "out"))
    back = read_specs(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, raw.collect()))


def test_fractions_do_not_depend_on_the_session(spark, tmp_path):
    raw = read(spark, tmp_path, s="x: !!python/tuple [-0.000001, 0.5, 0.25]\n")
    expected = {"x": ("interval", ["-0.000001", "0.249999", "0.499999"])}
    try:
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            assert values(raw) == expected
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
