"""Messages, output lines, commands and the result log on literal cases."""

import random

from pyspark.sql import functions as F

from paramloom.functions import text
from paramloom.operators import history, messages
from paramloom.sources import records, runlog

MESSAGE = ("task_id string, seq bigint, status string, out string, err string, text string, "
           "result string, detail string")


def message_frame(spark):
    return spark.createDataFrame([
        ("t", 0, "MSG", "a\tb\x1b[1m\n", None, None, None, None),
        ("t", 1, "MSG", "\n", "oops", None, None, None),
        ("t", 2, "MSG", None, None, "plain", None, None),
        ("t", 3, "SUCCESS", None, None, None, None, None),
        ("t", 4, "SUCCESS", None, None, None, "42", None),
        ("t", 5, "FAILURE", None, None, None, None, '{"k":1,"m":"x"}'),
        ("t", 6, "REVOKED", None, None, None, "gone", None),
    ], MESSAGE)


def test_routes(spark):
    rows = messages.route(message_frame(spark)).orderBy("seq").collect()
    assert [r["route"] for r in rows] == ["message"] * 3 + ["result"] * 2 + ["other"] * 2


def test_streams(spark):
    rows = [tuple(r) for r in messages.split_streams(message_frame(spark), clean=True).collect()]
    assert rows == [("t", 0, "out", "ab[1m"), ("t", 1, "err", "oops")]


def test_log_rows(spark):
    rows = [r["value"] for r in runlog.message_rows(message_frame(spark)).orderBy("seq").collect()]
    assert rows == ["t,ab[1m", "plain", "t,42"]


def test_details(spark):
    rows = messages.detail_lines(message_frame(spark)).collect()
    assert {(r["seq"], r["line"]) for r in rows} == {(5, "k : 1"), (5, "m : x"), (6, "gone")}


def test_empty_payloads_are_ignored(spark):
    kept = messages.without_empty(messages.payload(message_frame(spark))).orderBy("seq").collect()
    assert [r["seq"] for r in kept] == [0, 1]


def test_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    tasks = spark.createDataFrame([("t", {"n": "5", "flag": ""}), ("u", {"m": "a"})],
                                  "task_id string, params map<string,string>")
    runlog.write_headers(tasks, path)
    runlog.append_messages(message_frame(spark), path)
    rows = {(r["task_id"], r["kind"], str(r["params"]), r["text"])
            for r in runlog.read_log(spark, path).collect()}
    assert rows == {
        ("t", "header", "{'n': '5', 'flag': ''}", None), ("u", "header", "{'m': 'a'}", None),
        ("t", "row", "None", "ab[1m"), (None, "plain", "None", "plain"),
        ("t", "row", "None", "42")}
    runlog.write_headers(tasks, path)
    assert runlog.read_log(spark, path).count() == 2


def test_odd_log_rows(spark, tmp_path):
    (tmp_path / "run.csv").write_text("t,a=1,a=2,\nt,\nt,k=v\nt,x=1,\n,\n\n")
    (tmp_path / "notes.txt").write_text("skip me\n")
    rows = [(r["task_id"], r["kind"], r["params"], r["text"])
            for r in runlog.read_log(spark, str(tmp_path), "*.csv").collect()]
    assert sorted(rows, key=repr) == sorted([
        ("t", "row", None, "a=1,a=2,"), ("t", "row", None, ""), ("t", "row", None, "k=v"),
        ("t", "header", {"x": "1"}, None), ("", "row", None, ""), (None, "plain", None, "")],
        key=repr)


def test_script_output(spark):
    """11 lines of stdout, 5 of stderr, code 125."""
    log = spark.createDataFrame(
        [("t", "out", i, f"o{i}") for i in range(11)] + [("t", "err", i, f"e{i}") for i in range(5)],
        "task_id string, stream string, line_no bigint, line string")
    emitted = history.out_then_err(log, rows_per_block=3).orderBy("emit_no").collect()
    assert [r["line"] for r in emitted] == [f"o{i}" for i in range(11)] + [f"e{i}" for i in range(5)]
    assert [r["emit_no"] for r in emitted] == list(range(1, 17))
    turns = history.interleave(log, burst=3, rows_per_block=2).orderBy("turn_no").collect()
    assert [r["line"] for r in turns] == [
        "o0", "o1", "o2", "e0", "e1", "e2", "o3", "o4", "o5", "e3", "e4",
        "o6", "o7", "o8", "o9", "o10"]
    assert [r["turn_no"] for r in turns] == list(range(1, 17))
    burst = history.interleave(log).orderBy("turn_no").collect()
    assert [r["line"] for r in burst][:11] == [f"o{i}" for i in range(11)]
    code = spark.range(1).select(text.exit_code(F.lit("exitcode=125")).alias("a"),
                                 text.exit_code(F.lit(" exitcode=1")).alias("b"),
                                 text.exit_code(F.lit("exitcode=99999999999")).alias("c")).first()
    assert tuple(code) == (125, None, None)


def test_output_in_pieces(spark):
    lines = [(t, i, f"{t}{i}") for t in ("hot", "b") for i in range(250 if t == "hot" else 2)]
    random.Random(1).shuffle(lines)
    log = spark.createDataFrame(lines, "task_id string, line_no bigint, line string")
    pieces = history.accumulate(log, lines_per_piece=100).orderBy("task_id", "piece").collect()
    assert [(r["task_id"], r["piece"]) for r in pieces] == [
        ("b", 0), ("hot", 0), ("hot", 1), ("hot", 2)]
    whole = "\n".join(r["text"] for r in pieces if r["task_id"] == "hot")
    assert whole == "\n".join(f"hot{i}" for i in range(250))


def test_commands(spark):
    rows = [("h", 1, "2024-01-01 00:00:02", "ls -l /tmp", None),
            ("h", 2, "2024-01-01 00:00:01", "run  x", 0),
            ("h", 3, "2024-01-01 00:00:03", "stop", 7),
            ("g", 4, "2024-01-01 00:00:03", "wait", -9),
            ("h", 1, "2024-01-01 00:00:02", "ls -l /tmp", None)]
    commands = spark.createDataFrame(rows, "host string, id bigint, ts string, command string, "
                                           "exitcode int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert dict(history.first_exit(commands).collect()) == {"h": 0, "g": -9}
    assert [r["id"] for r in history.failed(commands).collect()] == [3]
    indexed = history.history(commands).where("host = 'h'").orderBy("idx")
    assert [(r["idx"], r["id"]) for r in indexed.collect()] == [(0, 2), (1, 1), (2, 3)]
    wanted = spark.createDataFrame([("h", 1), ("h", 9), ("g", 0)], "host string, idx bigint")
    found = history.history_lookup(commands, wanted).collect()
    assert {(r["host"], r["command"]) for r in found} == {("h", "ls -l /tmp"), ("g", "wait")}
    shown = {r["command_repr"] for r in history.command_repr(commands).collect()}
    assert shown == {"ls -l /tmp", "run  x (0)", "stop (7)", "wait (-9)"}
    tokens = {r["id"]: (r["name"], r["args"]) for r in history.command_tokens(commands).collect()}
    assert tokens[1] == ("ls", ["-l", "/tmp"])
    assert tokens[2] == ("run", ["", "x"])
    assert tokens[3] == ("stop", [])


def test_step_gaps_over_blocks(spark):
    steps = spark.createDataFrame(
        [(u, i, f"2024-01-01 00:{i // 60:02}:{i % 60:02}.{i:06}") for i in range(200)
         for u in [i % 3 if i % 2 else 0]], "user_id int, event_id bigint, ts string"
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    last, expected = {}, {}
    for i in range(200):
        u = i % 3 if i % 2 else 0
        expected[i] = None if u not in last else (i - last[u]) * 1_000_001
        last[u] = i
    got = {r["event_id"]: r["gap_us"] for r in history.step_gaps(steps).collect()}
    assert got == expected


def test_progress(spark):
    tasks = spark.createDataFrame([("t",), ("open",), ("silent",)], "task_id string")
    sent = message_frame(spark).unionByName(
        spark.createDataFrame([("open", 0, "MSG", "x", None, None, None, None)], MESSAGE))
    assert history.progress(tasks, sent).first().asDict() == {
        "total": 3, "finished": 1, "open": 2}
    assert {r[0] for r in history.open_tasks(tasks, sent).collect()} == {"open", "silent"}


def test_worker_records(spark):
    """14 workers with 14 rows each."""
    names = "АБВГДЕЁЖЗИЙКЛМ"
    lines = "".join(f"{w},{i},qwe\n" for i in range(14) for w in names)
    df = records.split_records(spark.createDataFrame([(lines,)], "text string"), ["W", "N", "Gomi"])
    counts = dict(df.groupBy("W").count().collect())
    assert df.count() == 196
    assert counts == {w: 14 for w in names}
    assert df.where("W = 'Ё'").count() == 14


def test_decoding_of_messages(spark):
    raw = spark.createDataFrame([(t,) for t in [
        '{"status":"MSG","task_id":"a","seq":1,"result":{"message":{"out":"x\\ny","err":""}}}',
        '{"status":"MSG","task_id":"a","seq":2,"result":{"message":"{\\"out\\":1}"}}',
        '{"status":"SUCCESS","task_id":"a","seq":3,"result":{"loss":0.5}}',
        '{"status":"SUCCESS","task_id":"a","seq":4,"result":null}',
        '{"status":"FAILURE","task_id":"a","seq":5,"result":{"k":null}}',
        '{"status":"RETRY","task_id":"a","seq":6,"result":"text"}', "no json", None]], "raw string")
    rows = [tuple(r)[1:] for r in messages.decode_message(raw).collect()]
    assert rows == [
        (1, "MSG", "x\ny", "", None, None, None), (2, "MSG", None, None, '{"out":1}', None, None),
        (3, "SUCCESS", None, None, None, '{"loss":0.5}', None),
        (4, "SUCCESS", None, None, None, None, None),
        (5, "FAILURE", None, None, None, None, '{"k":null}'),
        (6, "RETRY", None, None, None, "text", None),
        (None,) * 7, (None,) * 7]
