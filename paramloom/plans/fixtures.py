"""Inputs of the registered queries, derived from whole tables.

Each recipe exists twice: as a Spark function and as SQL under the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paramloom.operators import ordering
from paramloom.plans.registry import recipe, table

# --- parameter specifications -------------------------------------------------


def fx_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
    step = F.lit(1) + key % 3
    stop = size + key % 7 - 1
    down = key % 11 == 0
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), key.cast("string")).alias("spec_id"), key.alias("part"),
        F.when(down, stop).otherwise(size).alias("start"),
        F.when(down, size).otherwise(stop).alias("stop"),
        F.when(down, -step).otherwise(step).alias("step"))


recipe("fx_interval", """
    SELECT 'p' || p_partkey AS spec_id, p_partkey AS part,
           CASE WHEN p_partkey % 11 = 0 THEN p_size + p_partkey % 7 - 1 ELSE p_size END AS start,
           CASE WHEN p_partkey % 11 = 0 THEN p_size ELSE p_size + p_partkey % 7 - 1 END AS stop,
           CASE WHEN p_partkey % 11 = 0 THEN -1 - p_partkey % 3 ELSE 1 + p_partkey % 3 END AS step
    FROM part
""")


def fx_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw parameter rows, four per part, some of them to be rejected."""
    key, size = F.col("p_partkey"), F.col("p_size")
    start, stop = size.cast("string"), (size + 1 + key % 7).cast("string")
    step = (key % 3 + 1).cast("string")

    def parameter(position, name, type_, items):
        return F.struct(F.lit(position).alias("ord"), F.lit(name).alias("param"),
                        type_.alias("type"), items.alias("items"))

    epoch_type = (F.when(key % 13 == 0, "dict").when(key % 17 == 0, "tuple")
                  .when(key % 19 == 0, "list").otherwise("tuple"))
    epoch_items = (F.when(key % 13 == 0, F.lit(None).cast("array<string>"))
                   .when(key % 17 == 0, F.array(start))
                   .when(key % 19 == 0, F.array().cast("array<string>"))
                   .otherwise(F.array(start, stop, step)))
    rows = F.array(
        parameter(1, "model", F.lit("list"), F.array("p_brand", "p_type")),
        parameter(2, "verbose", F.lit("bool"),
                  F.array(F.when(key % 2 == 0, "True").otherwise("False"))),
        parameter(3, "unit", F.lit("int"), F.array(start)),
        parameter(4, "epoch", epoch_type, epoch_items))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), key.cast("string")).alias("spec_id"), F.inline(rows)
    ).withColumn("nested", F.lit(False))


recipe("fx_spec", """
    SELECT 'p' || p_partkey AS spec_id, p_partkey AS part, 1 AS ord, 'model' AS param,
           'list' AS type, [p_brand, p_type] AS items FROM part
    UNION ALL
    SELECT 'p' || p_partkey, p_partkey, 2, 'verbose', 'bool',
           [CASE WHEN p_partkey % 2 = 0 THEN 'True' ELSE 'False' END] FROM part
    UNION ALL
    SELECT 'p' || p_partkey, p_partkey, 3, 'unit', 'int', [cast(p_size AS varchar)] FROM part
    UNION ALL
    SELECT 'p' || p_partkey, p_partkey, 4, 'epoch',
           CASE WHEN p_partkey % 13 = 0 THEN 'dict' WHEN p_partkey % 17 = 0 THEN 'tuple'
                WHEN p_partkey % 19 = 0 THEN 'list' ELSE 'tuple' END,
           CASE WHEN p_partkey % 13 = 0 THEN NULL
                WHEN p_partkey % 17 = 0 THEN [cast(p_size AS varchar)]
                WHEN p_partkey % 19 = 0 THEN []
                ELSE [cast(p_size AS varchar), cast(p_size + 1 + p_partkey % 7 AS varchar),
                      cast(1 + p_partkey % 3 AS varchar)] END
    FROM part
""")

# The grid of every good spec, from arithmetic on the parts alone.
recipe("fx_grid", """
    SELECT spec_id, model, is_verbose, unit, epoch,
           row_number() OVER (PARTITION BY spec_id ORDER BY model_pos, epoch) - 1 AS combo_id
    FROM (
        SELECT 'p' || p_partkey AS spec_id, m.pos AS model_pos,
               CASE WHEN m.pos = 0 THEN p_brand ELSE p_type END AS model,
               p_partkey % 2 = 0 AS is_verbose, cast(p_size AS varchar) AS unit,
               unnest(CASE WHEN p_partkey % 13 = 0 THEN [NULL]
                      ELSE range(p_size, p_size + 1 + p_partkey % 7, 1 + p_partkey % 3) END)
                   AS epoch
        FROM part, (SELECT unnest([0, 1]) AS pos) m
        WHERE p_partkey % 13 = 0 OR (p_partkey % 17 <> 0 AND p_partkey % 19 <> 0)
    )
""")


def fx_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spec whose values are the categories of three tables."""
    def parameter(position, name, source, column):
        values = F.sort_array(F.collect_set(column))
        return table(spark, sf_dir, source).agg(values.alias("values")).select(
            F.lit("dims").alias("spec_id"), F.lit(position).alias("ord"),
            F.lit(name).alias("param"), F.lit("list").alias("kind"), "values")

    return (parameter(1, "event", "events", "event_type")
            .unionByName(parameter(2, "segment", "customer", "c_mktsegment"))
            .unionByName(parameter(3, "region", "region", "r_name")))


recipe("fx_dims", """
    SELECT 1 AS ord, event_type AS value, row_number() OVER (ORDER BY event_type) - 1 AS pos
    FROM (SELECT DISTINCT event_type FROM events)
    UNION ALL
    SELECT 2, c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1
    FROM (SELECT DISTINCT c_mktsegment FROM customer)
    UNION ALL
    SELECT 3, r_name, row_number() OVER (ORDER BY r_name) - 1
    FROM (SELECT DISTINCT r_name FROM region)
""")

recipe("fx_dims_grid", """
    SELECT row_number() OVER (ORDER BY a.pos, b.pos, c.pos) - 1 AS combo_id,
           a.value AS event, b.value AS segment, c.value AS region
    FROM fx_dims a, fx_dims b, fx_dims c WHERE a.ord = 1 AND b.ord = 2 AND c.ord = 3
""", ("fx_dims",))

# --- runs ---------------------------------------------------------------------


def fx_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("task_id"), (F.col("c_custkey") % 6).alias("n"))


recipe("fx_echo", """
    SELECT cast(c_custkey AS varchar) AS task_id, c_custkey % 6 AS n FROM customer
""")


def fx_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("order_id"))
    return ordering.number_rows(orders, ["run"], [F.col("order_id")],
                                ordering.id_blocks(F.col("order_id")), "c", first=0)


recipe("fx_carry", """
    SELECT o_custkey AS run, o_orderkey AS order_id,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS c
    FROM orders
""")


def fx_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    return documents.join(labels, "doc_id")


recipe("fx_kfold", """
    SELECT d.doc_id, l.quality AS y, d.n_chars FROM documents d JOIN labels l USING (doc_id)
""")

# --- messages and logs --------------------------------------------------------


def message_columns(events: DataFrame) -> DataFrame:
    """Events as messages, row by row (also on a stream)."""
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").cast("string").alias("task_id"), F.col("event_id").alias("seq"), "ts",
        F.when(kind == "purchase", "SUCCESS").when(kind == "error", "FAILURE")
        .otherwise("MSG").alias("status"),
        F.when(kind == "view", F.col("props")).alias("out"),
        F.when(kind == "click", F.col("props")).alias("err"),
        F.when(kind == "signup", kind).alias("text"),
        F.when((kind == "purchase") & (F.col("event_id") % 10 != 0),
               (F.col("value") * 100).cast("bigint").cast("string")).alias("result"),
        F.when(kind == "error", F.col("props")).alias("detail"))


def fx_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return message_columns(table(spark, sf_dir, "events"))


recipe("fx_message", """
    SELECT cast(user_id AS varchar) AS task_id, event_id AS seq, ts,
           CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILURE'
                ELSE 'MSG' END AS status,
           CASE WHEN event_type = 'view' THEN props END AS "out",
           CASE WHEN event_type = 'click' THEN props END AS err,
           CASE WHEN event_type = 'signup' THEN event_type END AS text,
           CASE WHEN event_type = 'purchase' AND event_id % 10 <> 0
                THEN cast(cast(trunc(value * 100) AS bigint) AS varchar) END AS result,
           CASE WHEN event_type = 'error' THEN props END AS detail
    FROM events
""")


def raw_messages(messages: DataFrame) -> DataFrame:
    """Messages as they are sent: ``raw``, the JSON text of status, result and task id."""
    def text(column):
        listed = F.to_json(F.array(column))
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    message = (F.when(F.col("out").isNotNull(), F.to_json(F.struct("out")))
               .when(F.col("err").isNotNull(), F.to_json(F.struct("err")))
               .otherwise(text("text")))
    result = (F.when(F.col("status") == "MSG", F.concat(F.lit('{"message":'), message, F.lit("}")))
              .when(F.col("status") == "SUCCESS", F.coalesce("result", F.lit("null")))
              .otherwise(F.coalesce("detail", F.lit("null"))))
    return messages.select(F.concat(
        F.lit('{"status":'), text("status"), F.lit(',"task_id":'), text("task_id"),
        F.lit(',"seq":'), F.col("seq").cast("string"), F.lit(',"result":'), result,
        F.lit("}")).alias("raw"))


def redelivered(messages: DataFrame) -> DataFrame:
    """Messages of every seventh number twice."""
    copies = F.when(F.col("seq") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return messages.withColumn("copy", F.explode(copies)).drop("copy")


def fx_redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redelivered(fx_message(spark, sf_dir))


def fx_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's task, and 20 tasks that never send anything."""
    users = table(spark, sf_dir, "events").select("user_id")
    silent = users.agg(F.max("user_id").alias("top")).select(
        F.explode(F.sequence(F.col("top") + 1, F.col("top") + 20)).alias("user_id"))
    return users.distinct().unionByName(silent).select(
        F.col("user_id").cast("string").alias("task_id"))


recipe("fx_task", """
    SELECT cast(user_id AS varchar) AS task_id FROM (
        SELECT DISTINCT user_id FROM events
        UNION ALL
        SELECT (SELECT max(user_id) FROM events) + i FROM range(1, 21) r(i))
""")


def fx_raw_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.concat(F.char(F.lit(27)), F.lit("[38;5;20m"), F.char(F.lit(9)))
    doc = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        doc.alias("task_id"),
        F.when(doc % 50 == 0, "").when(doc % 3 == 0, F.concat(mark, F.col("text")))
        .otherwise(F.col("text")).alias("text"))


recipe("fx_raw_out", """
    SELECT doc_id AS task_id,
           CASE WHEN doc_id % 50 = 0 THEN ''
                WHEN doc_id % 3 = 0 THEN chr(27) || '[38;5;20m' || chr(9) || text
                ELSE text END AS text
    FROM documents
""")


def fx_log_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("task_id"), "turn",
        F.when(F.col("role") == "assistant", "out").otherwise("err").alias("stream"),
        F.col("text").alias("line"))
    return ordering.number_rows(rows, ["task_id", "stream"], [F.col("turn")],
                                ordering.id_blocks(F.col("turn")), "line_no", first=0).drop("turn")


recipe("fx_log_line", """
    SELECT conv_id AS task_id, CASE WHEN role = 'assistant' THEN 'out' ELSE 'err' END AS stream,
           row_number() OVER (PARTITION BY conv_id, role = 'assistant' ORDER BY turn) - 1
               AS line_no, text AS line
    FROM conversations
""")


def command_columns(events: DataFrame) -> DataFrame:
    """Events as commands of a host, row by row (also on a stream)."""
    kind = F.col("event_type")
    return events.select(
        F.col("user_id").alias("host"), F.col("event_id").alias("id"), "ts",
        F.concat_ws(" ", kind, F.lit("--id"), F.col("event_id").cast("string")).alias("command"),
        F.when(kind == "purchase", F.lit(0))
        .when(kind == "error", (F.col("event_id") % 3 - 1).cast("int")).alias("exitcode"))


def fx_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    return command_columns(table(spark, sf_dir, "events"))


recipe("fx_command", """
    SELECT user_id AS host, event_id AS id, ts, event_type || ' --id ' || event_id AS command,
           CASE event_type WHEN 'purchase' THEN 0
                WHEN 'error' THEN cast(event_id % 3 - 1 AS integer) END AS exitcode
    FROM events
""")

# Numbers of one text piece: bounds how many lines are gathered into one text.
PIECE = 10_000


def fx_worker_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as lines of a text, one text per user and piece of event numbers."""
    line = F.concat_ws(",", "event_type", F.col("user_id").cast("string"),
                       F.col("event_id").cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "line")))
    return (table(spark, sf_dir, "events").withColumn("line", line)
            .groupBy("user_id", ordering.whole(F.col("event_id"), PIECE).alias("piece"))
            .agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text")))


# --- training reports ---------------------------------------------------------


def fx_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.lit("2024-01-01").cast("date")
    return table(spark, sf_dir, "events").select(
        F.date_diff("ts", start).alias("epoch"),
        F.when(F.col("event_id") % 2 == 0, "main").otherwise("validation").alias("split"),
        F.col("value").alias("loss"),
        F.when(F.col("event_type") == "click", 1).otherwise(0).alias("acc"), "ts")


recipe("fx_report", """
    SELECT date_diff('day', DATE '2024-01-01', cast(ts AS date))::integer AS epoch,
           CASE WHEN event_id % 2 = 0 THEN 'main' ELSE 'validation' END AS split,
           value AS loss, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS acc, ts
    FROM events
""")


def layer_weights(inputs: int, outputs: int):
    """Weights and bias by formula, the same in SQL."""
    import numpy as np

    i, j = np.arange(inputs)[:, None], np.arange(outputs)[None, :]
    return ((i * 31 + j * 17) % 7 - 3) / 64.0, (np.arange(outputs) % 3 - 1) / 10.0


def _layer_sql(source: str, inputs: int, outputs: int, relu: bool) -> str:
    total = f"""list_sum(list_transform(range(0, {inputs}), lambda i:
        cast({source}[i + 1] AS double) * ((i * 31 + j * 17) % 7 - 3) / 64.0))
        + (j % 3 - 1) / 10.0"""
    if relu:
        total = f"greatest({total}, 0.0)"
    return f"list_transform(range(0, {outputs}), lambda j: cast({total} AS double))"


recipe("fx_hidden", f"""
    SELECT vec_id, label, {_layer_sql('embedding', 64, 16, False)} AS z FROM embeddings
""")
recipe("fx_hidden2", f"""
    SELECT vec_id, label, {_layer_sql('h', 16, 16, True)} AS h2
    FROM (SELECT vec_id, label, list_transform(z, lambda x: greatest(x, 0.0)) AS h FROM fx_hidden)
""", ("fx_hidden",))
recipe("fx_logits", f"""
    SELECT vec_id, label, h2, {_layer_sql('h2', 16, 10, False)} AS z FROM fx_hidden2
""", ("fx_hidden2",))
recipe("fx_judged", """
    SELECT vec_id, label,
           ln(list_sum(list_transform(z, lambda x: exp(x)))) - z[label + 1] AS loss,
           CASE WHEN list_position(z, list_max(z)) - 1 = label THEN 1 ELSE 0 END AS correct
    FROM fx_logits
""", ("fx_logits",))

# The last layer's gradient of the loss; input 16 stands for the bias.
recipe("fx_gradient", """
    SELECT i::integer AS input, j::integer AS class, count(*) AS n,
           sum(CASE WHEN i < 16 THEN h2[least(i, 15) + 1] ELSE 1.0 END
               * (exp(z[j + 1]) / total - CASE WHEN label = j THEN 1 ELSE 0 END)) AS gradient
    FROM (SELECT *, list_sum(list_transform(z, lambda x: exp(x))) AS total FROM fx_logits),
         range(0, 17) a(i), range(0, 10) b(j)
    GROUP BY i, j
""", ("fx_logits",))

# --- fleets -------------------------------------------------------------------

# Suppliers of one fleet record, so that its hosts fit one line.
FLEET = 1_000


def fx_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(record_id, line)``: the lines of one fleet file per nation and supplier range."""
    nation, part = F.col("s_nationkey"), ordering.whole(F.col("s_suppkey"), FLEET)
    ordered = F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name")))
    names = F.array_join(F.transform(ordered, lambda x: x["s_name"]), ",")
    records = table(spark, sf_dir, "supplier").groupBy(
        nation.alias("nation"), part.alias("part")).agg(names.alias("names"))
    lines = F.array(
        F.concat(F.lit("hosts,localhost,"), F.col("names")), F.lit("workers,local,1,3,99999"),
        F.lit("master,1"),
        F.when(F.col("nation") % 4 != 0, F.concat(F.lit("remote_path,path/"),
                                                  F.col("nation").cast("string"))),
        F.lit("folder,proj"))
    return records.select(
        F.concat_ws(":", F.col("nation").cast("string"), F.col("part").cast("string"))
        .alias("record_id"), F.explode(F.array_compact(lines)).alias("line"))


recipe("fx_fleet_record", f"""
    SELECT s_nationkey || ':' || (s_suppkey // {FLEET}) AS record_id, s_nationkey AS nation,
           list(s_name ORDER BY s_suppkey) AS names
    FROM supplier GROUP BY s_nationkey, s_suppkey // {FLEET}
""")
recipe("fx_keyed", """
    SELECT record_id, 'hosts' AS key, pos, value FROM (
        SELECT record_id, unnest(range(0, len(names) + 1))::integer AS pos,
               unnest(list_prepend('localhost', names)) AS value FROM fx_fleet_record)
    UNION ALL
    SELECT record_id, 'workers', pos, value FROM (
        SELECT record_id, unnest([0, 1, 2, 3]) AS pos,
               unnest(['local', '1', '3', '99999']) AS value FROM fx_fleet_record)
    UNION ALL
    SELECT record_id, 'master', 0, '1' FROM fx_fleet_record
    UNION ALL
    SELECT record_id, 'remote_path', 0, 'path/' || nation FROM fx_fleet_record
    WHERE nation % 4 <> 0
    UNION ALL
    SELECT record_id, 'folder', 0, 'proj' FROM fx_fleet_record
""", ("fx_fleet_record",))


def fx_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(file_id, line_no, line)``: a settings file per customer."""
    key = F.col("c_custkey")
    lines = F.array(
        F.concat(F.lit('REMOTE_PATH="'), F.col("c_name"), F.lit('"')), F.lit('KEY=""'),
        F.when(key % 3 == 0, F.concat(F.lit('REMOTE_PATH="'), F.col("c_mktsegment"), F.lit('"'))),
        F.when(key % 2 == 0, F.lit('START_WORKER="local,1,2"')))
    return table(spark, sf_dir, "customer").select(
        key.alias("file_id"), F.posexplode(F.array_compact(lines)).alias("line_no", "line"))


recipe("fx_setting", """
    SELECT c_custkey AS file_id, 'REMOTE_PATH' AS key,
           CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_name END AS value FROM customer
    UNION ALL
    SELECT c_custkey, 'START_WORKER', 'local,1,2' FROM customer WHERE c_custkey % 2 = 0
""")


def fx_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.when(key % 2 == 1, F.concat(F.lit("user"), key.cast("string"), F.lit("@"),
                                      F.col("c_name")))
        .otherwise(F.col("c_name")).alias("address"))


recipe("fx_address", """
    SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 1
           THEN 'user' || c_custkey || '@' || c_name ELSE c_name END AS address FROM customer
""")


def fx_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select(key.alias("id"), F.concat(
        F.lit("NVDRV:"), size, F.lit("."), (key % 100).cast("string"),
        F.lit(",CUDA:"), F.when(key % 5 == 0, "x").otherwise(
            F.concat(F.lit("/usr/local/cuda-"), size, F.lit(".1"))),
        F.lit(",cuDNN:"), size, F.lit(".5-1")).alias("line"))


recipe("fx_state", """
    SELECT p_partkey AS id, 'NVDRV:' || p_size || '.' || (p_partkey % 100) || ',CUDA:'
           || CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE '/usr/local/cuda-' || p_size || '.1' END
           || ',cuDNN:' || p_size || '.5-1' AS line FROM part
""")


def fx_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("ord"), F.when(key % 23 != 0, F.col("p_name")).alias("command"),
        F.when(key % 10 != 0, F.col("p_brand")).alias("name"), F.col("p_type").alias("usage"))


recipe("fx_registry", """
    SELECT p_partkey AS ord, CASE WHEN p_partkey % 23 <> 0 THEN p_name END AS command,
           CASE WHEN p_partkey % 10 <> 0 THEN p_brand END AS name, p_type AS usage FROM part
""")
recipe("fx_registered", """
    SELECT name, arg_max(command, ord) AS command, arg_max(usage, ord) AS usage FROM (
        SELECT ord, command, coalesce(name, command) AS name, usage FROM fx_registry
        WHERE command IS NOT NULL) GROUP BY name
""", ("fx_registry",))


def fx_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of commands, some of names nobody registered."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("call_id"),
        F.concat(F.lit("Brand#"), (key % 40).cast("string")).alias("name"))


recipe("fx_call", """
    SELECT o_orderkey AS call_id, 'Brand#' || (o_orderkey % 40) AS name FROM orders
""")


def fx_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    base = F.regexp_replace(F.col("url"), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select(
        page.alias("page_id"),
        F.when(page % 4 == 1, F.concat(base, F.lit(".csv")))
        .when(page % 4 == 2, F.concat(base, F.lit(".pyc")))
        .when(page % 4 == 3, F.concat(base, F.lit("/.hidden"))).otherwise(base).alias("path"))


recipe("fx_path", r"""
    SELECT page_id, CASE page_id % 4 WHEN 1 THEN base || '.csv' WHEN 2 THEN base || '.pyc'
           WHEN 3 THEN base || '/.hidden' ELSE base END AS path
    FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS base FROM pages)
""")
