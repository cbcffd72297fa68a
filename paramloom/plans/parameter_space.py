"""Queries on parameter specifications and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from paramloom.functions import params
from paramloom.operators import grid, specs
from paramloom.plans import fixtures as fx
from paramloom.plans.registry import query, table
from paramloom.session import work_path
from paramloom.sources.specs import read_specs, spec_documents, write_specs

KIND_SQL = """CASE type WHEN 'list' THEN 'list' WHEN 'tuple' THEN 'interval'
    WHEN 'bool' THEN 'flag' WHEN 'dict' THEN 'dict' ELSE 'scalar' END"""
REASON_SQL = """CASE WHEN type = 'dict' THEN 'dict'
    WHEN type = 'list' AND len(items) = 0 THEN 'empty'
    WHEN type = 'tuple' AND len(items) < 2 THEN 'short' END"""

# Parameters of a combination of fx_grid as sorted text, and as JSON in declared order.
GRID_TEXT_SQL = """concat_ws(',', 'epoch=' || epoch, 'model=' || model, 'unit=' || unit,
    CASE WHEN is_verbose THEN 'verbose=' END)"""


def fx_values(spark, sf_dir):
    return specs.param_dimensions(fx.fx_spec(spark, sf_dir))


def fx_grid(spark, sf_dir):
    return grid.grid(fx_values(spark, sf_dir))


def _items(df):
    return F.array_join("items", "|")


@query("src_param_spec", """
    SELECT spec_id, ord, param, type, array_to_string(items, '|') AS items FROM fx_spec
""", ("fx_spec",))
def src_param_spec(spark, sf_dir):
    path = work_path(spark, "specs")
    write_specs(fx.fx_spec(spark, sf_dir), path)
    rows = read_specs(spark, path)
    return rows.select("spec_id", "ord", "param", "type", _items(rows).alias("items"))


@query("sink_param_spec", r"""
    SELECT '# spec p' || p_partkey || chr(10) || 'model: ["' || p_brand || '","' || p_type
           || '"]' || chr(10) || 'verbose: '
           || CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END || chr(10)
           || 'unit: ' || p_size || chr(10) || 'epoch: '
           || CASE WHEN p_partkey % 13 = 0 THEN '{}'
                   WHEN p_partkey % 17 = 0 THEN '!!python/tuple [' || p_size || ']'
                   WHEN p_partkey % 19 = 0 THEN '[]'
                   ELSE '!!python/tuple [' || p_size || ', ' || (p_size + 1 + p_partkey % 7)
                        || ', ' || (1 + p_partkey % 3) || ']' END AS text
    FROM part
""")
def sink_param_spec(spark, sf_dir):
    return spec_documents(fx.fx_spec(spark, sf_dir)).select("text")


@query("ps_classify", f"""
    SELECT spec_id, ord, param, {KIND_SQL} AS kind, {REASON_SQL} AS reason FROM fx_spec
""", ("fx_spec",))
def ps_classify(spark, sf_dir):
    checked = specs.with_reason(specs.classify(fx.fx_spec(spark, sf_dir)))
    return checked.select("spec_id", "ord", "param", "kind", "reason")


@query("ps_list", """
    SELECT 'p' || p_partkey AS spec_id, 1 AS ord, 'model' AS param, pos, value FROM (
        SELECT p_partkey, unnest([0, 1]) AS pos, unnest([p_brand, p_type]) AS value FROM part)
""")
def ps_list(spark, sf_dir):
    listed = specs.classify(fx.fx_spec(spark, sf_dir)).where("kind = 'list'")
    return specs.value_rows(specs.expand_values(listed))


@query("ps_interval", """
    SELECT spec_id, unnest(range(0, len(range(start, stop, step))))::integer AS pos,
           cast(unnest(range(start, stop, step)) AS varchar) AS value
    FROM fx_interval
""", ("fx_interval",))
def ps_interval(spark, sf_dir):
    values = params.interval_values(F.col("start"), F.col("stop"), F.col("step"))
    return fx.fx_interval(spark, sf_dir).select(
        "spec_id", F.posexplode(values).alias("pos", "value"))


@query("ps_interval_fraction", """
    SELECT p_partkey AS part, i::integer AS pos,
           CASE WHEN tenths % 10 = 0 THEN cast(tenths // 10 AS varchar)
                ELSE (tenths // 10) || '.' || (tenths % 10) END AS value
    FROM (SELECT p_partkey, i, p_size + i * (1 + p_partkey % 3) AS tenths
          FROM part, range(0, 40) r(i)
          WHERE i * (1 + p_partkey % 3) < 10 + p_partkey % 25)
""")
def ps_interval_fraction(spark, sf_dir):
    """Steps of tenths, exact where binary fractions are not."""
    tenth = F.lit("0.1").cast("decimal(3,1)")
    key, size = F.col("p_partkey"), F.col("p_size").cast("decimal(10,0)")
    start = size * tenth
    stop = (size + (F.lit(10) + key % 25).cast("decimal(10,0)")) * tenth
    step = (key % 3 + 1).cast("decimal(10,0)") * tenth
    return table(spark, sf_dir, "part").select(key.alias("part"), F.posexplode(
        params.interval_values(start, stop, step)).alias("pos", "value"))


@query("ps_list_interval", """
    SELECT spec_id, unnest(range(0, len(v)))::integer AS pos, cast(unnest(v) AS varchar) AS value
    FROM (SELECT spec_id, range(start, stop, CASE WHEN part % 5 = 0 AND step > 0 THEN 1
                                             ELSE step END) AS v FROM fx_interval)
""", ("fx_interval",))
def ps_list_interval(spark, sf_dir):
    """Lists ``[start, end, step?]`` read as intervals; the step defaults to 1."""
    start, stop, step = (F.col(c).cast("string") for c in ("start", "stop", "step"))
    raw = fx.fx_interval(spark, sf_dir).select(
        "spec_id", F.lit(1).alias("ord"), F.lit("n").alias("param"), F.lit("list").alias("type"),
        F.when((F.col("part") % 5 == 0) & (F.col("step") > 0), F.array(start, stop))
        .otherwise(F.array(start, stop, step)).alias("items"), F.lit(False).alias("nested"))
    expanded = specs.expand_values(specs.classify(raw, list_as_interval=True))
    return specs.value_rows(expanded).select("spec_id", "pos", "value")


@query("ps_flag", """
    SELECT 'p' || p_partkey AS spec_id, 'verbose' AS param, '' AS value FROM part
    WHERE p_partkey % 2 = 0
""")
def ps_flag(spark, sf_dir):
    flags = specs.classify(fx.fx_spec(spark, sf_dir)).where("kind = 'flag'")
    return specs.value_rows(specs.expand_values(flags)).select("spec_id", "param", "value")


@query("ps_scalar", """
    SELECT 'p' || p_partkey AS spec_id, 'unit' AS param, cast(p_size AS varchar) AS value
    FROM part
""")
def ps_scalar(spark, sf_dir):
    scalars = specs.classify(fx.fx_spec(spark, sf_dir)).where("kind = 'scalar'")
    return specs.value_rows(specs.expand_values(scalars)).select("spec_id", "param", "value")


@query("ps_reject", f"""
    SELECT spec_id, param, reason
    FROM (SELECT spec_id, param, {REASON_SQL} AS reason FROM fx_spec) WHERE reason IS NOT NULL
""", ("fx_spec",))
def ps_reject(spark, sf_dir):
    return specs.spec_errors(fx.fx_spec(spark, sf_dir))


@query("ps_reject_limits", """
    SELECT 'p' || p_partkey AS spec_id, CASE WHEN p_partkey % 4 IN (1, 2) THEN 'x' END AS param,
           ['too_many', 'range', 'too_many', 'repeated'][p_partkey % 4 + 1] AS reason
    FROM part WHERE p_partkey % 4 <> 0 OR p_partkey % 40 = 0
""")
def ps_reject_limits(spark, sf_dir):
    """Specs beyond the limits, each with the reason: no job ends, no spec is lost."""
    key = F.col("p_partkey")

    def parameter(position, name, type_, *items):
        return F.struct(position.cast("int").alias("ord"), name.alias("param"),
                        F.lit(type_).alias("type"), F.array(*map(F.lit, items)).alias("items"))

    one, x = F.lit(1), F.lit("x")
    wide = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: parameter(
        i, F.concat(x, i.cast("string")), "list", "0", "1"))
    rows = (F.when(key % 40 == 0, wide)
            .when(key % 4 == 1, F.array(parameter(one, x, "tuple", "0", "1e15", "0.5")))
            .when(key % 4 == 2, F.array(parameter(one, x, "tuple", "0", "10000000000")))
            .when(key % 4 == 3, F.array(parameter(one, x, "int", "1"),
                                        parameter(one, x, "int", "2")))
            .otherwise(F.array(parameter(one, x, "int", "1"))))
    raw = table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), key.cast("string")).alias("spec_id"), F.inline(rows)
    ).withColumn("nested", F.lit(False))
    return specs.spec_errors(raw)


@query("ps_values", """
    SELECT spec_id, count(DISTINCT model) AS models, count(DISTINCT epoch) AS epochs
    FROM fx_grid GROUP BY spec_id
""", ("fx_grid",))
def ps_values(spark, sf_dir):
    """The good specs, with how many values two of their parameters have."""
    def size_of(name):
        return F.coalesce(F.max(F.when(F.col("param") == name, F.col("n"))), F.lit(0))

    return fx_values(spark, sf_dir).groupBy("spec_id").agg(
        size_of("model").cast("bigint").alias("models"),
        size_of("epoch").cast("bigint").alias("epochs"))


@query("ps_cross_join", """
    SELECT spec_id, combo_id, concat_ws('|', model, CASE WHEN is_verbose THEN '' END, unit,
           cast(epoch AS varchar)) AS combination FROM fx_grid
""", ("fx_grid",))
def ps_cross_join(spark, sf_dir):
    folded = grid.grid_by_folding(fx_values(spark, sf_dir))
    return folded.select("spec_id", "combo_id", F.array_join("combination", "|").alias("combination"))


@query("ps_grid_decode", f"""
    SELECT spec_id, combo_id, {GRID_TEXT_SQL} AS params_text FROM fx_grid
""", ("fx_grid",))
def ps_grid_decode(spark, sf_dir):
    return grid.with_params_text(fx_grid(spark, sf_dir)).drop("params")


@query("ps_grid_dims", """
    SELECT combo_id, event, segment, region FROM fx_dims_grid
""", ("fx_dims_grid",))
def ps_grid_dims(spark, sf_dir):
    combinations = grid.grid(fx.fx_dims(spark, sf_dir))
    return combinations.select("combo_id", *[F.col("params")[c].alias(c)
                                             for c in ("event", "segment", "region")])


@query("ps_wide", """
    SELECT 'p' || p_partkey AS spec_id, count(*) AS combinations,
           cast(sum(rate * (p_size + i * 3)) AS bigint) AS total, max(p_size + i * 3) AS last
    FROM part, range(0, 200 + p_partkey % 7) r(i), (SELECT unnest([1, 2, 5]) AS rate)
    GROUP BY p_partkey, p_size
""")
def ps_wide(spark, sf_dir):
    """Wide intervals stay rules until a combination is decoded."""
    size, key = F.col("p_size"), F.col("p_partkey")
    stop = size + (F.lit(200) + key % 7) * 3
    rows = F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("epoch").alias("param"), F.lit("tuple").alias("type"),
                 F.array(*[x.cast("string") for x in (size, stop, F.lit(3))]).alias("items")),
        F.struct(F.lit(2).alias("ord"), F.lit("rate").alias("param"), F.lit("list").alias("type"),
                 F.array(F.lit("1"), F.lit("2"), F.lit("5")).alias("items")))
    raw = table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), key.cast("string")).alias("spec_id"), F.inline(rows)
    ).withColumn("nested", F.lit(False))
    made = grid.grid(specs.param_dimensions(raw)).select(
        "spec_id", *[F.col("params")[c].cast("bigint").alias(c) for c in ("epoch", "rate")])
    return made.groupBy("spec_id").agg(
        F.count("*").alias("combinations"), F.sum(F.col("epoch") * F.col("rate")).alias("total"),
        F.max("epoch").alias("last"))


@query("ps_concat", """
    SELECT p_partkey AS part, concat_ws('|', p_brand, p_type, p_name) AS combination FROM part
""")
def ps_concat(spark, sf_dir):
    joined = grid.concat_values(F.array("p_brand", "p_type"), F.array("p_name"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"), F.array_join(joined, "|").alias("combination"))


@query("ps_cardinality", """
    SELECT spec_id, count(*) AS combinations FROM fx_grid GROUP BY spec_id
""", ("fx_grid",))
def ps_cardinality(spark, sf_dir):
    return grid.cardinality(fx_values(spark, sf_dir))


@query("ps_wrap_map", """
    SELECT spec_id, combo_id, concat_ws(',', 'epoch=' || coalesce(cast(epoch AS varchar), '20'),
           'gpu=-1', 'model=' || model, 'unit=' || unit, CASE WHEN is_verbose THEN 'verbose=' END)
           AS params_text
    FROM fx_grid
""", ("fx_grid",))
def ps_wrap_map(spark, sf_dir):
    """Combinations laid over a base dictionary."""
    base = F.create_map(F.lit("epoch"), F.lit("20"), F.lit("gpu"), F.lit("-1"))
    wrapped = params.overlay(base, F.map_keys("params"), F.col("params"))
    return fx_grid(spark, sf_dir).select(
        "spec_id", "combo_id", params.dictionary_text(wrapped).alias("params_text"))


@query("ps_carry_forward", """
    SELECT run, order_id, cast(5 + sum(c) OVER (
        PARTITION BY run ORDER BY c ROWS UNBOUNDED PRECEDING) AS bigint) AS n FROM fx_carry
""", ("fx_carry",))
def ps_carry_forward(spark, sf_dir):
    carried = grid.carry_forward(fx.fx_carry(spark, sf_dir), "run", "c", "c", base=5)
    return carried.select("run", "order_id", "n")


@query("ps_render_options", """
    SELECT spec_id, combo_id, concat_ws(' ', 'python -u train.py', '--model ' || model,
           CASE WHEN is_verbose THEN '--verbose' END, '--unit ' || unit, '--epoch ' || epoch)
           AS command
    FROM fx_grid
""", ("fx_grid",))
def ps_render_options(spark, sf_dir):
    text = params.options_text(F.col("params"), "python -u train.py")
    return fx_grid(spark, sf_dir).select("spec_id", "combo_id", text.alias("command"))


@query("ps_to_json", """
    SELECT spec_id, combo_id, '{' || concat_ws(',', '"model":"' || model || '"',
           CASE WHEN is_verbose THEN '"verbose":""' END, '"unit":"' || unit || '"',
           '"epoch":"' || epoch || '"') || '}' AS json
    FROM fx_grid
""", ("fx_grid",))
def ps_to_json(spark, sf_dir):
    return fx_grid(spark, sf_dir).select(
        "spec_id", "combo_id", params.to_json(F.col("params")).alias("json"))


@query("ps_from_json", """
    SELECT event_id, json_extract_string(props, '$.k') AS k FROM events
""")
def ps_from_json(spark, sf_dir):
    decoded = params.from_json(F.col("props"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.try_element_at(decoded, F.lit("k")).alias("k"))


@query("ps_json_round_trip", f"""
    SELECT spec_id, combo_id, {GRID_TEXT_SQL} AS params_text FROM fx_grid
""", ("fx_grid",))
def ps_json_round_trip(spark, sf_dir):
    back = params.from_json(params.to_json(F.col("params")))
    return fx_grid(spark, sf_dir).select(
        "spec_id", "combo_id", params.dictionary_text(back).alias("params_text"))


@query("ps_task_id", f"""
    SELECT spec_id, combo_id, sha256(concat_ws(chr(1), spec_id, cast(combo_id AS varchar),
           {GRID_TEXT_SQL})) AS task_id FROM fx_grid
""", ("fx_grid",))
def ps_task_id(spark, sf_dir):
    return grid.tasks(fx_grid(spark, sf_dir)).select("spec_id", "combo_id", "task_id")
