"""Queries on fleet files, settings, registries and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from paramloom.functions import text
from paramloom.operators import fleet
from paramloom.plans import fixtures as fx
from paramloom.plans.registry import query, table
from paramloom.session import work_path
from paramloom.sources import records


def fx_keyed(spark, sf_dir):
    return fleet.keyed_list(fx.fx_fleet(spark, sf_dir))


@query("src_registry", """
    SELECT p_name AS command, p_brand AS name, p_type AS usage FROM part
""")
def src_registry(spark, sf_dir):
    """The registry written and read as CSV without a header."""
    path = work_path(spark, "registry")
    table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type").write.csv(path)
    return records.read_registry(spark, path).drop("ord")


@query("src_settings", "SELECT file_id, key, value FROM fx_setting", ("fx_setting",))
def src_settings(spark, sf_dir):
    return records.settings_lines(fx.fx_settings(spark, sf_dir))


@query("sink_settings", """
    SELECT file_id, key || '="' || value || '"' AS line FROM fx_setting
""", ("fx_setting",))
def sink_settings(spark, sf_dir):
    return records.settings_rows(src_settings(spark, sf_dir))


@query("fl_keyed_list", "SELECT record_id, key, pos, value FROM fx_keyed", ("fx_keyed",))
def fl_keyed_list(spark, sf_dir):
    return fx_keyed(spark, sf_dir)


@query("fl_resolve_ref", """
    SELECT w.record_id, w.pos, cast(replace(w.value, 'local', '0') AS integer) AS ref,
           h.value AS host
    FROM fx_keyed w LEFT JOIN fx_keyed h
         ON h.record_id = w.record_id AND h.key = 'hosts'
            AND h.pos = cast(replace(w.value, 'local', '0') AS integer)
    WHERE w.key = 'workers'
""", ("fx_keyed",))
def fl_resolve_ref(spark, sf_dir):
    return fleet.resolve_hosts(fx_keyed(spark, sf_dir))


@query("fl_alias", """
    SELECT record_id, pos, replace(value, 'local', '0') AS value FROM fx_keyed
    WHERE key = 'workers'
""", ("fx_keyed",))
def fl_alias(spark, sf_dir):
    return fleet.resolve_alias(fx_keyed(spark, sf_dir)).drop("key")


@query("fl_strip_user", """
    SELECT id, CASE WHEN contains(address, '@') THEN split_part(address, '@', 2)
               ELSE address END AS host FROM fx_address
""", ("fx_address",))
def fl_strip_user(spark, sf_dir):
    return fx.fx_address(spark, sf_dir).select(
        "id", text.host_of(F.col("address")).alias("host"))


@query("fl_build_address", """
    SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_name
           ELSE 'u' || c_custkey || '@' || c_name END AS address FROM customer
""")
def fl_build_address(spark, sf_dir):
    key = F.col("c_custkey")
    user = F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("u"), key.cast("string")))
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), text.address(user, F.col("c_name")).alias("address"))


@query("fl_precedence", """
    , given AS (SELECT c_custkey AS file_id, 'REMOTE_PATH' AS key, 'given' AS value FROM customer
                WHERE c_custkey % 5 = 0
                UNION ALL
                SELECT c_custkey, 'KEY', 'id_rsa' FROM customer WHERE c_custkey % 7 = 0)
    SELECT file_id, key, coalesce(g.value, s.value) AS value
    FROM given g FULL JOIN fx_setting s USING (file_id, key)
""", ("fx_setting",))
def fl_precedence(spark, sf_dir):
    key = F.col("c_custkey")
    given = table(spark, sf_dir, "customer").select(key.alias("file_id"), F.inline(F.array_compact(
        F.array(F.when(key % 5 == 0, F.struct(F.lit("REMOTE_PATH").alias("key"),
                                              F.lit("given").alias("value"))),
                F.when(key % 7 == 0, F.struct(F.lit("KEY").alias("key"),
                                              F.lit("id_rsa").alias("value")))))))
    return fleet.with_precedence(given, src_settings(spark, sf_dir), ["file_id", "key"])


@query("fl_exclude_local", """
    SELECT record_id, value AS host FROM fx_keyed
    WHERE key = 'hosts' AND value NOT IN ('localhost', '')
""", ("fx_keyed",))
def fl_exclude_local(spark, sf_dir):
    hosts = fx_keyed(spark, sf_dir).where("key = 'hosts'").select(
        "record_id", F.col("value").alias("host"))
    return fleet.remote_hosts(hosts)


@query("fl_validate", """
    SELECT record_id, CASE WHEN nation % 4 = 0 THEN 'remote_path|key' ELSE 'key' END AS missing
    FROM fx_fleet_record
""", ("fx_fleet_record",))
def fl_validate(spark, sf_dir):
    checked = fleet.missing_fields(fx_keyed(spark, sf_dir), ["remote_path", "folder", "key"])
    return checked.withColumn("missing", F.array_join("missing", "|"))


@query("fl_validate_rules", """
    SELECT record_id, concat_ws('|', CASE WHEN nation % 4 = 0 THEN 'remote_path' END, 'key',
           CASE WHEN nation % 4 = 0 THEN 'broker' END, 'user or key') AS missing
    FROM fx_fleet_record
""", ("fx_fleet_record",))
def fl_validate_rules(spark, sf_dir):
    """Fields that are required with or without others, and choices."""
    checked = fleet.missing_fields(
        fx_keyed(spark, sf_dir), with_key={"folder": ["remote_path", "key"]},
        without_key={"remote_path": ["broker", "folder"]},
        one_of=[["user", "key"], ["master", "workers"]])
    return checked.withColumn("missing", F.array_join("missing", "|"))


@query("fl_join_hosts", """
    SELECT record_id, array_to_string(names, ', ') AS hosts FROM fx_fleet_record
""", ("fx_fleet_record",))
def fl_join_hosts(spark, sf_dir):
    return fleet.host_list(fx_keyed(spark, sf_dir))


@query("fl_state_map", """
    SELECT p_partkey AS id, p_size || '.' || (p_partkey % 100) AS nvdrv,
           CASE WHEN p_partkey % 5 <> 0 THEN '/usr/local/cuda-' || p_size || '.1' END AS cuda,
           p_size || '.5-1' AS cudnn
    FROM part
""")
def fl_state_map(spark, sf_dir):
    return fleet.state_columns(fx.fx_state(spark, sf_dir), ["NVDRV", "CUDA", "cuDNN"])


@query("fl_version", """
    SELECT id, nullif(regexp_extract(line, '([0-9.]+)', 1), '') AS driver,
           nullif(regexp_extract(line, 'cuDNN:([0-9.]+-[0-9]+)', 1), '') AS package,
           array_to_string(regexp_extract_all(line, '[0-9.]+'), '|') AS numbers
    FROM fx_state
""", ("fx_state",))
def fl_version(spark, sf_dir):
    line = F.col("line")
    return fx.fx_state(spark, sf_dir).select(
        "id", text.version(line).alias("driver"),
        text.version(line, r"cuDNN:([0-9.]+-[0-9]+)").alias("package"),
        F.array_join(F.regexp_extract_all(line, F.lit("[0-9.]+"), F.lit(0)), "|")
        .alias("numbers"))


@query("fl_registry", "SELECT name, command, usage FROM fx_registered", ("fx_registered",))
def fl_registry(spark, sf_dir):
    return fleet.registry(fx.fx_registry(spark, sf_dir))


@query("fl_known", """
    SELECT call_id, name FROM fx_call WHERE name IN (SELECT name FROM fx_registered)
""", ("fx_call", "fx_registered"))
def fl_known(spark, sf_dir):
    return fleet.known_calls(fx.fx_call(spark, sf_dir), fx.fx_registry(spark, sf_dir))


@query("fl_unknown", """
    SELECT call_id, name FROM fx_call WHERE name NOT IN (SELECT name FROM fx_registered)
""", ("fx_call", "fx_registered"))
def fl_unknown(spark, sf_dir):
    return fleet.unknown_calls(fx.fx_call(spark, sf_dir), fx.fx_registry(spark, sf_dir))


@query("fl_call_path", """
    SELECT call_id, name, 'scripts/' || command AS path FROM fx_call LEFT JOIN fx_registered
    USING (name)
""", ("fx_call", "fx_registered"))
def fl_call_path(spark, sf_dir):
    return fleet.call_paths(fx.fx_call(spark, sf_dir), fx.fx_registry(spark, sf_dir), "scripts")


@query("fl_list", "SELECT name, usage FROM fx_registered", ("fx_registered",))
def fl_list(spark, sf_dir):
    return fleet.usages(fx.fx_registry(spark, sf_dir))


@query("fl_path_filter", r"""
    SELECT page_id, path FROM fx_path
    WHERE NOT regexp_matches(path, '/\.[^/]*$') AND NOT regexp_matches(path, '\.pyc$')
""", ("fx_path",))
def fl_path_filter(spark, sf_dir):
    return fleet.keep_paths(fx.fx_path(spark, sf_dir), exclude=[".*", "*.pyc"])


@query("fl_path_keep", r"SELECT page_id, path FROM fx_path WHERE path LIKE '%.csv'", ("fx_path",))
def fl_path_keep(spark, sf_dir):
    return fleet.keep_paths(fx.fx_path(spark, sf_dir), include=["*.csv"])
