"""Reports of many hosts: keyed lists, references by position, registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paramloom.functions.text import local_as_zero, matches_glob, state


def keyed_list(lines: DataFrame) -> DataFrame:
    """``key,v1,v2,…`` lines to ``(record_id, key, pos, value)``, ``pos`` from 0."""
    parts = F.split("line", ",")
    return lines.select(
        "record_id", F.get(parts, F.lit(0)).alias("key"),
        F.posexplode(F.slice(parts, F.lit(2), F.size(parts))).alias("pos", "value"))


def resolve_alias(keyed: DataFrame, key: str = "workers") -> DataFrame:
    """The entries of ``key`` with ``local`` written as position 0."""
    return keyed.where(F.col("key") == key).withColumn("value", local_as_zero(F.col("value")))


def resolve_hosts(keyed: DataFrame, key: str = "workers") -> DataFrame:
    """``(record_id, pos, ref, host)``: host numbers looked up in the hosts line.

    A number without a host keeps its row with a NULL host.
    """
    refs = resolve_alias(keyed, key).select(
        "record_id", "pos", F.col("value").try_cast("int").alias("ref"))
    hosts = keyed.where(F.col("key") == "hosts").select(
        "record_id", F.col("pos").alias("ref"), F.col("value").alias("host"))
    return refs.join(hosts, ["record_id", "ref"], "left").select(
        "record_id", "pos", "ref", "host")


def remote_hosts(hosts: DataFrame, column: str = "host") -> DataFrame:
    """Without ``localhost`` and empty entries."""
    return hosts.where(~F.col(column).isin("localhost", ""))


def missing_fields(keyed: DataFrame, required: list[str] = (),
                   with_key: dict[str, list[str]] | None = None,
                   without_key: dict[str, list[str]] | None = None,
                   one_of: list[list[str]] = ()) -> DataFrame:
    """``(record_id, missing ARRAY)``: required keys that have no value.

    ``with_key`` and ``without_key`` name keys that are required if another is there or is
    not. Of each list in ``one_of`` a key must be there; otherwise it is reported as ``a or b``.
    """
    with_key, without_key = with_key or {}, without_key or {}
    keys = dict.fromkeys([*required, *with_key, *without_key])
    for more in (*with_key.values(), *without_key.values(), *one_of):
        keys.update(dict.fromkeys(more))
    has = {key: F.col(f"__has_{key}") for key in keys}
    present = [F.coalesce(F.max((F.col("key") == key) & (F.col("value") != "")), F.lit(False))
               .alias(f"__has_{key}") for key in keys]
    gaps = [F.when(~has[key], F.lit(key)) for key in required]
    gaps += [F.when(has[k] & ~has[key], F.lit(key)) for k, more in with_key.items() for key in more]
    gaps += [F.when(~has[k] & ~has[key], F.lit(key))
             for k, more in without_key.items() for key in more]
    for choice in one_of:
        any_of = F.lit(False)
        for key in choice:
            any_of = any_of | has[key]
        gaps.append(F.when(~any_of, F.lit(" or ".join(choice))))
    return keyed.groupBy("record_id").agg(*present).select(
        "record_id", F.array_distinct(F.array_compact(F.array(*gaps))).alias("missing"))


def host_list(keyed: DataFrame, separator: str = ", ") -> DataFrame:
    """``(record_id, hosts)``: the remote hosts of a record as one text, in order.

    A record's hosts came from one line, which bounds what a group gathers.
    """
    hosts = remote_hosts(keyed.where(F.col("key") == "hosts"), "value")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return hosts.groupBy("record_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["value"]), separator).alias("hosts"))


def with_precedence(given: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Key/value sets laid over each other; a given value beats the stored one."""
    return given.withColumnRenamed("value", "__given").join(
        stored.withColumnRenamed("value", "__stored"), keys, "full_outer"
    ).select(*keys, F.coalesce("__given", "__stored").alias("value"))


def state_columns(lines: DataFrame, names: list[str]) -> DataFrame:
    return lines.select("id", *[state(F.col("line"), name).alias(name.lower())
                                for name in names])


def registry(entries: DataFrame) -> DataFrame:
    """``(name, command, usage)`` from ``(ord, command, name, usage)``.

    A missing name is the command itself; the last entry of a name wins; entries
    without a command are skipped.
    """
    named = entries.where(F.col("command").isNotNull()).withColumn(
        "name", F.coalesce("name", "command"))
    return named.groupBy("name").agg(
        F.max_by("command", "ord").alias("command"), F.max_by("usage", "ord").alias("usage"))


def known_calls(calls: DataFrame, entries: DataFrame) -> DataFrame:
    """Calls whose name is registered."""
    return calls.join(registry(entries).select("name"), "name", "left_semi")


def unknown_calls(calls: DataFrame, entries: DataFrame) -> DataFrame:
    return calls.join(registry(entries).select("name"), "name", "left_anti")


def call_paths(calls: DataFrame, entries: DataFrame, location: str) -> DataFrame:
    """Adds ``path``, the file of the called command; NULL where it is not found."""
    files = registry(entries).select(
        "name", F.concat_ws("/", F.lit(location), "command").alias("path"))
    return calls.join(files, "name", "left")


def usages(entries: DataFrame) -> DataFrame:
    return registry(entries).select("name", "usage")


def keep_paths(paths: DataFrame, include: list[str] | None = None,
               exclude: list[str] | None = None) -> DataFrame:
    """Paths whose file name matches an include glob, if given, and no exclude glob."""
    if include:
        paths = paths.where(matches_glob(F.col("path"), include))
    if exclude:
        paths = paths.where(~matches_glob(F.col("path"), exclude))
    return paths
