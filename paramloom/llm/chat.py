"""Tool calls of chats: linked with their results, ordered, validated and written as JSON.

Calls and results meet in a hash join by identifier. Calls that use other calls' results come
after them: levels are found by joins, one round per level for all chats at once, so that a chat
of any length is spread over all tasks. Arguments are checked against the tools' schemas, and
each call becomes one canonical JSON object (sorted names, no spaces, no escapes for other
letters).
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paramloom.llm.tables import written

#: Parameters of the tools: type, whether required, allowed values or None.
SCHEMAS: dict[str, dict[str, tuple[str, bool, list | None]]] = {
    "search": {"query": ("string", True, None), "limit": ("integer", False, None)},
    "translate": {"text": ("string", True, None), "to": ("string", True, ["en", "fr", "de", "es"])},
    "count": {"text": ("string", True, None), "unique": ("boolean", False, None)},
}
_TYPES = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
}


def problems(name: str | None, arguments: str | None, schemas: dict) -> tuple[list[str], object]:
    """What is wrong with the arguments of a call, sorted, and their parsed value."""
    try:
        value = json.loads(arguments or "")
    except ValueError:
        return ["arguments: no JSON"], None
    if name not in schemas:
        return ["name: no such tool"], value
    if not isinstance(value, dict):
        return ["arguments: no object"], value
    found = [f"{p}: unknown" for p in value if p not in schemas[name]]
    for p, (kind, required, allowed) in schemas[name].items():
        if p not in value:
            found += [f"{p}: missing"] if required else []
        elif not _TYPES[kind](value[p]):
            found.append(f"{p}: no {kind}")
        elif allowed is not None and value[p] not in allowed:
            found.append(f"{p}: not allowed")
    return sorted(found), value


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _records(schemas: dict):
    names = ["conv_id", "call_id", "turn", "level", "status"]

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            errors, records = [], []
            for r in rows:
                found, value = problems(r["name"], r["arguments"], schemas)
                errors.append(found)
                records.append(canonical({
                    "arguments": value, "id": r["call_id"], "name": r["name"],
                    "needs": sorted(r["needs"] or []), "result": r["content"]}))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(n)) for n in names),
                 pa.array([not e for e in errors], pa.bool_()),
                 pa.array(errors, pa.list_(pa.string())), pa.array(records, pa.string())],
                [*names, "valid", "errors", "record"])
    return run


def _levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level``: 0 without needs, else one more than the highest need's.

    Needs of calls that don't exist don't count here. Calls on a circle, or after one, have no row.
    """
    key = ["conv_id", "call_id"]
    wanted = calls.select(*key, F.explode(F.array_distinct("needs")).alias("need"))
    exists = calls.select("conv_id", F.col("call_id").alias("need"))
    needs = written(wanted.join(exists, ["conv_id", "need"]), "call-needs")
    open_calls = written(needs.groupBy(*key).agg(F.count("*").alias("n")), "call-counts")
    done = written(calls.select(*key).join(open_calls, key, "left_anti").withColumn(
        "level", F.lit(0)), "call-levels")
    level = 0
    while True:
        met = needs.join(done.select("conv_id", F.col("call_id").alias("need"), "level"),
                         ["conv_id", "need"]).groupBy(*key).agg(
            F.count("*").alias("met"), F.max("level").alias("below"))
        ready = met.join(open_calls, key).where(
            (F.col("met") == F.col("n")) & (F.col("below") == level)).select(
            *key, (F.col("below") + 1).alias("level"))
        ready = written(ready, "call-levels")
        if ready.isEmpty():
            return done
        done, level = done.unionByName(ready), level + 1


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row per call: ``conv_id, call_id, turn, level, status, valid, errors, record``.

    ``calls`` has conv_id, call_id, turn, name, arguments (JSON) and needs (call ids whose results
    it uses); ``results`` has conv_id, call_id, turn, content. Within a chat, (level, turn,
    call_id) is a topological order, in which the rows are written. Of calls or results with the
    same identifiers the one of the earliest turn counts (then of the smallest content).
    ``status`` is ``linked``, ``no result``, ``missing need`` (a need is no call of the chat),
    ``circle`` (level null), or ``no id``: calls without conv_id or call_id link with nothing,
    each row stays, level null. Results of no call are left out; ``orphans`` lists them. Null
    arguments are invalid. Other columns are ignored; empty tables give no rows.
    """
    key = ["conv_id", "call_id"]
    every = calls.select(*key, "turn", "name", "arguments",
                         F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))
    has_id = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    one = every.where(has_id).groupBy(*key).agg(
        F.min(F.struct("turn", "name", "arguments", "needs")).alias("call")).select(
        *key, "call.*")
    one = written(one, "calls")
    answers = results.where(has_id).groupBy(*key).agg(
        F.min(F.struct("turn", "content")).alias("result"))
    missing = (one.select(*key, F.explode("needs").alias("need"))
               .join(one.select("conv_id", F.col("call_id").alias("need")),
                     ["conv_id", "need"], "left_anti").select(*key).distinct()
               .withColumn("missing", F.lit(True)))
    placed = (one.join(answers.hint("shuffle_hash"), key, "left").join(_levels(one), key, "left")
              .join(missing, key, "left"))
    status = (F.when(F.col("level").isNull(), "circle").when(F.col("missing"), "missing need")
              .when(F.col("result").isNull(), "no result").otherwise("linked"))
    linked = placed.select(*key, "turn", "level", status.alias("status"), "name", "arguments",
                           "needs", F.col("result.content").alias("content"))
    lost = every.where(~has_id).select(
        *key, "turn", F.lit(None).cast("int").alias("level"), F.lit("no id").alias("status"),
        "name", "arguments", "needs", F.lit(None).cast("string").alias("content"))
    types = ", ".join(f"{c} {dict(every.dtypes)[c]}" for c in (*key, "turn"))
    done = linked.unionByName(lost).mapInArrow(
        _records(schemas),
        f"{types}, level int, status string, valid boolean, errors array<string>, record string")
    order = ["conv_id", "level", "turn", "call_id"]
    return done.repartitionByRange(*order).sortWithinPartitions(*order)


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results that no call asked for."""
    return results.join(calls.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"],
                        "left_anti")


def _id(conv: Column, turn: Column) -> Column:
    return F.concat_ws("-", conv.cast("string"), turn.cast("string"))


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that plain chats stand for.

    A user's turn is a call: its text is the argument, the tool goes by the turn, and it needs
    the call made half as far into the chat. The assistant's turn after it is the result. Some
    texts' lengths make arguments that break a schema, as models do.
    """
    conv, turn, n = F.col("conv_id"), F.col("turn"), F.length(F.coalesce("text", F.lit("")))
    tool = F.element_at(F.array(*map(F.lit, SCHEMAS)), (F.pmod(turn, F.lit(3)) + 1).cast("int"))
    to = F.element_at(F.array(*map(F.lit, ["en", "fr", "de", "es", "xx"])),
                      (F.pmod(n, F.lit(5)) + 1).cast("int"))
    bad = F.pmod(n, F.lit(11)) == 0
    arguments = (
        F.when(tool == "search", F.when(bad, F.to_json(F.struct(
            n.cast("string").alias("limit"), F.col("text").alias("query")))).otherwise(
            F.to_json(F.struct(n.alias("limit"), F.col("text").alias("query")))))
        .when(tool == "translate", F.to_json(F.struct(to.alias("to"), "text")))
        .otherwise(F.when(bad, F.to_json(F.struct(F.lit(True).alias("unique")))).otherwise(
            F.to_json(F.struct((n % 2 == 0).alias("unique"), "text")))))
    half = F.floor(turn / 2)
    half = half + F.pmod(half + turn, F.lit(2))
    needs = F.when(turn >= 2, F.array(_id(conv, half))).otherwise(F.array().cast("array<string>"))
    needs = F.when(half < turn, needs).otherwise(F.array().cast("array<string>"))
    calls = conversations.where("role = 'user'").select(
        conv, F.when(conv.isNotNull() & turn.isNotNull(), _id(conv, turn)).alias("call_id"), turn,
        tool.alias("name"), arguments.alias("arguments"), needs.alias("needs"))
    results = conversations.where("role = 'assistant'").select(
        conv, F.when(conv.isNotNull() & turn.isNotNull(), _id(conv, turn - 1)).alias("call_id"),
        turn, F.col("text").alias("content"))
    return calls, results
