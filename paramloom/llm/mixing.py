"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell (source, language and topic), and the cells' weights are raked until
their sums per source, per language and per topic meet the targets. A cell's weight is how many
copies of each of its documents the mixture holds on average: a document gets the whole part for
certain, and one copy more with the probability of the rest, by a hash of its id. So targets are met
also where they ask for more than the data hold once, and nothing is cut.

Values without a target count as ``OTHER``; cells are thus at most as many as the product of the
target lists' lengths, whatever the data, and only their sums reach the driver.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paramloom.llm.tables import written

OTHER = "other"
ROUNDS = 20
SHARE = 0.5
SEED = "mix"
TARGETS: dict[str, dict[str, float]] = {
    "source": {**{f"src{i}": 1.0 for i in range(20)}, OTHER: 1.0},
    "lang": {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15, OTHER: 0.05},
    "topic": {"legal": 0.05, "contact": 0.15, "listing": 0.1, "figures": 0.2, "prose": 0.5},
}
#: The first pattern that a text holds names its topic.
TOPICS = [("legal", "[Ll]icen[cs]e"), ("contact", "@"), ("listing", " [|] "), ("figures", "[0-9]")]


def topic_of(text: Column) -> Column:
    """A topic by plain signs in the whole text; null and empty texts are prose."""
    found = F.when(F.lit(False), "")
    for name, pattern in TOPICS:
        found = found.when(text.rlike(pattern), name)
    return found.otherwise("prose")


def _value(column: Column, targets: dict[str, float]) -> Column:
    return F.when(column.isin([k for k in targets if k != OTHER]), column).otherwise(OTHER)


def measured(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens``: words are counted on whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _value(F.col("source"), targets["source"]).alias("source"),
        _value(F.col("lang"), targets["lang"]).alias("lang"),
        _value(topic_of(text), targets["topic"]).alias("topic"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("n_tokens"))


def rake(cells: dict[tuple, float], dims: list[str], targets: dict[str, dict[str, float]],
         rounds: int = ROUNDS) -> dict[tuple, float]:
    """Factors per cell by which its tokens are multiplied to meet the targets.

    Targets of values that no cell has are left out, the others keep their proportions. The
    factors keep the total. Cells without tokens have factor 1.
    """
    kept = [k for k in cells if cells[k] > 0]
    if not kept:
        return dict.fromkeys(cells, 1.0)
    start = np.array([cells[k] for k in kept], float)
    weights = start / start.sum()
    places, goals = [], []
    for i, dim in enumerate(dims):
        values = sorted({k[i] for k in kept})
        goal = np.array([targets[dim].get(v, 0.0) for v in values])
        places.append(np.array([values.index(k[i]) for k in kept]))
        goals.append(goal / goal.sum() if goal.sum() else np.ones(len(goal)) / len(goal))
    for _, (place, goal) in itertools.product(range(rounds), list(zip(places, goals))):
        sums = np.bincount(place, weights, minlength=len(goal))
        weights = weights * (goal / np.where(sums > 0, sums, 1))[place]
    factors = weights / weights.sum() * start.sum() / start
    return {**dict.fromkeys(cells, 1.0), **dict(zip(kept, factors.tolist()))}


def _uniform(doc_id: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("none")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def _weights(rows: DataFrame, targets: dict[str, dict[str, float]], share: float,
             rounds: int) -> DataFrame:
    """``weight`` of each cell of ``rows`` of ``measured``: ``share`` times its factor."""
    dims = list(targets)
    cells = {tuple(r[:-1]): float(r[-1]) for r in
             rows.groupBy(*dims).agg(F.sum("n_tokens")).collect()}
    return rows.sparkSession.createDataFrame(
        [(*k, float(round(share * f, 9))) for k, f in rake(cells, dims, targets, rounds).items()],
        ", ".join(f"{d} string" for d in dims) + ", weight double")


def _copies(doc_id: Column, weight: Column, seed: str) -> Column:
    whole = F.floor(weight)
    return (whole + (_uniform(doc_id, seed) < weight - whole).cast("long")).cast("long")


def mixed(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, share: float = SHARE,
          rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, weight, copies, kept`` for each row of ``docs``.

    ``docs`` has doc_id, text, source and lang; null values of source and lang count as
    ``OTHER``, null texts as empty. The mixture holds ``copies`` of a row, ``weight`` on average;
    it has about ``share`` of all tokens. Rows of one doc_id and cell share their fate; rows without
    doc_id are drawn together. Other columns are ignored; an empty table gives no rows.
    """
    rows = written(measured(docs, targets), "mix-rows")
    weighed = rows.join(F.broadcast(_weights(rows, targets, share, rounds)), list(targets))
    copies = _copies(F.col("doc_id"), F.col("weight"), seed)
    return weighed.withColumn("copies", copies).withColumn("kept", F.col("copies") > 0)


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] = TARGETS, share: float = SHARE,
           rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """The mixture: rows of ``docs``, all columns, each as often as ``mixed`` says.

    A row's cell and draw follow from the row and the broadcast weights; no row is shuffled.
    """
    cells = _weights(measured(docs, targets), targets, share, rounds).toDF(
        *[f"__{d}" for d in targets], "__weight")
    own = {"source": F.col("source"), "lang": F.col("lang"),
           "topic": topic_of(F.coalesce(F.col("text"), F.lit("")))}
    known = docs.withColumns({f"__{d}": _value(own[d], targets[d]) for d in targets})
    drawn = known.join(F.broadcast(cells), [f"__{d}" for d in targets])
    copies = _copies(F.col("doc_id").cast("long"), F.col("__weight"), seed).cast("int")
    return drawn.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies))).select(
        *[F.col(c) for c in docs.columns])


def _sql() -> str:
    """The query in SQL: the rounds are written out one after the other."""
    def value(column, dim):
        names = ", ".join(f"'{v}'" for v in TARGETS[dim] if v != OTHER)
        return f"CASE WHEN {column} IN ({names}) THEN {column} ELSE '{OTHER}' END AS {dim}"
    topics = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in TOPICS)
    goals = " UNION ALL ".join(f"SELECT '{d}' AS dim, '{v}' AS value, {w} AS goal"
                               for d, t in TARGETS.items() for v, w in t.items())
    parts = [
        "raw AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents)",
        f"topics AS (SELECT *, CASE {topics} ELSE 'prose' END AS kind FROM raw)",
        "measured AS (SELECT doc_id, " + value("source", "source") + ", " + value("lang", "lang")
        + ", " + value("kind", "topic")
        + ", len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM topics)",
        "cells AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n FROM measured "
        "GROUP BY ALL)",
        f"goals AS ({goals})",
        "full_cells AS (SELECT *, n / sum(n) OVER () AS w0 FROM cells WHERE n > 0)",
    ]
    for dim in TARGETS:
        parts.append(
            f"goal_{dim} AS (SELECT value, goal / sum(goal) OVER () AS goal FROM goals "
            f"WHERE dim = '{dim}' AND value IN (SELECT {dim} FROM full_cells))")
    parts.append(
        "r0 AS (SELECT c.*, gs.goal AS gs, gl.goal AS gl, gt.goal AS gt, w0 AS w FROM full_cells c "
        "JOIN goal_source gs ON gs.value = source JOIN goal_lang gl ON gl.value = lang "
        "JOIN goal_topic gt ON gt.value = topic)")
    step = 0
    for _ in range(ROUNDS):
        for dim, goal in (("source", "gs"), ("lang", "gl"), ("topic", "gt")):
            parts.append(f"r{step + 1} AS (SELECT * REPLACE (w * {goal} / sum(w) OVER "
                         f"(PARTITION BY {dim}) AS w) FROM r{step})")
            step += 1
    parts.append(f"factors AS (SELECT source, lang, topic, w / sum(w) OVER () * sum(n) OVER () / n "
                 f"AS f FROM r{step})")
    return ("WITH " + ", ".join(parts) + f"""
    , p AS (SELECT m.*, round({SHARE} * coalesce(f, 1.0), 9)::DOUBLE AS weight
            FROM measured m LEFT JOIN factors USING (source, lang, topic))
    , drawn AS (SELECT *, (floor(weight) + CASE WHEN
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'none') || ':{SEED}'), 1, 13))::BIGINT
             / 4503599627370496.0 < weight - floor(weight) THEN 1 ELSE 0 END)::BIGINT AS copies
      FROM p)
    SELECT doc_id, source, lang, topic, n_tokens, weight, copies, copies > 0 AS kept
    FROM drawn""")


SQL = _sql()
