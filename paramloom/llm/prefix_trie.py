"""A trie of conversation prefixes by ``ROLLUP`` over positional turn columns.

A turn's id is a digest of role and text, with the text's length behind it. A conversation is cut
into blocks of ``WIDTH`` turns, a row each: the block's number, the node that the blocks before
it lead to, and the ids of its turns as columns. One ``ROLLUP`` over these columns aggregates
all prefixes of all blocks together, and ``grouping_id`` tells a prefix's length. A node is
named by two 64-bit hashes, sums without carry over the turns of its path, so that the node
a block starts from is known without waiting for the block before it.

Each node belongs to its smallest member, so a conversation's own nodes form one stretch of
its path, which hangs below a node of another conversation. Sums over subtrees are sums over
such stretches: totals of stretches go up their own, much lower tree by pointer doubling, and
a running sum along each stretch does the rest. Nothing grows with the square of a length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramloom.llm.tables import written
from paramloom.operators import ordering

WIDTH = 8
#: Conversations share their first turns in families of so many ids, at most so many turns.
FAMILY, MOST_SHARED = 100, 6
_TURNS = [f"t{i}" for i in range(1, WIDTH + 1)]


def numbered(chats: DataFrame) -> DataFrame:
    """``conv_id, pos, turn_id``: each conversation's turns in order, from 1.

    Equal turns are ordered by role and text.
    """
    text = [F.coalesce(c, F.lit("")) for c in ("role", "text")]
    rows = chats.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        text[0].alias("role"), text[1].alias("text"))
    rows = written(ordering.number_rows(
        rows, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], ordering.range_blocks(),
        "pos"), "numbered-turns")
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    return rows.select("conv_id", "pos", F.concat(
        digest, F.lit(":"), F.length("text").cast("string")).alias("turn_id"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, turn_id`` after conversations took their family's first turns.

    Conversation c starts with the first ``crc32(c) % 6`` turns of conversation ``c - c % 100``
    (all if it has fewer, none if there is none), and goes on with its own after as many.
    A row without pos stands for a conversation that is left without turns.
    """
    convs = turns.select("conv_id").distinct().select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
        (F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED).alias("h"))
    firsts = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < MOST_SHARED))
    taken = convs.join(firsts.withColumnRenamed("conv_id", "base"), "base", "left").where(
        "pos is null or pos <= h or pos = 1").select(
        "conv_id", "h", F.when(F.col("pos") <= F.col("h"), F.col("pos")).alias("pos"), "turn_id")
    taken = written(taken, "shared-turns")
    heads = taken.groupBy("conv_id", "h").agg(F.count("pos").alias("shared"))
    own = turns.join(heads, "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("shared")).alias("pos"), "turn_id")
    shared = taken.where("pos is not null").select("conv_id", "pos", "turn_id")
    bare = heads.where("shared = 0").select(
        "conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("turn_id"))
    return own.unionByName(shared).unionByName(bare)


def _mark(seed: str, turn, at):
    return F.xxhash64(F.lit(seed), at, turn)


def blocks(rows: DataFrame) -> DataFrame:
    """``conv_id, block, n, own1, own2, prior1, prior2, t1 ...``: a row per block of turns.

    ``n`` turns lie in the block; ``own`` are the hashes of its turns, ``prior`` those of all
    turns before it.
    """
    slot = F.col("pos") - 1
    cut = rows.withColumns({"block": F.coalesce(ordering.whole(slot, WIDTH), F.lit(0).cast("long")),
                            "slot": slot % WIDTH})
    picked = [F.max(F.when(F.col("slot") == i, F.col("turn_id"))).alias(t)
              for i, t in enumerate(_TURNS)]
    marks = [F.coalesce(F.bit_xor(F.when(F.col("pos").isNotNull(), _mark(s, F.col("turn_id"), F.col("pos")))),
                        F.lit(0)).cast("long").alias(n)
             for s, n in (("a", "own1"), ("b", "own2"))]
    made = cut.groupBy("conv_id", "block").agg(F.count("pos").alias("n"), *marks, *picked)
    made = written(made, "turn-blocks")
    for own, prior in (("own1", "prior1"), ("own2", "prior2")):
        made = ordering.running(made, ["conv_id"], [F.col("block")],
                                ordering.id_blocks(F.col("block")), F.col(own), "__upto", F.bit_xor)
        made = made.withColumn(prior, F.col("__upto").bitwiseXOR(F.col(own))).drop("__upto")
    return written(made, "keyed-blocks")


_ROLLUP = f"""
SELECT block, prior1, prior2, {WIDTH} - bit_count(grouping_id()) AS level,
       array({', '.join(_TURNS)}) AS turns, count(*) AS n_convs, min(conv_id) AS conv_id
FROM {{made}} GROUP BY block, prior1, prior2, ROLLUP({', '.join(_TURNS)})
"""


def prefixes(made: DataFrame) -> DataFrame:
    """``depth, f1, f2, p1, p2, conv_id, n_convs, chars``: all nodes, by their hashes.

    ``p1, p2`` name the parent; ``chars`` is the length of the node's last text.
    """
    rolled = made.sparkSession.sql(_ROLLUP, made=made).withColumn(
        "last", F.get("turns", F.col("level") - 1)).where(
        "last is not null or (level = 0 and block = 0)")
    depth = F.col("block") * WIDTH + F.col("level")

    def upto(seed: str, prior: str, level):
        marks = F.transform(F.slice("turns", F.lit(1), level), lambda t, i: _mark(
            seed, t, F.col("block") * WIDTH + i + 1))
        return F.aggregate(marks, F.col(prior), lambda a, x: a.bitwiseXOR(x))

    level = F.col("level").cast("int")
    above = F.greatest(level - 1, F.lit(0))
    chars = F.coalesce(F.element_at(F.split("last", ":"), 2).cast("long"), F.lit(0).cast("long"))
    return rolled.select(
        depth.alias("depth"), upto("a", "prior1", level).alias("f1"),
        upto("b", "prior2", level).alias("f2"), upto("a", "prior1", above).alias("p1"),
        upto("b", "prior2", above).alias("p2"), "conv_id", "n_convs", chars.alias("chars"))


def _digests(batches):
    """SHA-256 of each node's ids, from rows sorted by node and id; ids aren't held."""
    key, state = None, None
    for batch in batches:
        done = []
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        change = np.zeros(len(columns[0]), bool)
        for c in columns[:3]:
            change[1:] |= c[1:] != c[:-1]
        for begin, end in zip(cuts := np.r_[0, np.flatnonzero(change)], np.r_[cuts[1:], len(change)]):
            now = tuple(int(c[begin]) for c in columns[:3])
            text = ",".join(map(str, columns[3][begin:end].tolist())).encode()
            if now == key:
                state.update(b"," + text)
            else:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256(text)
        if done:
            yield _digest_batch(done)
    if key is not None:
        yield _digest_batch([(*key, state.hexdigest())])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    d, f, g, s = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(d, pa.int64()), pa.array(f, pa.int64()), pa.array(g, pa.int64()), pa.array(s)],
        ["depth", "f1", "f2", "ends_sha256"])


def _ends(made: DataFrame) -> DataFrame:
    """``depth, f1, f2, ends_sha256`` of the nodes where conversations end."""
    whole = made.groupBy("conv_id").agg(
        F.sum("n").alias("depth"), F.bit_xor("own1").alias("f1"), F.bit_xor("own2").alias("f2"))
    key = ["depth", "f1", "f2"]
    return whole.select(*key, "conv_id").repartition(*key).sortWithinPartitions(
        *key, "conv_id").mapInArrow(_digests, "depth long, f1 long, f2 long, ends_sha256 string")


def _totals(stretches: DataFrame) -> DataFrame:
    """``stretch, leaves, saved``: sums over a stretch and all that hang below it.

    ``stretches`` has ``stretch, up, leaves, saved``. Each round a stretch gives what it
    gathered to the one twice as far up; the rounds grow with the logarithm of the height.
    """
    now = written(stretches, "stretches")
    while not now.where("up is not null").isEmpty():
        given = now.where("up is not null").groupBy(F.col("up").alias("stretch")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = now.select(F.col("stretch").alias("up"), F.col("up").alias("next"))
        zero = F.lit(0).cast("long")
        now = written(now.join(further, "up", "left").join(given, "stretch", "left").select(
            "stretch", F.col("next").alias("up"),
            (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved")), "stretches")
    return now.select("stretch", "leaves", "saved")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of ``rows`` (conv_id, pos, turn_id), one row each.

    ``conv_id`` is a node's smallest member, ``parent_conv_id`` its parent's. ``n_leaves`` and
    ``saved_tokens`` are sums over the subtree, the node included.
    """
    made = blocks(rows)
    nodes = written(prefixes(made), "prefix-nodes")
    key = ["depth", "f1", "f2"]
    kids = nodes.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(
        F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"),
                           F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    zero = F.lit(0).cast("long")
    nodes = (nodes.join(kids, key, "left").join(_ends(made), key, "left")
             .join(parents, ["depth", "p1", "p2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        F.when(F.col("n_children").isNull(), F.lit(1)).otherwise(0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
    nodes = written(nodes, "trie-nodes")
    top = F.col("parent_conv_id").isNull() | (F.col("parent_conv_id") != F.col("conv_id"))
    tops = nodes.where(top).select(
        F.col("conv_id").alias("stretch"), F.col("parent_conv_id").alias("up"),
        (F.col("depth") - 1).alias("at"))
    own = nodes.groupBy(F.col("conv_id").alias("stretch")).agg(
        F.sum("leaf").alias("leaves"), F.sum("tokens").alias("saved"))
    totals = _totals(tops.join(own, "stretch").select("stretch", "up", "leaves", "saved"))
    hung = tops.where("up is not null").join(totals, "stretch").groupBy(
        F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(
        F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    nodes = written(nodes.join(hung, ["conv_id", "depth"], "left").withColumns({
        "leaf": F.col("leaf") + F.coalesce("hung_leaves", zero),
        "tokens": F.col("tokens") + F.coalesce("hung_saved", zero)}).drop(
        "hung_leaves", "hung_saved"), "trie-values")
    upwards = -F.col("depth")
    for value, name in (("leaf", "n_leaves"), ("tokens", "saved_tokens")):
        nodes = ordering.running_sum(nodes, ["conv_id"], [upwards], ordering.id_blocks(upwards),
                                     F.col(value), name)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                        "saved_tokens", "ends_sha256")


def conversation_trie(chats: DataFrame) -> DataFrame:
    """The prefix trie of ``chats`` (conv_id, turn, role, text), rebuilt by families first.

    Turns are ordered by turn, null first, then by role and text; null roles and texts are
    empty. Repeated rows are turns of their own. Rows without conv_id belong to no conversation
    and are left out; a conversation is there even if rebuilding leaves it without turns, and is
    then a member of the root alone. Other columns are ignored; an empty table gives no rows,
    not even a root.
    """
    return trie(rebuilt(numbered(chats)))


#: The unsigned CRC-32 of an ASCII text, bit by bit.
CRC32_SQL = """xor(list_reduce(
    [4294967295::UBIGINT] || flatten(list_transform(range(1, length({key}) + 1),
      lambda i: list_transform(range(0, 8), lambda k: ((ascii({key}[i]) >> k::INTEGER) & 1)::UBIGINT))),
    lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)
  ), 4294967295::UBIGINT)"""

SQL = f"""
WITH pos AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           coalesce(role, ''), coalesce(text, '')) AS p,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT c.conv_id, c.conv_id - c.conv_id % {FAMILY} AS base, c.k % {MOST_SHARED} AS h
  FROM (SELECT conv_id, CAST({CRC32_SQL.format(key="(conv_id::VARCHAR)")} AS BIGINT) AS k
        FROM (SELECT DISTINCT conv_id FROM pos)) c
), shared AS (
  SELECT c.conv_id, p.p, p.role, p.text
  FROM conv c JOIN pos p ON p.conv_id = c.base AND p.p <= c.h
), n_shared AS (
  SELECT c.conv_id, c.h, count(s.p) AS n FROM conv c LEFT JOIN shared s USING (conv_id)
  GROUP BY ALL
), turns AS (
  SELECT * FROM shared UNION ALL
  SELECT p.conv_id, p.p - n.h + n.n, p.role, p.text
  FROM pos p JOIN n_shared n USING (conv_id) WHERE p.p > n.h
), paths AS (
  SELECT c.conv_id, coalesce(list({{'r': role, 't': text}} ORDER BY p) FILTER (p IS NOT NULL), []) AS path
  FROM conv c LEFT JOIN turns t USING (conv_id) GROUP BY c.conv_id
), steps AS (
  SELECT conv_id, unnest(range(0, len(path) + 1)) AS depth, path FROM paths
), nodes AS (
  SELECT path[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(CASE WHEN len(path) = depth THEN conv_id::VARCHAR END, ','
                    ORDER BY conv_id) AS ends
  FROM steps GROUP BY ALL
), linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id,
         (n.n_convs - 1) * CASE WHEN n.depth > 0 THEN length(n.prefix[n.depth].t) ELSE 0 END AS saved
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
), kids AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children
  FROM linked WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT l.*, coalesce(k.n_children, 0) AS n_children
  FROM linked l LEFT JOIN kids k USING (conv_id, depth)
), below AS (
  SELECT a.conv_id, a.depth, sum(CASE WHEN d.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
         sum(d.saved) AS saved_tokens
  FROM counted d JOIN nodes a ON a.depth <= d.depth AND a.prefix = d.prefix[1:a.depth]
  GROUP BY ALL
)
SELECT c.conv_id, c.depth, c.parent_conv_id, c.n_convs, c.n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens,
       sha256(coalesce(c.ends, '')) AS ends_sha256
FROM counted c JOIN below b USING (conv_id, depth)
"""
