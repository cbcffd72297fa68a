"""Near-duplicate documents by bottom-k sketches of one hash function.

Each text becomes the set of its distinct five-word shingles. The k smallest hashes of a set are
its sketch. Inverted lists over the retained values propose pairs, the sketch of the union
filters them (after a coarse look at sizes and 128-bit signatures), and the full sets decide:
``100 * intersection >= percent * union``, with 80 percent or more.

A list is kept per run of neighbouring retained values and not per single value: a passage that
a third of all documents hold would otherwise make one list of a third of all documents. Two
sets of the threshold's similarity have at least 80 or 85 % of the union's smallest values in
common, so they share a run of four: always when both sets fit into the sketch and have enough
values (``_short_runs``: smaller sets also use shorter runs, as a few odd shingles may split
them), else with all but a 1e-8 chance for 85 % and 1e-6 for 80 % (k = 64).

No list is ever expanded into all its pairs at once. First every document of a list is
compared with the list's smallest document, and what is similar is joined into components.
Only lists that still hold several components then propose pairs across them, filtered within
the task by wider sketches. Documents of open lists with more than ``SMALL_LIST`` documents are
listed anew by the rarest values of their full sets, so many that similar sets share one for
certain (prefix filtering); these lists too are compared whole, the long ones in blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramloom.llm.components import components, relabelled
from paramloom.llm.tables import written
from paramloom.llm.words import mix, shingle_sets, slices, words_of

SHINGLE = 5
RETAINED = 64
PERCENT = 85
WIDE = 256
MARGIN = 6
SMALL_LIST = 2_000
RUN = 4
BUCKETS = 1 << 16
LEAST_PERCENT = 80


def _short_runs(percent: int) -> dict[int, int]:
    """Length of a run shorter than ``RUN`` -> the largest union whose sets may need it.

    Of u values at least ``percent`` are common; the others split them into stretches, the
    longest of which has at least as many values as this counts with.
    """
    out: dict[int, int] = {}
    for union in range(2, 64):
        odd = union * (100 - percent) // 100
        if odd:
            longest = -(-(union - odd) // (odd + 1))
            if longest < RUN:
                out[longest] = union
    return out


def _least_size(percent: int) -> int:
    """Sets of fewer values reach ``percent`` only with equal sets."""
    return next(n for n in range(1, 101) if 100 * n >= percent * (n + 1))


def _most_bits(percent: int) -> int:
    """How many of the 128 bits of two sets' signatures may differ: six standard deviations."""
    share = (100 - percent) / 200
    return int(128 * share + 6 * (128 * share * (1 - share)) ** 0.5)


def _least_estimate(percent: int, retained: int) -> float:
    """The least share on a union's sketch that is looked at further: five deviations less."""
    share = percent / 100
    return share - 5 * (share * (1 - share) / retained) ** 0.5


def _bits(values: np.ndarray) -> np.ndarray:
    """128 bits of a set: the lowest bit of the smallest value in each of 128 equal ranges."""
    values = np.sort(values)
    ranges = values >> np.uint64(57)
    first = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]])[:len(values)]
    flags = np.zeros(128, np.uint8)
    flags[ranges[first].astype(np.int64)] = values[first] & np.uint64(1)
    return np.packbits(flags).view(np.int64)


def _profiles(shingle: int, retained: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for begin, end in slices(texts):
                hashes = shingle_sets(words_of(texts.slice(begin, end - begin), lower=True), shingle)
                bits = np.array([_bits(s) for s in hashes])
                sets = [np.sort(s.view(np.int64)) for s in hashes]
                yield pa.RecordBatch.from_arrays([
                    ids.slice(begin, end - begin),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                              for s in sets], pa.binary()),
                    pa.array([s[:retained] for s in sets], pa.list_(pa.int64())),
                    pa.array(bits[:, 0]), pa.array(bits[:, 1]),
                ], ["doc_id", "n_shingles", "set_id", "sketch", "low", "high"])
    return run


def _full_sets(shingle: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for begin, end in slices(texts):
                sets = shingle_sets(words_of(texts.slice(begin, end - begin), lower=True), shingle)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(begin, end - begin),
                    pa.array([np.sort(s.view(np.int64)) for s in sets], pa.list_(pa.int64()))],
                    ["node", "shingles"])
    return run


def profiles(docs: DataFrame, shingle: int = SHINGLE, retained: int = RETAINED) -> DataFrame:
    """Size, identity (128 bits), sketch and signature of each row's set."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _profiles(shingle, retained),
        "doc_id long, n_shingles long, set_id binary, sketch array<long>, low long, high long")


def _listed(nodes: DataFrame, run: int, percent: int) -> DataFrame:
    """``pos, key, node, n``: one row for each run of ``run`` neighbouring retained values.

    Runs of small sets that are shorter than ``run`` come behind the others.
    """
    def keys(length):
        places = F.sequence(F.lit(1), F.size("sketch") - length + 1)
        return F.transform(places, lambda i: F.xxhash64(F.lit(length), F.slice("sketch", i, length)))
    longer = F.when(F.size("sketch") >= run, keys(run)).otherwise(F.array().cast("array<long>"))
    for length, largest in _short_runs(percent).items():
        longer = F.when(F.size("sketch").between(length, largest),
                        F.concat(longer, keys(length))).otherwise(longer)
    return nodes.where(F.col("n") >= _least_size(percent)).select(
        F.posexplode(longer).alias("pos", "key"), "node", "n")


def _shared(listed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of lists with several nodes, with the list's length and its smallest node."""
    lists = listed.groupBy("key").agg(
        F.count("*").alias("length"), F.min("node").alias("leader")).where("length > 1")
    side = nodes.select("node", "n", "low", "high")
    return (listed.join(lists, "key").join(side.drop("n"), "node")
            .join(side.toDF("leader", "n_leader", "low_leader", "high_leader"), "leader"))


def _plausible(left: tuple[str, str, str], right: tuple[str, str, str],
               percent: int) -> F.Column:
    """Whether sizes and signatures (n, low, high) let two sets reach the threshold.

    A shingle in one set only changes at most one bit, and that half of the time: at 85 %
    similarity 9.6 bits of 128 differ on average, at 80 % 12.8, and more than ``_most_bits`` with
    a chance below 1e-6 (never in sets of less than 140 shingles).
    """
    (n, low, high), (m, low2, high2) = left, right
    differing = (F.bit_count(F.col(low).bitwiseXOR(F.col(low2)))
                 + F.bit_count(F.col(high).bitwiseXOR(F.col(high2))))
    return (percent * F.greatest(n, m) <= 100 * F.least(n, m)) & (differing <= _most_bits(percent))


def _to_leader(shared: DataFrame, percent: int) -> DataFrame:
    return (shared.where((F.col("node") != F.col("leader")) & _plausible(
        ("n", "low", "high"), ("n_leader", "low_leader", "high_leader"), percent))
        .select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())


def _open_lists(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of lists that hold several components, with their component."""
    rows = shared.select("key", "length", "node", "n", "pos").join(
        labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = rows.groupBy("key").agg(
        F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    return rows.join(mixed.select("key"), "key")


def _common(owner: np.ndarray, values: np.ndarray, m: int,
            left: np.ndarray | None = None) -> np.ndarray:
    """How many values each two of ``m`` owners have in common; those ``left`` with the others."""
    _, value, counts = np.unique(values, return_inverse=True, return_counts=True)
    often = counts > 1
    place = (np.cumsum(often) - 1)[value]
    use = often[value]
    all_ = np.ones(m, bool)
    rows, columns = (all_, all_) if left is None else (left, ~left)
    common = np.zeros((rows.sum(), columns.sum()), np.float32)
    for low in range(0, int(often.sum()), 4096):
        part = use & (place >= low) & (place < low + 4096)
        held = np.zeros((m, min(4096, int(often.sum()) - low)), np.float32)
        held[owner[part], place[part] - low] = 1
        common += held[rows] @ held[columns].T
    return common


def _earlier_runs(padded: np.ndarray, pos: np.ndarray, live: pa.ListArray, length: int,
                  retained: int):
    """Owner and hash of each run of a node that has a list and stands before the node's ``pos``."""
    runs = retained - length + 1
    hashes = np.zeros((len(pos), runs), np.uint64)
    for t in range(length):
        hashes = mix(hashes + padded[:, t:t + runs].astype(np.int64).view(np.uint64))
    owner = np.repeat(np.arange(len(pos)), np.diff(live.offsets.to_numpy()))
    place = live.values.to_numpy()[live.offsets[0].as_py():][:len(owner)]
    before = place < np.minimum(pos[owner], runs)
    return owner[before], hashes[owner[before], place[before]]


def _wide_sketches(table: pa.Table):
    """Sizes of the rows' wide sketches, owner of each value, values, and a matrix of them."""
    m = len(table)
    column = table.column("wide").combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    values = column.values.to_numpy()[column.offsets[0].as_py():][:sizes.sum()]
    owner = np.repeat(np.arange(m), sizes)
    padded = np.full((m, WIDE), 2**31 - 1, np.int32)
    padded[owner, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return sizes, owner, values, padded


def _likely(nodes, n, sizes, padded, i, j, both, percent: int) -> pa.Table:
    """Those of the pairs (i, j) with ``both`` common values that may reach ``percent``."""
    m, least = len(nodes), percent / 100
    spread = MARGIN * np.sqrt(least * (1 - least) / WIDE)
    whole = (sizes[i] == n[i]) & (sizes[j] == n[j])
    share = both / (sizes[i] + sizes[j] - both)
    last = np.where(sizes == n, 2**31 - 1, padded[np.arange(m), np.maximum(sizes, 1) - 1])
    for at in np.array_split(np.flatnonzero(~whole), 1 + (~whole).sum() // 10_000):
        end = np.minimum(last[i[at]], last[j[at]])[:, None]
        known = [np.minimum((padded[k] <= end).sum(axis=1), sizes[k]) for k in (i[at], j[at])]
        share[at] = both[at] / np.maximum(known[0] + known[1] - both[at], 1)
    good = share >= np.where(whole, least - 0.01, least - spread)
    i, j, whole = i[good], j[good], whole[good] & (share[good] >= least + 0.01)
    _, group = np.unique(nodes, return_inverse=True)
    keep = np.ones(len(i), bool)
    for at in np.flatnonzero(whole):  # sets wholly in view: links that join something new
        x, y = group[i[at]], group[j[at]]
        keep[at] = x != y
        if x != y:
            group[group == x] = y
    return pa.table({"a": np.minimum(nodes[i], nodes[j])[keep],
                     "b": np.maximum(nodes[i], nodes[j])[keep]})


def _list_pairs(percent: int, length: int, retained: int):
    """Pairs of a list, in different components, that may reach ``percent``.

    A pair is put out in the first list only that both nodes are in. Lists of shorter runs put
    out all.
    """
    def run(key, table):
        m = len(table)
        nodes, n, component, pos = (
            table.column(c).to_numpy() for c in ("node", "n", "component", "pos"))
        sizes, owner, values, padded = _wide_sketches(table)
        common = _common(owner, values, m)
        short = pos > np.minimum(n, retained) - length
        earlier = np.zeros((m, m)) if short.any() else _common(*_earlier_runs(
            padded, pos, table.column("live").combine_chunks(), length, retained), m)
        i, j = np.nonzero(np.triu(component[:, None] != component[None, :], 1)
                          & (100 * np.minimum(n[:, None], n[None, :])
                             >= percent * np.maximum(n[:, None], n[None, :]))
                          & (common >= 0.5 * np.minimum(sizes[:, None], sizes[None, :]))
                          & (earlier == 0))
        return _likely(nodes, n, sizes, padded, i, j, common[i, j], percent)
    return run


def _across(rows: DataFrame, sets: DataFrame, percent: int, length: int,
            retained: int) -> DataFrame:
    """Pairs of a list's nodes that are in different components and similar by wide sketches.

    A wide sketch has the ``WIDE`` smallest values, for sets up to that size all of them; for
    larger ones pairs stay within ``MARGIN`` standard deviations.
    """
    live = rows.groupBy("node").agg(F.collect_list("pos").alias("live"))
    rows = rows.join(live, "node").join(_wide(sets), "node")
    return rows.groupBy("key").applyInArrow(
        _list_pairs(percent, length, retained), "a long, b long").distinct()


def _wide(sets: DataFrame) -> DataFrame:
    return sets.select("node", F.transform(
        F.slice("shingles", 1, WIDE), lambda v: F.shiftright(v, 32).cast("int")).alias("wide"))


def _prefixes(scale: np.ndarray, percent: int):
    """The first values of each full set in the order of ``scale`` and value.

    Set x and a set y of no fewer values reach ``percent`` only with ``percent / (100 + percent)``
    of both sizes' sum in common. In any one order of all values their first ones then share a
    value: of each all but that many, plus one. For y that is most with the smallest possible
    x, and those values are listed; for x with y of its own size (``early`` in ``_across_rare``).
    """
    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            values = batch.column(2).values.to_numpy()
            start = batch.column(2).offsets.to_numpy()[:-1]
            nodes, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for rows in np.array_split(np.arange(len(batch)), 1 + sizes.sum() // 10**6):
                firsts = []
                for at in rows:
                    held = values[start[at]:start[at] + sizes[at]]
                    order = np.lexsort((held, scale[held & (BUCKETS - 1)]))
                    firsts.append(held[order[:sizes[at] + 1 - -(-percent * sizes[at] // 100)]])
                counts = np.array([len(f) for f in firsts], int)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts),
                             pa.int32()),
                    pa.array(np.concatenate([np.zeros(0, np.int64), *firsts])),
                    pa.array(np.repeat(nodes[rows], counts)), pa.array(np.repeat(n[rows], counts)),
                ], ["pos", "key", "node", "n"])
    return run


def _rare(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pos, key, node, n``: the rarest values of each full set.

    Rarity is counted by hashed values; it only has to be the same for all sets. The driver
    holds ``BUCKETS`` numbers, whatever the input.
    """
    full = sets.join(nodes, "node").select("node", "n", "shingles")
    counts = (full.select(F.explode("shingles").alias("value"))
              .groupBy(F.pmod("value", F.lit(BUCKETS)).alias("bucket")).count().collect())
    scale = np.zeros(BUCKETS, np.uint8)
    for bucket, count in counts:
        scale[bucket] = min(255, int(4 * np.log2(count)))
    return full.mapInArrow(_prefixes(scale, percent), "pos int, key long, node long, n long")


def _rare_pairs(percent: int):
    """Pairs of a smaller set that is listed early and a larger one, in different components."""
    def run(key, table):
        nodes, n, component = (table.column(c).to_numpy() for c in ("node", "n", "component"))
        early = table.column("early").to_numpy()
        sizes, owner, values, padded = _wide_sketches(table)
        left, right = np.flatnonzero(early), np.flatnonzero(~early)
        both = _common(owner, values, len(table), early)
        i, j = np.nonzero((component[left][:, None] != component[right][None, :])
                          & (n[left][:, None] <= n[right][None, :])
                          & (100 * n[left][:, None] >= percent * n[right][None, :])
                          & (both >= 0.5 * np.minimum(sizes[left][:, None], sizes[right][None, :])))
        return _likely(nodes, n, sizes, padded, left[i], right[j], both[i, j], percent)
    return run


def _across_rare(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """As ``_across``, for the lists of ``_rare``: in pairs of blocks of ``SMALL_LIST`` nodes."""
    least = F.ceil(2 * percent * F.col("n") / (100 + percent))
    rows = rows.withColumn("early", F.col("pos") < F.col("n") + 1 - least)
    lists = rows.groupBy("key").agg(
        *[F.ceil(count / SMALL_LIST).cast("int").alias(name) for name, count in (
            ("lefts", F.count_if("early")), ("rights", F.count("*")))],
        F.min(F.when(F.col("early"), F.col("n"))).alias("smallest"),
        F.max(F.when(F.col("early"), F.col("n"))).alias("largest")).where("lefts > 0")
    rows = rows.join(lists, "key")

    def dealt(own, other):
        return (F.pmod(F.xxhash64("node"), own).cast("int"),
                F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    columns = ["key", "node", "n", "component"]
    own, each = dealt(F.col("lefts"), "rights")
    left = rows.where("early").select(*columns, "early", own.alias("i"), each.alias("j"))
    own, each = dealt(F.col("rights"), "lefts")
    right = rows.where((F.col("n") >= F.col("smallest")) & (
        percent * F.col("n") <= 100 * F.col("largest"))).select(
        *columns, F.lit(False).alias("early"), each.alias("i"), own.alias("j"))
    return left.unionByName(right).join(_wide(sets), "node").groupBy("key", "i", "j").applyInArrow(
        _rare_pairs(percent), "a long, b long").distinct()


def _estimated(pairs: DataFrame, nodes: DataFrame, retained: int, percent: int) -> DataFrame:
    """Pairs whose similarity, estimated on the union's sketch, may reach the threshold."""
    side = nodes.select("node", "sketch")
    both = pairs.join(side.toDF("a", "sa"), "a").join(side.toDF("b", "sb"), "b")
    union = F.slice(F.sort_array(F.array_union("sa", "sb")), 1, retained)
    share = F.size(F.array_intersect(union, F.array_intersect("sa", "sb"))) / F.size(union)
    return both.where(share >= _least_estimate(percent, retained)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    both = pairs.join(sets.toDF("a", "fa"), "a").join(sets.toDF("b", "fb"), "b")
    common = F.size(F.array_intersect("fa", "fb"))
    union = F.size("fa") + F.size("fb") - common
    return both.where(100 * common >= percent * union).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE,
                    retained: int = RETAINED) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs`` (doc_id, text).

    Null and empty texts, and texts without words, have no shingles and link with nothing.
    Rows with the same doc_id count as one document. A row without doc_id links with nothing
    and is kept, its component_id is null. Other columns are ignored; an empty table gives an
    empty result. ``percent`` may be 80 or more.
    """
    if percent < LEAST_PERCENT:
        raise ValueError(f"runs of retained values are made for at least {LEAST_PERCENT} percent")
    table = written(profiles(docs, shingle, retained), "near-profiles")
    classes = (table.where("n_shingles > 0 and doc_id is not null")
               .groupBy("set_id").agg(F.min("doc_id").alias("node")))
    nodes = table.join(classes.withColumnRenamed("set_id", "of"),
                       (F.col("set_id") == F.col("of")) & (F.col("doc_id") == F.col("node"))).select(
        "node", F.col("n_shingles").alias("n"), "sketch", "low", "high")
    nodes = written(nodes, "near-nodes")

    shared = written(_shared(_listed(nodes, RUN, percent), nodes), "near-lists")
    wanted = shared.select(F.col("node").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(
        wanted.hint("shuffle_hash"), "doc_id", "left_semi")
    sets = written(texts.mapInArrow(_full_sets(shingle), "node long, shingles array<long>"),
                   "near-sets")

    def decided(pairs):
        return _verified(_estimated(pairs, nodes, retained, percent), sets, percent)

    labels = components(decided(_to_leader(shared, percent)))
    rows = written(_open_lists(shared, labels), "near-open")
    short = rows.where(F.col("length") <= SMALL_LIST)
    labels = relabelled(labels, _verified(_across(short, sets, percent, RUN, retained), sets, percent))
    large = rows.where(F.col("length") > SMALL_LIST).select("node").distinct()
    if not large.isEmpty():
        among = nodes.join(large, "node", "left_semi")
        shared = written(_shared(_rare(among.select("node", "n"), sets, percent), among),
                         "near-lists")
        labels = relabelled(labels, decided(_to_leader(shared, percent)))
        rows = _open_lists(shared, labels)
        labels = relabelled(labels, _verified(_across_rare(rows, sets, percent), sets, percent))

    placed = classes.join(labels, "node", "left").select(
        "set_id", F.coalesce("component", "node").alias("component_id"))
    # Rows without shingles are no group that would meet in one task.
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    out = table.where(linked).join(placed, "set_id").select(
        "doc_id", "n_shingles", "component_id").unionByName(
        table.where(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
