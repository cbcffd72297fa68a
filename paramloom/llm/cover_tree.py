"""Near copies among embeddings: a cover tree per label, walked against itself.

Vectors with equal labels and equal components are one *class* with a weight. Classes hang below a
root per label and number of components; every level halves the separation of the net that
parts a node: the net is chosen from a bounded sample of the node by taking the farthest point
again and again, every class goes to its nearest net point, and the covering radius is the
largest distance found. Nodes of at most ``LEAF`` classes are leaves. Distances are chords
between unit vectors, so the threshold on cosines is one on distances.

The tree is walked against itself level by level, as tables of node pairs. A pair of nodes
whose balls lie too far apart is dropped; one whose balls lie close together as a whole links
all below with all below, in bulk, by weights; the others go on with their children. What is
left are pairs of leaves, whose classes are compared one by one in double precision. So no
link between different vectors is lost and links within dense places are counted, not listed.

Tables of all levels lie in the shared folder; a leaf that can't be parted (all its classes
closer than the last net) is cut into blocks by a hash. High-dimensional vectors without any
structure give wide balls: then few pairs can be dropped and leaves are compared with most others
of their label.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paramloom.llm.components import components
from paramloom.llm.tables import written

LEAF = 2_048
FAN = 32
SAMPLE = 512
LEVELS = 8
#: Groups with at least this share of the rows are broadcast; there are as many at most.
HEAVY_SHARE = 1_000
_MARGIN = 1e-9


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """One row per vector, all of equal length, in double precision."""
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; scaled first, so that squares neither overflow nor vanish."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.array(list(rows), pa.list_(pa.float64()))


def usable(embedding: Column) -> Column:
    """Whether a vector has a direction: all components finite numbers, one not zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x)
                      & (F.abs(x.cast("double")) < F.lit(math.inf)))
    return F.coalesce(finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def classes(rows: DataFrame) -> DataFrame:
    """``cid, label, vec, n, first``: the distinct vectors of each label and their rows."""
    grouped = rows.where("vec is not null").groupBy("label", "vec").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("first"))
    return written(grouped.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")


def _net(separation: float, leaf: int, fan: int):
    """The net of one node, from a sample: the farthest point again and again.

    It ends below ``separation``, or with points enough to bring the node down to leaves.
    """
    def run(table: pa.Table) -> pa.Table:
        vectors = _units(_vectors(table.column("vec")))
        order = np.argsort(table.column("cid").to_numpy())
        vectors = vectors[order]
        count = table.column("count")[0].as_py()
        most = min(fan, 1 + math.ceil(1.5 * count / leaf))
        chosen, gap = [0], _distances(vectors, vectors[:1])[:, 0]
        while len(chosen) < most and gap.max() > separation:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, _distances(vectors, vectors[chosen[-1:]])[:, 0])
        return pa.table({"node": pa.array([table.column("node")[0].as_py()] * len(chosen)),
                         "child": pa.array(range(len(chosen)), pa.int32()),
                         "center": _lists(vectors[chosen])})
    return run


def _assign(points: pa.Table, net: pa.Table) -> pa.Table:
    """Each class of a part of a node at its nearest net point."""
    n = len(points)
    names = ["cid", "n", "vec", "node", "parent", "dist"]
    parent = points.column("node")
    if not n:
        empty = [points.column("cid"), points.column("n"), points.column("vec"), parent, parent,
                 pa.array([], pa.float64())]
        return pa.table(empty, names)
    if len(net):
        net = net.sort_by("child")
        gaps = _distances(_units(_vectors(points.column("vec"))), _vectors(net.column("center")))
        nearest = gaps.argmin(axis=1)
        dist = gaps[np.arange(n), nearest]
    else:  # no class of the node was sampled
        nearest, dist = np.zeros(n, np.int64), np.full(n, 2.0)
    name = parent[0].as_py()
    return pa.table([points.column("cid"), points.column("n"), points.column("vec"),
                     pa.array([f"{name}/{k}" for k in nearest]), parent, pa.array(dist)], names)


def _share(column: str, level: int) -> Column:
    """A number from 0 to 1 for each class, another one for each level."""
    return F.pmod(F.xxhash64(F.lit(level), column), F.lit(1 << 52)) / F.lit(float(1 << 52))


def tree(found: DataFrame, leaf: int = LEAF, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Leaves' classes ``cid, n, vec, node`` and nodes ``node, parent, center, radius, last``.

    A node's name is its path; ``last`` says that it is a leaf. Roots have no centre and the
    radius 2, which holds for any unit vector.
    """
    kind = found.schema["vec"].dataType.simpleString()
    point = f"cid long, n long, vec {kind}, node string, parent string, dist double"
    points = written(found.select("cid", "n", "vec", F.concat_ws(
        ":", F.col("label").cast("string"), F.size("vec").cast("string")).alias("node")), "points")
    nodes = points.select("node").distinct().select(
        "node", F.lit(None).cast("string").alias("parent"),
        F.lit(None).cast("array<double>").alias("center"), F.lit(2.0).alias("radius"))
    finished = points.limit(0)
    for level in range(LEVELS):
        sizes = points.groupBy("node").agg(F.count("*").alias("count")).where(f"count > {leaf}")
        large = written(sizes, "large-nodes")
        if large.isEmpty():
            break
        finished = finished.unionByName(points.join(large, "node", "left_anti"))
        inside = points.join(large, "node")
        sample = inside.where(_share("cid", level) * F.col("count") < float(SAMPLE))
        net = written(sample.groupBy("node").applyInArrow(
            _net(2.0 ** -level, leaf, fan), "node string, child int, center array<double>"), "net")
        parts = F.ceil(F.col("count") / F.lit(2.0 * leaf)).cast("long")
        left = inside.withColumn("part", F.pmod(F.xxhash64("cid"), parts)).drop("count")
        right = net.join(large, "node").withColumn(
            "part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("count")
        placed = written(left.groupBy("node", "part").cogroup(right.groupBy("node", "part"))
                         .applyInArrow(_assign, point), "placed")
        radii = placed.groupBy("node", "parent").agg(F.max("dist").alias("radius"))
        centres = net.select(F.concat_ws("/", "node", F.col("child").cast("string")).alias("node"),
                             "center")
        nodes = nodes.unionByName(radii.join(centres, "node", "left").select(
            "node", "parent", "center", "radius"))
        points = placed.select("cid", "n", "vec", "node")
    leaves = written(finished.unionByName(points), "leaf-points")
    kept = leaves.select("node").distinct().withColumn("last", F.lit(True))
    nodes = nodes.join(kept, "node", "left").withColumn("last", F.coalesce("last", F.lit(False)))
    return leaves, written(nodes, "tree-nodes")


def _judge(limit: float):
    """What the covering radii say of node pairs: apart, together, or open."""
    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            radius = (table.column("ra").to_numpy() + table.column("rb").to_numpy())
            known = (table.column("ca").is_valid().to_numpy()
                     & table.column("cb").is_valid().to_numpy())
            same = np.array([a == b for a, b in zip(table.column("a").to_pylist(),
                                                    table.column("b").to_pylist())], bool)
            gap = np.zeros(len(table))
            for i in np.flatnonzero(known & ~same):
                a, b = (np.asarray(table.column(c)[int(i)].as_py()) for c in ("ca", "cb"))
                gap[i] = math.sqrt(float(((a - b) ** 2).sum()))
            low, high = gap - radius, gap + radius
            verdict = np.where((known | same) & (high <= limit - _MARGIN), 1,
                               np.where(known & ~same & (low > limit + _MARGIN), -1, 0))
            keep = verdict >= 0
            yield pa.RecordBatch.from_arrays(
                [c.combine_chunks().filter(pa.array(keep)) for c in
                 (table.column("a"), table.column("b"), table.column("la"), table.column("lb"))]
                + [pa.array(verdict[keep] == 1)], ["a", "b", "la", "lb", "together"])
    return run


def walk(nodes: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """``a, b`` of node pairs linked as a whole, and of leaf pairs that are left open.

    ``a`` is ``b`` for the pairs within a node; other pairs occur once.
    """
    kids = nodes.where("parent is not null").unionByName(
        nodes.where("last").withColumn("parent", F.col("node")))
    ka = kids.select(F.col("parent").alias("pa"), F.col("node").alias("a"),
                     F.col("center").alias("ca"), F.col("radius").alias("ra"),
                     F.col("last").alias("la"))
    kb = ka.toDF("pb", "b", "cb", "rb", "lb")
    roots = nodes.where("parent is null")
    front = roots.select(F.col("node").alias("a"), F.col("node").alias("b"),
                         F.col("last").alias("la"), F.col("last").alias("lb"),
                         F.lit(False).alias("together"))
    done = None
    while True:
        front = written(front, "node-pairs")
        settled = front.where("together or (la and lb)").select("a", "b", "together")
        done = settled if done is None else done.unionByName(settled)
        going = front.where("not together and not (la and lb)").select(
            F.col("a").alias("pa"), F.col("b").alias("pb"))
        if going.isEmpty():
            break
        pairs = going.join(ka, "pa").join(kb, "pb").where("pa <> pb or a <= b")
        front = pairs.select("a", "b", "ca", "cb", "ra", "rb", "la", "lb").mapInArrow(
            _judge(limit), "a string, b string, la boolean, lb boolean, together boolean")
    return (done.where("together").select("a", "b"), done.where("not together").select("a", "b"))


def _bulk(leaves: DataFrame, together: DataFrame) -> DataFrame:
    """``cid, links, leader`` from node pairs linked as a whole: sums of weights."""
    steps = F.split("leaf", "/")
    above = leaves.groupBy(F.col("node").alias("leaf")).agg(
        F.sum("n").alias("weight"), F.min("cid").alias("lead")).withColumn(
        "node", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)),
                                      lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))))
    above = written(above, "ancestors")
    sums = above.groupBy("node").agg(F.sum("weight").alias("weight"), F.min("lead").alias("lead"))
    both = together.union(together.where("a <> b").select("b", "a"))
    other = sums.select(F.col("node").alias("b"), F.col("weight").alias("more"),
                        F.col("lead").alias("lead_b"))
    own = sums.select(F.col("node").alias("a"), F.col("lead").alias("lead_a"))
    gained = both.join(other, "b").join(own, "a").groupBy("a").agg(
        F.sum("more").alias("more"), F.max(F.col("a") == F.col("b")).alias("within"),
        F.min(F.least("lead_a", "lead_b")).alias("lead"))
    by_leaf = above.select("leaf", F.col("node").alias("a")).join(gained, "a").select(
        "leaf", "more", "within", "lead")
    links = leaves.select("cid", "n", F.col("node").alias("leaf")).join(by_leaf, "leaf").select(
        "cid", (F.col("more") - F.when(F.col("within"), F.col("n")).otherwise(0)).alias("links"),
        F.col("lead").alias("leader"))
    # A node's partners are joined with it through the node's own lead.
    leads = both.join(other, "b").join(own, "a").select(
        F.col("lead_b").alias("cid"), F.lit(0).cast("long").alias("links"),
        F.col("lead_a").alias("leader"))
    return links.unionByName(leads)


def _compare(least: float):
    """Classes of two blocks one by one: links by weight, and who is linked with whom."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["cid", "links", "leader"]
        if not len(left) or (not len(right) and not left.column("same")[0].as_py()):
            return pa.table([pa.array([], pa.int64())] * 3, names)
        same = left.column("same")[0].as_py()
        right = left if same else right
        ids = [t.column("cid").to_numpy() for t in (left, right)]
        weights = [t.column("n").to_numpy().astype(float) for t in (left, right)]
        a, b = (_vectors(t.column("vec")) for t in (left, right))
        a, b = _units(a), _units(b)
        linked = (a @ b.T) >= least
        if same:
            np.fill_diagonal(linked, False)
        rows, columns = linked.any(axis=1), linked.any(axis=0)
        linked = linked[rows][:, columns]
        ids = [ids[0][rows], ids[1][columns]]
        weights = [weights[0][rows], weights[1][columns]]
        counts = [linked @ weights[1], weights[0] @ linked]
        far = np.iinfo(np.int64).max
        leaders = [ids[0].copy(), ids[1].copy()]
        while True:  # the smallest label spreads over the links within the two blocks
            first = np.minimum(leaders[0], np.where(linked, leaders[1], far).min(axis=1, initial=far))
            second = np.minimum(leaders[1], np.where(linked.T, first, far).min(axis=1, initial=far))
            if (first == leaders[0]).all() and (second == leaders[1]).all():
                break
            leaders = [first, second]
        sides = slice(0, 1 if same else 2)
        return pa.table([pa.array(np.concatenate(ids[sides]), pa.int64()),
                         pa.array(np.rint(np.concatenate(counts[sides])).astype(np.int64)),
                         pa.array(np.concatenate(leaders[sides]), pa.int64())], names)
    return run


def _by_blocks(leaves: DataFrame, pairs: DataFrame, least: float, leaf: int) -> DataFrame:
    """``cid, links, leader`` from pairs of leaves; large leaves are cut into blocks."""
    sizes = leaves.groupBy("node").agg(
        F.ceil(F.count("*") / F.lit(float(leaf))).cast("long").alias("blocks"))
    points = leaves.join(sizes, "node").select(
        "cid", "n", "vec", "node", F.pmod(F.xxhash64("cid"), "blocks").alias("block"))
    sa = sizes.select(F.col("node").alias("a"), F.col("blocks").alias("na"))
    sb = sizes.select(F.col("node").alias("b"), F.col("blocks").alias("nb"))
    zero = F.lit(0).cast("long")
    tasks = (pairs.join(sa, "a").join(sb, "b")
             .withColumn("i", F.explode(F.sequence(zero, F.col("na") - 1)))
             .withColumn("j", F.explode(F.sequence(zero, F.col("nb") - 1)))
             .where("a <> b or i <= j").drop("na", "nb"))
    tasks = written(tasks.withColumn("pair", F.monotonically_increasing_id()).withColumn(
        "same", (F.col("a") == F.col("b")) & (F.col("i") == F.col("j"))), "leaf-pairs")
    left = points.join(tasks.select("pair", "same", F.col("a").alias("node"),
                                    F.col("i").alias("block")), ["node", "block"])
    right = points.join(tasks.where("not same").select(
        "pair", F.col("b").alias("node"), F.col("j").alias("block")), ["node", "block"])
    # New names for the columns that both sides have from the same table.
    right = right.select(*[F.col(c).alias(c) for c in ("pair", "cid", "n", "vec")])
    return (left.select("pair", "same", "cid", "n", "vec").groupBy("pair")
            .cogroup(right.groupBy("pair"))
            .applyInArrow(_compare(least), "cid long, links long, leader long"))


def _onto_rows(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with what ``groups`` says of their label and vec; large groups are broadcast."""
    total = groups.agg(F.sum("n")).scalar()
    groups = groups.withColumn("__heavy", F.col("n") * HEAVY_SHARE >= total)
    heavy = groups.where("__heavy").drop("n")
    marked = rows.join(F.broadcast(heavy), ["label", "vec"], "left")
    rest = marked.where("__heavy is null").select("vec_id", "label", "vec").join(
        groups.where("not __heavy").drop("n"), ["label", "vec"], "left")
    return marked.where("__heavy is not null").unionByName(rest)


def near_vectors(embeddings: DataFrame, least: float = 0.98, leaf: int = LEAF,
                 fan: int = FAN) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``embeddings``.

    Rows with equal labels whose vectors have a cosine of at least ``least`` (over 0) are linked,
    equal vectors among them. ``n_links`` counts the other rows linked with a row directly,
    ``component_id`` is the smallest vec_id that links lead to. A null label, a null or zero
    vector, one with null or non-finite components, and vectors of different lengths link with
    nothing. Repeated rows are rows of their own, linked with each other. A null vec_id counts
    as larger than any other; a component of nulls alone has a null id and stays. Other columns
    are ignored; an empty table gives no rows.
    """
    good = F.col("label").isNotNull() & usable(F.col("embedding"))
    # Adding zero makes the two zeros one.
    vec = F.transform("embedding", lambda x: x + F.lit(0).cast("float"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label",
                             F.when(good, vec).alias("vec"))
    found = classes(rows)
    leaves, nodes = tree(found.select("cid", "label", "vec", "n"), leaf, fan)
    together, left_open = walk(nodes, math.sqrt(2 - 2 * least))
    links = written(_bulk(leaves, together).unionByName(
        _by_blocks(leaves, left_open, least, leaf)), "vector-links")
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = components(links.select(F.col("cid").alias("a"), F.col("leader").alias("b")))
    groups = found.join(counts, "cid", "left").join(
        joined.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn(
        "component", F.coalesce("component", "cid"))
    smallest = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    groups = written(groups.join(smallest, "component").select(
        "label", "vec", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        "component_id"), "vector-groups")
    out = _onto_rows(rows.where("vec is not null"), groups).select(
        "vec_id", "n_links", "component_id")
    alone = rows.where("vec is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


#: Cosines of all pairs within a label; links are followed to the smallest id.
SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), counted AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links,
       least(e.vec_id, coalesce(m.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(m.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counted c ON c.a = e.vec_id LEFT JOIN least m ON m.a = e.vec_id
"""
