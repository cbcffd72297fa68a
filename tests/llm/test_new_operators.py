"""Cover tree, conversation repair and prefix trie against plain Python."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paramloom.llm import cover_tree, prefix_trie, repair

VECTORS = "vec_id long, embedding array<float>, label int, component_id string, n long, cid long"
CHATS = "conv_id long, turn long, role string, text string, pos long, kind string"


# embeddings

def brute_vectors(rows, least=0.98):
    """{vec_id: (n_links, component_id, kept)} of (vec_id, embedding, label) rows."""
    def usable(v):
        return (v is not None and all(x is not None and math.isfinite(x) for x in v)
                and any(x != 0 for x in v))
    def cosine(a, b):
        a, b = np.float32(a).astype(float), np.float32(b).astype(float)
        return float(a @ b / (math.sqrt(a @ a) * math.sqrt(b @ b)))
    links = {i: set() for i, _, _ in rows}
    for (i, v, a), (j, w, b) in itertools.combinations(rows, 2):
        if (a is not None and a == b and usable(v) and usable(w) and len(v) == len(w)
                and cosine(v, w) >= least):
            links[i].add(j)
            links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def some_vectors():
    rng, rows = np.random.default_rng(3), []
    def add(v, label):
        rows.append((len(rows) * 7 % 1009, [float(np.float32(x)) for x in v], label))
    for label in range(3):
        for _ in range(60):
            add(rng.normal(size=8), label)
        for spread in (0.001, 0.05, 0.1, 0.2):  # tight and loose families
            centre = rng.normal(size=8)
            centre /= np.linalg.norm(centre)
            for _ in range(30):
                add((centre + spread * rng.normal(size=8)) * rng.uniform(0.5, 3), label)
        for _ in range(40):  # copies, and the same direction at other lengths
            add(np.arange(1, 9), label)
        add(2 * np.arange(1, 9), label)
    rows += [(2001, None, 1), (2002, [0.0] * 8, 1), (2003, [1.0, None] + [0.0] * 6, 1),
             (2004, [math.nan] * 8, 1), (2005, [math.inf] + [1.0] * 7, 1), (2006, [1.0] * 8, None),
             (2007, [1.0] * 8, None), (2008, [1.0, 2.0], 1), (2009, [1.0, 2.0], 1), (2010, [], 1),
             (2011, [-0.0, 1.0], 5), (2012, [0.0, 1.0], 5), (2013, [1e-30] * 8, 7),
             (2014, [3e38] * 8, 7)]
    return rows


@pytest.mark.parametrize("leaf, fan", [(2_048, 32), (8, 3), (40, 4)])
def test_vectors_equal_brute_force(spark, leaf, fan):
    rows = some_vectors()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS).repartition(5)
    got = {r["vec_id"]: tuple(r)[1:] for r in cover_tree.near_vectors(df, 0.98, leaf, fan).collect()}
    assert got == brute_vectors(rows)


def test_dense_places_are_linked_in_bulk(spark):
    """A tight family is settled by covering radii: no class of it is compared one by one."""
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 1.0] + [float(x) for x in 0.001 * rng.normal(size=6)], 0) for i in range(400)]
    rows += [(1000 + i, [float(x) for x in rng.normal(size=8)], 0) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = cover_tree.classes(df.select("vec_id", "label", F.col("embedding").alias("vec")))
    leaves, nodes = cover_tree.tree(found, 50, 4)
    together, left_open = cover_tree.walk(nodes, math.sqrt(0.04))
    within = {r["a"] for r in together.where("a = b").collect()}
    assert within
    assert not within & {r["a"] for r in left_open.where("a = b").collect()}
    radius = {r["node"]: r["radius"] for r in nodes.collect()}
    depth = {len(n.split("/")) for n in radius}
    assert len(depth) > 2
    got = {r["vec_id"]: r["n_links"] for r in cover_tree.near_vectors(df, 0.98, 50, 4).collect()}
    assert all(got[i] == 399 for i in range(400))


def test_vectors_of_odd_rows(spark):
    rows = [(None, [1.0, 0.0], 1, "x", 1, 2), (None, [1.0, 0.0], 1, "x", 1, 2),
            (5, [1.0, 0.0], 1, "x", 1, 2), (5, [1.0, 0.0], 1, "x", 1, 2), (None, None, None, "x", 1, 2)]
    df = spark.createDataFrame(rows, VECTORS)
    got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"])
           for r in cover_tree.near_vectors(df).collect()]
    assert sorted(got, key=repr) == sorted([
        (5, 3, 5, True), (5, 3, 5, True), (None, 3, 5, False), (None, 3, 5, False),
        (None, 0, None, True)], key=repr)
    assert cover_tree.near_vectors(df.limit(0)).count() == 0


def test_no_cross_join_and_copies_stay_together(spark):
    """A third of all rows is one vector; it is one class with a weight."""
    df = spark.range(3000).select(
        F.col("id").alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0)))
        .otherwise(F.array(F.cos(F.col("id").cast("double")), F.sin(F.col("id").cast("double"))))
        .alias("embedding"), F.lit(1).alias("label"))
    found = cover_tree.classes(df.select("vec_id", "label", F.col("embedding").alias("vec")))
    assert found.count() == 2001
    result = cover_tree.near_vectors(df, 0.999_999, 100, 8)
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan
    rows = {r["vec_id"]: r for r in result.collect()}
    assert rows[3]["n_links"] >= 999 and rows[3]["component_id"] == 0


# repair

ROLES = {"s": "system", "u": "user", "a": "assistant", "t": "tool", " ": " "}


def spaced(text):
    return text.strip(" \t\n\x0b\f\r")


def brute_repair(rows):
    """The result's columns after conv_id, of (turn, role, text) rows in order."""
    seen, faults, counts = set(), [], [0, 0, 0, 0]
    for _, role, text in rows:
        fault = (1 if not spaced(text) else 2 if (role, text) in seen
                 else 3 if spaced(text)[-1] not in ".!?" else 0)
        seen.add((role, text))
        faults.append(fault)
        counts[fault] += 1
    paths = {"": (0, "", ())}  # by the roles' state: whole histories, nothing settled

    def better(out, state, new):
        if state not in out or new[:2] < out[state][:2]:
            out[state] = new
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def inserted(found):
        for _ in range(3):
            for state, (cost, edits, lines) in list(found.items()):
                for initial, role in (("u", "user"), ("a", "assistant")):
                    if (state, initial) in step:
                        better(found, step[state, initial],
                               (cost + 5, edits + "I", (*lines, role + ":")))
        return found
    paths = inserted(paths)
    for (_, role, text), fault in zip(rows, faults):
        out = {}
        for state, (cost, edits, lines) in paths.items():
            better(out, state, (cost + 2, edits + "D", lines))
            if fault in (0, 3):
                price = cost + (5 if fault == 3 else 0)
                if (state, role[:1]) in step:
                    better(out, step[state, role[:1]], (price, edits + "K", (*lines, f"{role}:{text}")))
                for initial, name in (("u", "user"), ("a", "assistant")):
                    if (state, initial) in step:
                        better(out, step[state, initial],
                               (price + 1, edits + "R", (*lines, f"{name}:{text}")))
        paths = inserted(out)
    cost, edits, lines = min((paths[s] for s in ("", "a") if s in paths), key=lambda p: p[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *counts[1:], illegal, cost, edits,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def cheapest_of_all(rows):
    """Cost and edits by trying everything, for up to five rows without faults."""
    best = None
    for kinds in itertools.product("KDRI", repeat=len(rows) + 2):
        edits, at, cost, initials, fine = [], 0, 0, "", True
        for k in kinds:
            if k != "I" and at == len(rows):
                break
            edits.append(k)
            if k == "I" or k == "R":
                initials += "a" if initials.endswith("u") else "u"
            elif k == "K":
                initials += rows[at][1][:1]
            cost += {"K": 0, "D": 2, "R": 1, "I": 5}[k]
            at += k != "I"
            body = initials.removeprefix("s")
            fine &= "ua" * (len(body) // 2) + "u" * (len(body) % 2) == body
        if fine and at == len(rows) and (not initials or initials.endswith("a")):
            best = min(best or (99, ""), (cost, "".join(edits)))
    return best


def some_chats(rng, n):
    rows = []
    for _ in range(n):
        roles = rng.choice(["uuuuuu", "suauaua", "ssuuaa", "aaaa", "uauaua", "tua", " ua", "suatas"])
        rows.append([(rng.choice([None, *range(6)]), ROLES[rng.choice(roles)],
                      rng.choice(["Yes.", "No!", "Why?  ", "cut off", "", " \n", "One. Two", "x y."]))
                     for _ in range(rng.randrange(12))])
    return rows


def test_search_equals_whole_histories():
    rng = random.Random(1)
    for rows in some_chats(rng, 1500):
        conversation = repair._Conversation(1)
        seen = set()
        for turn, role, text in rows:
            fault = (1 if not spaced(text) else 2 if (role, text) in seen
                     else 3 if spaced(text)[-1] not in ".!?" else 0)
            seen.add((role, text))
            conversation.row(turn, role, text, fault)
        got, want = conversation.result()[2:], brute_repair(rows)[1:]
        assert got == want


def test_search_equals_trying_everything():
    for n in range(5):
        for roles in itertools.product("suat", repeat=n):
            rows = [(i, ROLES[r], f"{i}.") for i, r in enumerate(roles)]
            search = repair.Repair(lambda *_: None)
            edits = []
            search.emit = lambda edit, line: edits.append(edit)
            for _, role, text in rows:
                search.row(role, text, 0)
            assert (search.finish(), "".join(edits)) == cheapest_of_all(rows)


def test_settled_edits_are_forgotten():
    """A long right conversation holds a few nodes at any time."""
    edits = []
    search = repair.Repair(lambda edit, line: edits.append(edit))
    for i in range(20_000):
        search.row("user" if i % 2 == 0 else "assistant", "Yes.", 0)
        held, todo = 0, [search.root]
        if i % 1000 == 0:
            while todo:
                held += 1
                todo += todo.pop().after
            assert held < 30
    assert len(edits) > 19_900
    assert search.finish() == 0 and edits == ["K"] * 20_000


def damaged(rows):
    """{conv_id: rows after damage in order} of (conv_id, turn, role, text)."""
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind, kept = zlib.crc32(key.encode()) % 20, out.setdefault(conv, [])
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (kind != 0) * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {conv: sorted(kept, key=order) for conv, kept in out.items()}


def chat_rows():
    rng, rows = random.Random(2), []
    for conv in range(120):
        for turn in range(rng.randrange(1, 14)):
            role = "system" if turn == 0 and conv % 3 == 0 else ("user", "assistant")[(turn + conv) % 2]
            rows.append((conv * 50, turn if rng.random() < 0.95 else None, role,
                         rng.choice(["Yes.", "No!", f"é {turn}.", "Same words.", "cut", " ", ""])))
    rows += [(7, 1, None, "x."), (7, 2, "user", None), (7, None, None, None), (None, 1, "user", "a."),
             (None, 2, "assistant", "b."), (9, 0, "user", "w" * 300_000 + "."), (11, 3, "user", "r."),
             (11, 3, "user", "r."), (-5, 4, "assistant", "minus."), (10**12, 0, "user", "far.")]
    return rows


def test_repairs_equal_brute_force(spark):
    rows = chat_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CHATS).repartition(4)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair_damaged(df).collect()}
    assert got == {conv: brute_repair(kept) for conv, kept in damaged(rows).items()}
    assert repair.repair_damaged(df.limit(0)).count() == 0


# trie

def brute_trie(rows):
    """{(conv_id, depth): the other columns} of (conv_id, turn, role, text)."""
    chats = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            chats.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    chats = {c: [r[2:] for r in sorted(t, key=lambda r: (*r[:2], r[2].encode(), r[3].encode()))]
             for c, t in chats.items()}
    made = {}
    for c, own in chats.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(chats.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:])
    members = {}
    for c, path in made.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        todo = [p]
        while todo:
            p = todo.pop()
            yield p
            todo += kids.get(p, [])
    out = {}
    for p, convs in members.items():
        sub = list(below(p))
        ends = ",".join(str(c) for c in sorted(convs) if len(made[c]) == len(p))
        out[min(convs), len(p)] = (
            min(members[p[:-1]]) if p else None, len(convs), len(kids.get(p, [])),
            sum(q not in kids for q in sub),
            sum((len(members[q]) - 1) * len(q[-1][1]) for q in sub if q),
            hashlib.sha256(ends.encode()).hexdigest())
    return out


def trie_rows():
    rng, rows = random.Random(4), []
    for conv in [*range(0, 130), -7, -150, 10**12 + 3, 205, 999]:
        for turn in range(rng.choice([1, 1, 2, 3, 5, 9, 17, 30])):
            rows.append((conv, turn, rng.choice(["user", "assistant"]), rng.choice(["é", "bb", "ccc"])))
    rows += [(3, None, None, None), (4, 0, "user", None), (None, 0, "user", "x"), (6, 1, "user", "x"),
             (6, 1, "user", "x"), (400, 0, "user", "y" * 200_000), (401, 0, "user", "z")]
    return rows


def test_trie_equals_brute_force(spark):
    rows = trie_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CHATS).repartition(4)
    got = {(r["conv_id"], r["depth"]): tuple(r)[2:]
           for r in prefix_trie.conversation_trie(df).collect()}
    assert got == brute_trie(rows)
    assert prefix_trie.conversation_trie(df.limit(0)).count() == 0


def test_subtree_sums_of_a_high_trie(spark):
    """Conversation i shares i turns with the one before: stretches hang in a long chain."""
    rows = [(c, p, f"u{min(p, c) if p <= c else c}-{p}:1") for c in range(24) for p in range(1, 26)]
    df = spark.createDataFrame(rows, "conv_id long, pos long, turn_id string")
    got = {(r["conv_id"], r["depth"]): r for r in prefix_trie.trie(df).collect()}
    paths = {c: tuple(t for d, _, t in rows if d == c) for c in range(24)}
    nodes = {p[:d] for p in paths.values() for d in range(26)}
    assert len(got) == len(nodes)
    leaves = sum(len(set(p[:25] for p in paths.values())) > 0 for _ in [0]) and len(set(paths.values()))
    assert got[0, 0]["n_leaves"] == leaves
    assert got[0, 0]["saved_tokens"] == 24 * 25 - (len(nodes) - 1)


def test_nodes_run_no_window_over_hot_prefixes(spark):
    """A third of all conversations are equal: counts combine, ids are hashed as they stream."""
    rows = spark.range(3000).select(
        F.col("id").alias("conv_id"), F.lit(1).cast("long").alias("pos"),
        F.concat(F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")),
                 F.lit(":2")).alias("turn_id"))
    got = {(r["conv_id"], r["depth"]): r for r in prefix_trie.trie(rows).collect()}
    assert len(got) == 2002
    assert got[0, 1]["n_convs"] == 1000 and got[0, 0]["n_children"] == 2001
    ids = ",".join(map(str, range(0, 3000, 3)))
    assert got[0, 1]["ends_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
    assert got[0, 0]["saved_tokens"] == 1998
