"""Repair of conversation structure: the cheapest edits that make the roles alternate.

A conversation is right if its roles' initials read ``(s?(ua)+)?``. Rows may be kept, given the
role user or assistant, or deleted, and empty user or assistant rows may be inserted, each at a
cost. A Viterbi search runs over four states (nothing yet, after s, after u, after a) while the
rows of a conversation stream by in order. Its survivors are the leaves of a tree of back
pointers; a node counts the nodes and survivors that refer to it and goes when none does. As soon
as all survivors share an ancestor, the edits up to it are settled: they are emitted, hashed and
forgotten, so that memory follows the unsettled suffix and not the conversation.

Of equally cheap edits the ones whose initials (K, R, D, I) are ASCII-least win. Survivors are
ranked by their whole unsettled histories; ranks are kept up row by row, since two histories that
read equally many rows and end in one are parted for good by their first difference.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paramloom.llm.prefix_trie import CRC32_SQL
from paramloom.llm.tables import written

#: Fixed costs of the edits.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACES = " \t\n\x0b\f\r"
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_AFTER = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER,
          (_ASSISTANT, "u"): _USER, (_USER, "a"): _ASSISTANT}
_NEXT = {state: ("a", "assistant") if state == _USER else ("u", "user") for state in range(4)}
_FINE, _BLANK, _DUPLICATE, _TRUNCATED = range(4)
_LEGAL = {"su", "ua", "au"}
SCHEMA = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
          "cost long, audit string, repaired_sha256 string")


class _Node:
    """An edit, the one before it, and how many later edits and survivors refer to it."""

    __slots__ = ("before", "after", "edit", "line")

    def __init__(self, before, edit, line):
        self.before, self.after, self.edit, self.line = before, set(), edit, line
        if before is not None:
            before.after.add(self)


class Repair:
    """The search over one conversation, fed row by row."""

    def __init__(self, emit):
        """``emit(edit, line)`` gets settled edits in order; deleted rows have no line."""
        self.emit = emit
        self.root = _Node(None, "", None)
        # State: cost, rank of the history up to the last row, inserts since then, node.
        self.survivors = self._with_inserts({_START: (0, 0, "", self.root)})

    @staticmethod
    def _with_inserts(found: dict) -> dict:
        """Survivors after further inserts; as every insert costs, two can reach any state."""
        out = dict(found)
        for _ in range(2):
            for state, (cost, rank, tail, node) in list(out.items()):
                initial, role = _NEXT[state]
                to = _AFTER[state, initial]
                new = (cost + INSERT, rank, tail + "I")
                if to not in out or new < out[to][:3]:
                    out[to] = (*new, (node, "I", role + ":"))
        return out

    def row(self, role: str, text: str, fault: int) -> None:
        best: dict = {}
        for state, (cost, rank, tail, node) in self.survivors.items():
            steps = [(state, cost + DELETE, "D", None)]
            if fault not in (_BLANK, _DUPLICATE):
                cost += TRUNCATED if fault == _TRUNCATED else 0
                kept = _AFTER.get((state, role[:1]))
                if kept is not None:
                    steps.append((kept, cost, "K", f"{role}:{text}"))
                initial, name = _NEXT[state]
                steps.append((_AFTER[state, initial], cost + RENAME, "R", f"{name}:{text}"))
            for to, price, edit, line in steps:
                new = (price, rank, tail + edit)
                if to not in best or new < best[to][:3]:
                    best[to] = (*new, (node, edit, line))
        order = {key: i for i, key in enumerate(sorted({b[1:3] for b in best.values()}))}
        self._grow(self._in_play(self._with_inserts({
            to: (cost, order[rank, tail], "", link)
            for to, (cost, rank, tail, link) in best.items()})))
        self._settle()

    @staticmethod
    def _in_play(found: dict) -> dict:
        """Without survivors that the one after an ``a`` beats whatever rows follow.

        After ``s`` the same edits may follow as after ``a``. With nothing yet, an ``s`` may be
        kept besides, which is deleted after an ``a``.
        """
        ahead = found.get(_ASSISTANT)
        if ahead is not None:
            if _SYSTEM in found and found[_SYSTEM][:3] > ahead[:3]:
                del found[_SYSTEM]
            if _START in found and found[_START][0] > ahead[0] + DELETE:
                del found[_START]
        return found

    def _grow(self, found: dict) -> None:
        """Turns links of the chosen survivors into nodes and lets go of the others."""
        made: dict[int, _Node] = {}

        def node_of(link):
            if isinstance(link, _Node):
                return link
            if id(link) not in made:
                made[id(link)] = _Node(node_of(link[0]), link[1], link[2])
            return made[id(link)]
        old = [s[3] for s in self.survivors.values()]
        old = [node_of(link) for link in old if isinstance(link, _Node)]
        self.survivors = {to: (c, r, t, node_of(link)) for to, (c, r, t, link) in found.items()}
        held = {s[3] for s in self.survivors.values()}
        for node in old:
            while not node.after and node not in held and node.before is not None:
                node.before.after.discard(node)
                node = node.before

    def _settle(self) -> None:
        held = {s[3] for s in self.survivors.values()}
        while len(self.root.after) == 1 and self.root not in held:
            self._advance(next(iter(self.root.after)))

    def _advance(self, node: _Node) -> None:
        node.before = None
        self.root = node
        self.emit(node.edit, node.line)

    def finish(self) -> int:
        """Emits the rest; gives the cost."""
        ends = [s for state, s in self.survivors.items() if state in (_START, _ASSISTANT)]
        cost, _, _, node = min(ends, key=lambda s: s[:3])
        path = []
        while node is not self.root:
            path.append(node)
            node = node.before
        for node in reversed(path):
            self.emit(node.edit, node.line)
        return cost


class _Conversation:
    """All columns of one conversation's result, from its rows in order."""

    def __init__(self, conv_id):
        self.conv_id, self.edits, self.digest = conv_id, [], hashlib.sha256()
        self.lines, self.faults, self.illegal = 0, [0, 0, 0, 0], 0
        self.first = self.last = self.initial = None
        self.distinct = 0
        self.repair = Repair(self.emit)

    def emit(self, edit, line):
        self.edits.append(edit)
        if line is not None:
            self.digest.update((("\n" if self.lines else "") + line).encode())
            self.lines += 1

    def row(self, turn, role, text, fault):
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.distinct = turn, self.distinct + 1
        if self.initial is not None and self.initial + role[:1] not in _LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        self.faults[fault] += 1
        self.repair.row(role, text, fault)

    def result(self) -> tuple:
        cost = self.repair.finish()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        gaps = (gaps + 2**63) % 2**64 - 2**63
        return (self.conv_id, gaps, *self.faults[1:], self.illegal, cost, "".join(self.edits),
                self.digest.hexdigest())


def _stream(batches):
    """Results of conversations from sorted rows; one conversation is open at a time."""
    types = [pa.int64()] * 7 + [pa.string()] * 2
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    now = None
    for batch in batches:
        done = []
        for conv_id, fault, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if fault < 0:  # the row that opens a conversation
                if now is not None:
                    done.append(now.result())
                now = _Conversation(conv_id)
            else:
                now.row(turn, role, text, fault)
        if done:
            yield batch_of(done)
    if now is not None:
        yield batch_of([now.result()])


def damaged(chats: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copy``: rows after known damage, for tests of the repair.

    By ``crc32(conv_id:turn) % 20``: 0 drops a row, 1 empties its text, 2 takes its ``[.!?]``
    away, 3 repeats it, 4 makes it the user's. Null roles and texts, and null numbers in the
    text that is hashed, are one space.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    text = F.coalesce("text", space)
    rows = chats.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", space).alias("role"), text.alias("text"),
        (F.crc32(key) % 20).alias("kind"))
    kind = F.col("kind")
    return rows.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        .alias("copy"))


def _same(a: str, b: str, *columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def with_faults(rows: DataFrame) -> DataFrame:
    """``conv_id, fault, turn, role, text``: each row with its first fault (0 to 3).

    Fine rows, blank ones, copies of an earlier row of their conversation (role and text), and
    truncated ones. Rows that are equal in all columns are counted before the shuffle.
    """
    solid = F.rtrim(F.col("text"), F.lit(SPACES))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).select(
        "*", (solid == "").alias("blank"),
        (~F.right(solid, F.lit(1)).isin(".", "!", "?")).alias("open"),
        F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("same"))
    rows = written(rows, "chat-rows")
    # A struct makes a null turn the smallest.
    first = rows.where("not blank").groupBy("conv_id", "same").agg(
        F.min(F.struct("turn")).alias("first"), F.count("*").alias("found")).where("found > 1")
    marked = rows.alias("r").join(first.alias("f"), _same("r", "f", "conv_id", "same"), "left")
    again = F.coalesce(~F.col("f.first.turn").eqNullSafe(F.col("r.turn"))
                       & F.col("f.found").isNotNull(), F.lit(False))
    whole = F.when(F.col("blank"), _BLANK).when(again, _DUPLICATE).when(
        F.col("open"), _TRUNCATED).otherwise(_FINE)
    copies = F.posexplode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("copy", "one")
    repeated = marked.select("r.conv_id", whole.alias("fault"), "r.turn", "r.role", "r.text", copies)
    return repeated.select(
        "conv_id", F.when((F.col("copy") > 0) & (F.col("fault") != _BLANK), _DUPLICATE)
        .otherwise(F.col("fault")).alias("fault"), "turn", "role", "text")


def repaired(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """Faults and cheapest edits of each of ``conversations`` (conv_id), given their rows.

    The columns are those of ``SCHEMA``. Rows are taken by turn, null first, then by role and
    text, and equal rows next to each other. ``illegal`` counts neighbours whose roles' initials
    aren't su, ua or au. Roles count by their initials as they are: only s, u and a can be kept.
    A conversation without rows has zeros, no edits and the hash of an empty text. Rows without
    conv_id are one conversation. A text of any length is read whole; one conversation is read in
    one task, as its hash runs over it in order, but isn't held there.
    """
    opening = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select(
        "conv_id", F.lit(-1).alias("fault"), F.lit(None).cast("long").alias("turn"),
        F.lit("").alias("role"), F.lit("").alias("text"))
    stream = opening.unionByName(with_faults(rows)).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("fault") >= 0, "turn", "role", "text", F.col("fault") == _DUPLICATE)
    return stream.mapInArrow(_stream, SCHEMA)


def repair_damaged(chats: DataFrame) -> DataFrame:
    """``repaired`` for ``chats`` (conv_id, turn, role, text) after ``damaged``.

    There is a row for each conv_id, also if all its rows were dropped. Repeated rows are rows of
    their own. Other columns are ignored; an empty table gives no rows.
    """
    return repaired(damaged(chats), chats)


def _add(path: str, cost: str | int, edit: str) -> str:
    """SQL of a path, cost in 12 digits before the edits, with one edit more."""
    return (f"lpad((substr({path}, 1, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || substr({path}, 13)"
            f" || '{edit}'")


_OPEN_COST = f"CASE WHEN r.fault = {_TRUNCATED} THEN {TRUNCATED} ELSE 0 END"


def _steps(to: str, initial: str, *sources: str) -> str:
    """SQL of the best path to a state over one row."""
    ways = [_add(f"p.{to}", DELETE, "D")]
    for source in sources:
        takes = f"r.fault NOT IN ({_BLANK}, {_DUPLICATE})"
        ways.append(f"CASE WHEN {takes} AND r.initial = '{initial}' THEN "
                    f"{_add(f'p.{source}', _OPEN_COST, 'K')} END")
        if initial != "s":
            ways.append(f"CASE WHEN {takes} THEN "
                        f"{_add(f'p.{source}', f'{RENAME} + {_OPEN_COST}', 'R')} END")
    return f"least({', '.join(ways)})" if len(ways) > 1 else ways[0]


_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         CAST({CRC32_SQL.format(key="key")} AS BIGINT) % 20 AS kind
  FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
        FROM conversations)
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END
           AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE kind <> 0
), judged AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
           AS rn,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy)
           AS again,
         rtrim(text, {_BLANKS}) AS solid
  FROM hurt
), seq AS (
  SELECT conv_id, rn, turn, role, text, substr(role, 1, 1) AS initial,
         CASE WHEN solid = '' THEN {_BLANK} WHEN again > 1 THEN {_DUPLICATE}
              WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN {_TRUNCATED} ELSE {_FINE} END AS fault
  FROM judged
), neighbours AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY rn) AS before FROM seq
), counted AS (
  SELECT conv_id, max(rn) AS rows,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = {_BLANK}) AS blank,
         count(*) FILTER (fault = {_DUPLICATE}) AS duplicate,
         count(*) FILTER (fault = {_TRUNCATED}) AS truncated,
         count(*) FILTER (rn > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM neighbours GROUP BY conv_id
), paths(conv_id, rn, z, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, '{0:012d}', NULL::VARCHAR, '{INSERT:012d}I', '{2 * INSERT:012d}II'
  FROM counted
  UNION ALL
  SELECT conv_id, rn, z, s, u, least(a, {_add("u", INSERT, "I")})
  FROM (SELECT conv_id, rn, z, s, least(u, {_add("least(z, s, a)", INSERT, "I")}) AS u, a
        FROM (SELECT p.conv_id, r.rn, {_steps("z", "")} AS z, {_steps("s", "s", "z")} AS s,
                     {_steps("u", "u", "z", "s", "a")} AS u, {_steps("a", "a", "u")} AS a
              FROM paths p JOIN seq r
                ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.rn = p.rn + 1))
), best AS (
  SELECT c.*, substr(least(p.z, p.a), 1, 12)::BIGINT AS cost, substr(least(p.z, p.a), 13) AS audit
  FROM paths p JOIN counted c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.rows = p.rn
), edits AS (
  SELECT conv_id, audit, length(replace(audit, 'D', '')) % 2 AS odd, k, audit[k] AS edit,
         length(replace(audit[1:k], 'D', '')) AS place, length(replace(audit[1:k], 'I', '')) AS rn
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM best)
), lines AS (
  SELECT e.conv_id, string_agg(
    CASE WHEN e.edit = 'K' THEN r.role WHEN (e.place - e.odd) % 2 = 1 THEN 'user'
         ELSE 'assistant' END || ':' || CASE WHEN e.edit = 'I' THEN '' ELSE r.text END,
    chr(10) ORDER BY e.k) AS text
  FROM edits e LEFT JOIN seq r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.rn = e.rn
  WHERE e.edit <> 'D' GROUP BY e.conv_id
)
SELECT c.conv_id, coalesce(b.gaps, 0) AS gaps, coalesce(b.blank, 0) AS blank,
       coalesce(b.duplicate, 0) AS duplicate, coalesce(b.truncated, 0) AS truncated,
       coalesce(b.illegal, 0) AS illegal, coalesce(b.cost, 0) AS cost,
       coalesce(b.audit, '') AS audit, sha256(coalesce(l.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM c.conv_id
"""
