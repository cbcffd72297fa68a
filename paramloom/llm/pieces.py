"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file of byte-pair pieces is compiled into arcs:

* the normaliser: a space becomes the escape sign, and one stands before the text;
* pieces: an arc per piece, from the place where it begins to where it ends; its weight is the
  negative score, as in the tropical semiring;
* byte fallback: an arc per character that no piece spells, putting out its bytes' pieces.

Byte-pair models don't mean the path of the best sum: a piece may follow another only if merging
the two spellings by the model's own order gives these two pieces again. That is a relation of
neighbours, so it is an acceptor with a state per piece and without weights of its own; composed
with the arcs it leaves one path to each place, which is therefore the shortest and the library's
encoding. Composition is lazy and keeps the last piece before each place. No piece joins the escape sign to what stands before it
(checked when compiling), so a text is composed word by word, and words seen lately are kept,
twice ``KNOWN_WORDS`` at most.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, IntegerType, LongType, StringType, StructField,
                               StructType)

from paramloom.llm.words import slices

ESCAPE = "▁"
KNOWN_WORDS = 500_000
KNOWN_BORDERS = 500_000
LETTERS = "".join(chr(c) for c in range(ord("A"), 0x250) if chr(c).isalpha())


class Transducer:
    """The compiled arcs of a model file."""

    def __init__(self, model: str):
        import sentencepiece

        with open(model, "rb") as file:
            source = sentencepiece.SentencePieceProcessor(model_proto=file.read())
        size = source.get_piece_size()
        special = [source.is_control(i) or source.is_unknown(i) or source.is_unused(i)
                   for i in range(size)]
        spelled = [source.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(spelled[i][1:-1], 16): i for i in range(size) if source.is_byte(i)}
        self.ids = {p: i for i, p in enumerate(spelled) if not special[i] and not source.is_byte(i)}
        self.weight = {p: -source.get_score(i) for p, i in self.ids.items()}
        if any(ESCAPE in p.lstrip(ESCAPE) for p in self.ids):
            raise ValueError("pieces join words: texts can't be composed word by word")
        if source.normalize("A  ÅＡ ") != f"{ESCAPE}A{ESCAPE * 2}ÅＡ{ESCAPE}":
            raise ValueError("only normalisers that escape spaces and change nothing else")
        if len(self.byte_ids) != 256:
            raise ValueError("a model with byte fallback is needed")
        # Signs that no piece joins to a letter before them; a line end, that none joins at all.
        joined = {a + b for p in self.ids for a, b in zip(p, p[1:])}
        signs = "".join(c for c in ".,;:!?" if not any(x + c in joined for x in LETTERS))
        line = "\n" if not any("\n" in pair for pair in joined) else ""
        safe = re.escape(signs + line)
        parts = [f"{ESCAPE}*[^{ESCAPE}]+", f"{ESCAPE}+"]
        if line:
            parts.insert(0, f"[.,;:!?]*\n(?=[{LETTERS}])")
        if safe:
            parts.insert(0, f"{ESCAPE}*[{LETTERS}]+(?=[{safe}{ESCAPE}]|\\Z)")
        self.word = re.compile("|".join(parts))
        self.out = [b""] * size
        for piece, i in self.ids.items():
            self.out[i] = piece.replace(ESCAPE, " ").encode()
        for value, i in self.byte_ids.items():
            self.out[i] = bytes([value])
        if source.unk_id() >= 0:
            self.out[source.unk_id()] = " ⁇ ".encode()
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.borders: dict[str, dict[str, bool]] = {}
        self.n_borders = 0
        found = {p: self._halves(p) for p in self.ids if len(p) > 1}
        self.halves = {p: h for p, h in found.items() if h is not None}
        # Arcs by spelling: whether a longer piece may begin so (False), or a piece is it (True).
        self.arcs = {p[:n]: False for p in self.ids for n in range(1, len(p) + 1)}
        self.arcs.update(dict.fromkeys(self.halves, True))

    def normalised(self, text: str) -> str:
        return ESCAPE + text.replace(" ", ESCAPE) if text else ""

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts whose merge, by the model's order, makes a piece; None if none do.

        The order is best score first, then the leftmost.
        """
        parts, weight = list(piece), self.weight
        while len(parts) > 2:
            best, at = None, -1
            for i in range(len(parts) - 1):
                w = weight.get(parts[i] + parts[i + 1])
                if w is not None and (best is None or w < best):
                    best, at = w, i
            if at < 0:
                return None
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def follows(self, left: str, right: str) -> bool:
        """The acceptor's arcs: may ``right`` follow ``left``?

        Merges are undone from the last to the first on both sides of the border; the two stay
        apart unless their neighbouring parts make a piece that would have been merged before.
        """
        weight, halves, limit = self.weight, self.halves, float("inf")
        while True:
            w = weight.get(left + right)
            if w is not None and w < limit:
                return False
            a = weight[left] if len(left) > 1 else -1.0
            b = weight[right] if len(right) > 1 else -1.0
            if a > b:
                limit, left = a, halves[left][1]
            elif b < 0:
                return True
            else:
                limit, right = b + 0.5, halves[right][0]

    def path(self, word: str) -> list[str]:
        """The shortest path through the arcs of a word, as the spellings along it.

        The acceptor lets one path reach a place, so a place that is reached needs no other.
        """
        n = len(word)
        last: list[str | None] = [""] + [None] * n
        arcs, follows = self.arcs, self.follows
        if self.n_borders > KNOWN_BORDERS:
            self.borders, self.n_borders = {}, 0
        for i in range(n):
            left = last[i]
            if left is None:
                continue
            fits = self.borders.setdefault(left, {})
            j, part, piece = i + 1, word[i], True
            while True:
                if piece and last[j] is None:
                    fit = fits.get(part) if left else True
                    if fit is None:
                        fit = fits[part] = follows(left, part)
                        self.n_borders += 1
                    if fit:
                        last[j] = part
                j += 1
                if j > n:
                    break
                part = word[i:j]
                piece = arcs.get(part)
                if piece is None:
                    break
        parts, at = [], n
        while at:
            parts.append(last[at])
            at -= len(last[at])
        return parts[::-1]

    def _word_ids(self, word: str) -> bytes:
        found: list[int] = []
        for part in self.path(word):
            known = self.ids.get(part)
            if known is not None:
                found.append(known)
            else:
                found += [self.byte_ids[b] for b in part.encode()]
        return np.array(found, "<i4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        words, known = self.word.findall(self.normalised(text)), self.known
        try:
            return np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4")
        except KeyError:
            pass
        if len(known) > KNOWN_WORDS:
            self.known, self.before = {}, known
            known = self.known
        for word in set(words):
            if word not in known:
                found = self.before.get(word)
                known[word] = self._word_ids(word) if found is None else found
        return np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: arcs read the other way, without the sign put before the text."""
        text = b"".join(map(self.out.__getitem__, ids.tolist())).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


_compiled: dict[str, Transducer] = {}


def transducer(model: str) -> Transducer:
    """A model's transducer, compiled once in a Python worker."""
    if model not in _compiled:
        _compiled[model] = Transducer(model)
    return _compiled[model]


def _encoded(model: str, place: int, check: bool, kept: list[int]):
    def run(batches):
        machine = transducer(model)
        for batch in batches:
            column = batch.column(place)
            for begin, end in slices(column):
                ids, trips = [], []
                for text in column.slice(begin, end - begin).to_pylist():
                    ids.append(machine.encode(text or ""))
                    if check:
                        trips.append(machine.decode(ids[-1]) == (text or "").replace(ESCAPE, " "))
                sizes = np.array([len(x) for x in ids], np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()),
                    pa.array(np.concatenate(ids), pa.int32()))
                more = [pa.array(sizes), lists] + ([pa.array(trips, pa.bool_())] if check else [])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(begin, end - begin) for i in kept] + more,
                    [batch.schema.names[i] for i in kept] + ["n_ids", "ids", "round_trip"][:len(more)])
    return run


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_ids, ids, round_trip`` for each row of ``docs`` (doc_id, text).

    ``round_trip`` says that decoding gives the text again; the escape sign itself decodes as a
    space. Null and empty texts have no ids. Repeated rows and rows without doc_id are encoded
    like others. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_encoded(model, 1, True, [0]),
                           "doc_id long, n_ids long, ids array<int>, round_trip boolean")


def with_ids(docs: DataFrame, model: str) -> DataFrame:
    """``docs``, all columns, with ``n_ids`` and ``ids``; columns of these names are replaced."""
    rows = docs.drop("n_ids", "ids")
    every = list(range(len(rows.columns)))
    schema = StructType([*rows.schema, StructField("n_ids", LongType()),
                         StructField("ids", ArrayType(IntegerType()))])
    return rows.mapInArrow(_encoded(model, rows.columns.index("text"), False, every), schema)


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """``rows`` with ``text`` from ``ids``; null ids give a null text."""
    def run(batches):
        machine = transducer(model)
        for batch in batches:
            texts = [None if ids is None else machine.decode(np.array(ids, np.int32))
                     for ids in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])
    rows = rows.drop("text")
    return rows.mapInArrow(run, StructType([*rows.schema, StructField("text", StringType())]))
