"""Repeated passages, located by sharded Aho-Corasick automata.

A window of ``WINDOW`` words is a repeat if the same words also start earlier: in a document
with a smaller doc_id, or earlier in the same one. All words that repeats cover are removed.

1. Propose. Of each document the phrases of ``PHRASE`` words are taken whose hash is the
   smallest in some window. Equal windows have equal smallest phrases, so a window can only be
   a repeat if its phrase occurs twice in the corpus.
2. Locate. Documents lie in blocks of about ``BLOCK_BYTES`` of text. The phrases of a block that
   recur anywhere make the automaton of that shard, and all documents of the block stream
   through it. The windows around the places found are compared by 128-bit hashes over all
   blocks, each block sending a window once; this confirms passages and names their first place.
3. Remove. A block learns which of its windows start earlier elsewhere; within the block it
   sees that itself.

A shard's automaton is no larger than the shard's own text, and no document visits another
shard. A passage that all documents share is one row per block. Documents are shuffled once;
the three passes read the same shuffle.
"""

from __future__ import annotations

import itertools

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paramloom.llm.words import Words, windows, words_of

WINDOW = 20
PHRASE = 10
BLOCK_BYTES = 2 << 20
_SECOND = 0x5851F42D4C957F2D


class _Block:
    """The documents of a block in doc_id order, a null id first."""

    def __init__(self, table: pa.Table, window: int):
        table = table.sort_by([("doc_id", "ascending")])
        nulls = table.column("doc_id").null_count
        if nulls:  # nulls are sorted to the end
            table = pa.concat_tables([table.slice(len(table) - nulls),
                                      table.slice(0, len(table) - nulls)])
        self.ids = table.column("doc_id").combine_chunks()
        self.words: Words = words_of(table.column("text"))
        self.window = window
        known = self.ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.rank = np.cumsum(np.r_[False, (known[1:] != known[:-1])
                                    | (self.ids.is_valid().to_numpy(zero_copy_only=False)[1:]
                                       != self.ids.is_valid().to_numpy(zero_copy_only=False)[:-1])]
                              ) if len(known) else np.zeros(0, np.int64)

    def phrases(self, phrase: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and places of the phrases that are smallest in some window."""
        hashes, places = windows(self.words, phrase)
        span = self.window - phrase + 1
        if len(hashes) < span:
            return hashes[:0], places[:0]
        low = np.lib.stride_tricks.sliding_window_view(hashes, span).min(axis=1)
        low[places[span - 1:] - places[:len(low)] != span - 1] = 0
        padded = np.concatenate([np.zeros(span - 1, np.uint64), low, np.zeros(span - 1, np.uint64)])
        high = np.lib.stride_tricks.sliding_window_view(padded, span).max(axis=1)
        chosen = high == hashes
        return hashes[chosen], places[chosen]

    def letters(self) -> tuple[str, int]:
        """All words as two characters each, a word apart between texts."""
        _, codes = np.unique(self.words.hash, return_inverse=True)
        base = int(np.sqrt(codes.max(initial=0) + 1)) + 1
        pairs = np.stack([codes // base + 1, codes % base + base + 2], axis=1)
        return pairs.astype("<u2").tobytes().decode("utf-16-le"), 2

    def start(self, places: np.ndarray, texts: np.ndarray) -> np.ndarray:
        return places - self.words.first[texts]


def _located(block: _Block, recurring: np.ndarray, phrase: int) -> np.ndarray:
    """Places of windows that hold a phrase of ``recurring``, found by the block's automaton."""
    hashes, places = block.phrases(phrase)
    mine = np.flatnonzero(np.isin(hashes, recurring))
    if not len(mine):
        return np.zeros(0, np.int64)
    _, kinds = np.unique(hashes[mine], return_index=True)
    text, width = block.letters()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for place in places[mine[kinds]].tolist():
        automaton.add_word(text[width * place:width * (place + phrase)])
    automaton.make_automaton()
    found = np.fromiter((end for end, _ in automaton.iter(text)), np.int64) // width - phrase + 1
    around = np.zeros(len(block.words.hash) + 1, np.int64)
    np.add.at(around, np.maximum(found - (block.window - phrase), 0), 1)
    np.add.at(around, found + 1, -1)
    _, valid = windows(block.words, block.window)
    return valid[np.cumsum(around)[valid] > 0]


def _propose(window: int, phrase: int):
    def run(key, table):
        hashes, _ = _Block(table, window).phrases(phrase)
        kinds, counts = np.unique(hashes.view(np.int64), return_counts=True)
        return pa.table({"block": pa.array(np.full(len(kinds), key[0].as_py()), pa.int64()),
                         "phrase": kinds, "here": pa.array(counts, pa.int64())})
    return run


def _locate(window: int, phrase: int):
    def run(key, docs, recurring):
        block = _Block(docs, window)
        wanted = recurring.column("phrase").to_numpy().view(np.uint64)
        places = _located(block, wanted, phrase)
        texts = np.searchsorted(block.words.first, places, side="right") - 1
        starts = block.start(places, texts)
        order = np.lexsort((starts, block.rank[texts]))
        places, texts, starts = places[order], texts[order], starts[order]
        one, at = windows(block.words, window)
        two, _ = windows(block.words, window, _SECOND)
        row = np.searchsorted(at, places)
        one, two = one[row].view(np.int64), two[row].view(np.int64)
        _, kinds = np.unique(one, return_index=True)
        return pa.table({
            "one": one[kinds], "two": two[kinds],
            "doc_id": block.ids.take(pa.array(texts[kinds])), "start": starts[kinds]})
    return run


def _remove(window: int):
    def run(key, docs, earlier):
        block = _Block(docs, window)
        words = block.words
        hashes, places = windows(words, window)
        repeat = np.isin(hashes, earlier.column("one").to_numpy().view(np.uint64))
        texts = np.searchsorted(words.first, places, side="right") - 1
        starts, rank = block.start(places, texts), block.rank[texts]
        order = np.lexsort((starts, rank, hashes))
        same = hashes[order][1:] == hashes[order][:-1]
        group = np.cumsum(np.r_[True, ~same]) - 1 if len(order) else order
        head = np.flatnonzero(np.r_[True, ~same])[group] if len(order) else order
        late = ((rank[order] != rank[order][head]) | (starts[order] != starts[order][head]))
        repeat[order[late]] = True
        cover = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(cover, places[repeat], 1)
        np.add.at(cover, places[repeat] + window, -1)
        gone = np.cumsum(cover)[:-1] > 0
        n_words, kept, removed, spans = [], [], [], []
        for i in range(len(words)):
            a, b = int(words.first[i]), int(words.first[i + 1])
            out = gone[a:b]
            found = words.data[words.start[a]:words.end[b - 1]].tobytes().split() if b > a else []
            edges = np.flatnonzero(np.diff(np.r_[False, out, False]))
            if len(edges):
                found = itertools.compress(found, (~out).tolist())
            n_words.append(b - a)
            removed.append(int(out.sum()))
            kept.append(b" ".join(found).decode())
            spans.append([{"begin": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)])
        return pa.table({
            "doc_id": block.ids, "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string()),
            "removed": pa.array(spans, pa.list_(pa.struct(
                [("begin", pa.int64()), ("end", pa.int64())])))})
    return run


def _block_count(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(total // BLOCK_BYTES) + 1


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text, removed`` for each row of ``docs``.

    ``removed`` lists the word ranges taken out, ``kept_text`` the other words joined by one
    space. Words are runs outside space and tab ... carriage return, unchanged; windows are
    judged on the input. Null and empty texts have no words; shorter texts than a window keep
    all. A null doc_id is smaller than any other; rows with one doc_id don't repeat each other
    at equal places. Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    block = F.pmod(F.xxhash64("doc_id"), F.lit(_block_count(rows)))
    rows = rows.withColumn("block", block)
    proposed = rows.groupBy("block").applyInArrow(
        _propose(window, phrase), "block long, phrase long, here long")
    everywhere = F.sum("here").over(Window.partitionBy("phrase"))
    recurring = (proposed.withColumn("everywhere", everywhere).where("everywhere > 1")
                 .select("block", "phrase"))
    places = rows.groupBy("block").cogroup(recurring.groupBy("block")).applyInArrow(
        _locate(window, phrase), "one long, two long, doc_id long, start long")
    same = Window.partitionBy("one", "two").orderBy("doc_id", "start")
    later = ~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("start") == F.col("first_start")))
    earlier = (places.withColumn("first_id", F.first("doc_id").over(same))
               .withColumn("first_start", F.first("start").over(same)).where(later)
               .select(block.alias("block"), "one"))
    return rows.groupBy("block").cogroup(earlier.groupBy("block")).applyInArrow(
        _remove(window), "doc_id long, n_words long, n_removed long, kept_text string, "
        "removed array<struct<begin: long, end: long>>")


SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), places AS (
  SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS start FROM w WHERE len(words) >= 20
), grams AS (
  SELECT doc_id, start, array_to_string(words[start:start + 19], ' ') AS gram FROM places
), marked AS (
  SELECT doc_id, start,
         row_number() OVER (PARTITION BY gram ORDER BY doc_id, start) > 1 AS again
  FROM grams
), gone AS (
  SELECT DISTINCT doc_id, start + unnest(range(0, 20)) AS place FROM marked WHERE again
), lists AS (
  SELECT doc_id, list(place) AS places, count(*) AS n FROM gone GROUP BY doc_id
), each_word AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM w
), kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.place) AS t
  FROM each_word e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.place = g.place
  WHERE g.place IS NULL GROUP BY e.doc_id
)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(l.n, 0) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN lists l ON l.doc_id = w.doc_id LEFT JOIN kept k ON k.doc_id = w.doc_id
"""
