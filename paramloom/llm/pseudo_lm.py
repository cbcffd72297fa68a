"""Scores by a masked language model: every word predicted from both sides.

The probability of a word between its neighbours has two factors. A network predicts the word's
class, one of 64 x 64 hash classes: the vectors of the ``REACH`` words on the left and of as many
on the right are summed, pass a tanh layer, and predict the class in two steps of 64 (its row,
then its place in the row). Within its class a word has its share of the class's words in the
corpus, with room for words that the corpus doesn't hold (as many as the class has distinct
ones). Both factors are exact, so that all words and the unknown one of each class sum to one.
A text's score is the sum of the logarithms over all its places: the pseudo-likelihood.

Texts are dealt by a hash into blocks of about ``BLOCK_BYTES``; the order in a block is that of
the hash, too. A block is one row: its distinct words, their counts, and the texts as numbers of
those words. Nothing thereafter depends on how the input is stored. The vocabulary, a row per
distinct word of the corpus, is a table and stays one: blocks meet their words' counts in a join.

Training covers every word of every document once, in rounds whose number grows with the
logarithm of the number of blocks. In a round each block descends from the round's start; the
blocks' networks and step sizes are averaged, weighted by words, in groups of ``FAN_IN`` tasks
until one is left, the start of the next round. What reaches the driver is one network of fixed
size a round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramloom.llm.tables import written
from paramloom.llm.words import Words, slices, words_of
from paramloom.session import work_path

SIDE = 64
UNITS = 16
REACH = 4
BATCH = 8_192
FAN_IN = 16
RATE = 0.15
BLOCK_BYTES = 4 << 20
#: A text's share of a block beside its bytes, so that empty texts fill blocks, too.
ROW_BYTES = 16
#: Words in so many blocks that fewer than this number of words can be are broadcast.
HOT_WORDS = 10_000
_PAD = SIDE * SIDE

Network = dict[str, np.ndarray]

_BLOCK = ("block long, round int, doc_ids array<long>, lengths array<long>, "
          "vocabulary array<long>, counts array<long>, ids binary")


@dataclass
class Model:
    """A network, the corpus's words (``word, n, n_blocks``) and, per class, all and distinct ones."""

    network: Network
    vocabulary: DataFrame
    totals: np.ndarray


def new_network(seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)

    def small(*shape):
        return rng.normal(0, 0.1, shape).astype(np.float32)
    network = {"left": small(_PAD + 1, UNITS), "right": small(_PAD + 1, UNITS),
               "bias": np.zeros(UNITS, np.float32), "rows": small(UNITS, SIDE),
               "rows_bias": np.zeros(SIDE, np.float32), "places": small(SIDE, UNITS, SIDE),
               "places_bias": np.zeros((SIDE, SIDE), np.float32)}
    network["left"][_PAD] = network["right"][_PAD] = 0
    return network


def _flat(network: Network, seen: Network) -> np.ndarray:
    return np.concatenate([part[k].ravel() for part in (network, seen) for k in sorted(part)])


def _parts(flat: np.ndarray) -> tuple[Network, Network]:
    shapes, at, parts = new_network(), 0, ({}, {})
    for part in parts:
        for k in sorted(shapes):
            size = shapes[k].size
            part[k] = flat[at:at + size].reshape(shapes[k].shape).astype(np.float32)
            at += size
    return parts


def _class_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(52)).astype(np.int64)


def _padded(classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    text = np.repeat(np.arange(len(lengths)), lengths)
    places = np.arange(len(classes)) + REACH * (text + 1)
    out = np.full(len(classes) + REACH * (len(lengths) + 1), _PAD)
    out[places] = classes
    return out, places


def stream(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all words with ``REACH`` pads before and behind each text; the words' places."""
    return _padded(_class_of(words.hash), np.diff(words.first))


def _softmax(h: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    logits = weights.T @ h.T  # places side by side: maxima and sums run along memory
    logits += bias[:, None]
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits.T


def _hidden(network: Network, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    low, n = places[0] - REACH, places[-1] - places[0] + 1
    near = ids[low:low + n + 2 * REACH]
    left, right = network["left"][near], network["right"][near]
    total = np.tile(network["bias"], (n, 1))
    for o in range(1, REACH + 1):
        total += left[REACH - o:REACH - o + n]
        total += right[REACH + o:REACH + o + n]
    return np.tanh(total[places - places[0]])


def _by_row(rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    cuts = np.searchsorted(rows[order], np.arange(SIDE + 1))
    for r in range(SIDE):
        if cuts[r] < cuts[r + 1]:
            yield r, order[cuts[r]:cuts[r + 1]]


def log_probabilities(network: Network, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The logarithm of the probability of each word's class between its neighbours."""
    out = np.zeros(len(places), np.float64)
    for begin in range(0, len(places), 16 * BATCH):
        part = places[begin:begin + 16 * BATCH]
        h, target = _hidden(network, ids, part), ids[part]
        rows, cells = target // SIDE, target % SIDE
        p = _softmax(h, network["rows"], network["rows_bias"])[np.arange(len(part)), rows]
        for r, at in _by_row(rows):
            q = _softmax(h[at], network["places"][r], network["places_bias"][r])
            p[at] *= q[np.arange(len(at)), cells[at]]
        out[begin:begin + len(part)] = np.log(np.maximum(p, 1e-30))
    return out


def _gradients(network: Network, ids: np.ndarray, places: np.ndarray) -> Network:
    n = len(places)
    h, target = _hidden(network, ids, places), ids[places]
    rows, cells = target // SIDE, target % SIDE
    d = _softmax(h, network["rows"], network["rows_bias"])
    d[np.arange(n), rows] -= 1
    g: Network = {"rows": h.T @ d / n, "rows_bias": d.mean(axis=0),
                  "places": np.zeros_like(network["places"]),
                  "places_bias": np.zeros_like(network["places_bias"])}
    dh = d @ network["rows"].T
    for r, at in _by_row(rows):
        e = _softmax(h[at], network["places"][r], network["places_bias"][r])
        e[np.arange(len(at)), cells[at]] -= 1
        g["places"][r] = h[at].T @ e / n
        g["places_bias"][r] = e.sum(axis=0) / n
        dh[at] += e @ network["places"][r].T
    dh *= (1 - h * h) / np.float32(n)
    g["bias"] = dh.sum(axis=0)
    low, span = places[0] - REACH, places[-1] - places[0] + 1 + 2 * REACH
    spread = np.zeros((span + 2 * REACH, UNITS), np.float32)
    spread[places - low + REACH] = dh
    near = ids[low:low + span].astype(np.uint16)
    order = np.argsort(near, kind="stable")
    firsts = np.flatnonzero(np.r_[True, np.diff(near[order]) != 0])
    for side, sign in (("left", 1), ("right", -1)):
        total = np.zeros((span, UNITS), np.float32)
        for o in range(1, REACH + 1):
            total += spread[REACH + sign * o:REACH + sign * o + span]
        g[side] = np.zeros_like(network[side])
        g[side][near[order][firsts]] = np.add.reduceat(total[order], firsts, axis=0)
        g[side][_PAD] = 0
    return g


class Descent:
    """Steps with a rate per weight, smaller where gradients were large."""

    def __init__(self, network: Network, seen: Network):
        self.network = {k: v.copy() for k, v in network.items()}
        self.seen = {k: v.copy() for k, v in seen.items()}
        self.words = 0

    def learn(self, ids: np.ndarray, places: np.ndarray) -> None:
        for begin in range(0, len(places), BATCH):
            part = places[begin:begin + BATCH]
            for k, g in _gradients(self.network, ids, part).items():
                self.seen[k] += g * g
                self.network[k] -= np.float32(RATE) * g / np.sqrt(self.seen[k])
            self.words += len(part)


def _planes(ids: np.ndarray) -> bytes:
    """Whole numbers as their lowest bytes, then the next ones: small numbers compress well."""
    return ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _block(rounds: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("text_hash", "ascending"), ("doc_id", "ascending")])
        texts = table.column("text").combine_chunks()
        parts = [words_of(texts.slice(begin, end - begin)) for begin, end in slices(texts)]
        hashes = np.concatenate([w.hash for w in parts])
        lengths = np.concatenate([np.diff(w.first) for w in parts])
        words = pa.array(hashes, pa.uint64()).dictionary_encode()
        known, ids = words.dictionary.to_numpy(), words.indices.to_numpy()
        counts = np.bincount(ids, minlength=len(known))
        order = np.lexsort((known, -counts))
        rank = np.empty(len(order), "<u4")
        rank[order] = np.arange(len(order))
        block = key[0].as_py()
        return pa.table({
            "block": pa.array([block], pa.int64()), "round": pa.array([block % rounds], pa.int32()),
            "doc_ids": pa.array([table.column("doc_id").to_pylist()], pa.list_(pa.int64())),
            "lengths": pa.array([lengths], pa.list_(pa.int64())),
            "vocabulary": pa.array([known[order].view(np.int64)], pa.list_(pa.int64())),
            "counts": pa.array([counts[order]], pa.list_(pa.int64())),
            "ids": pa.array([_planes(rank[ids])], pa.binary())})
    return run


def blocks_of(docs: DataFrame) -> DataFrame:
    """All texts of ``docs`` in blocks, a row each, written to the shared folder by rounds."""
    size = docs.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)).first()[0]
    number = -(-(size or 1) // BLOCK_BYTES)
    doc_id = F.col("doc_id").cast("long")
    dealt = docs.select(
        F.pmod(F.xxhash64(doc_id, "text"), F.lit(number)).alias("block"), doc_id.alias("doc_id"),
        "text", F.xxhash64("text").alias("text_hash"))
    blocks = dealt.groupBy("block").applyInArrow(_block(number.bit_length()), _BLOCK)
    path = work_path(docs.sparkSession, "blocks")
    blocks.write.partitionBy("round").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(_BLOCK).parquet(path)


def _descend(start: bytes):
    def run(batches):
        network, seen = _parts(np.frombuffer(start, "<f4"))
        mean = _Mean()
        for batch in batches:
            for row in range(batch.num_rows):
                hashes = batch.column("vocabulary")[row].values.to_numpy().view(np.uint64)
                ids = _numbers(batch.column("ids")[row].as_py())
                descent = Descent(network, seen)
                descent.learn(*_padded(_class_of(hashes)[ids],
                                       batch.column("lengths")[row].values.to_numpy()))
                mean.add(descent.words, _flat(descent.network, descent.seen))
        yield from mean.rows()
    return run


class _Mean:
    """Networks averaged by words, of any number of tasks."""

    def __init__(self):
        self.words, self.total = 0, 0.0

    def add(self, words: int, state: np.ndarray) -> None:
        self.words, self.total = self.words + words, self.total + words * state.astype("<f8")

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.words:
            state = (self.total / self.words).astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.words], pa.int64()), pa.array([state], pa.binary())],
                ["words", "state"])


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mean = _Mean()
    for batch in batches:
        for words, state in zip(batch.column(0).to_pylist(), batch.column(1)):
            mean.add(words, np.frombuffer(state.as_py(), "<f4"))
    yield from mean.rows()


def _network(blocks: DataFrame) -> Network:
    network = new_network()
    seen = {k: np.full_like(v, 1e-6) for k, v in network.items()}
    rounds = sorted(r["round"] for r in blocks.select("round").distinct().collect())
    for number in rounds:
        start = _flat(network, seen).astype("<f4").tobytes()
        table = written(
            blocks.where(F.col("round") == number).select("lengths", "vocabulary", "ids")
            .mapInArrow(_descend(start), "words long, state binary"), "networks")
        count = table.count()
        while count > 1:
            table = written(table.coalesce(-(-count // FAN_IN)).mapInArrow(
                _averaged, "words long, state binary"), "networks")
            count = table.count()
        found = table.first()
        if found is not None:
            network, seen = _parts(np.frombuffer(found["state"], "<f4"))
    return network


def train(docs: DataFrame, blocks: DataFrame | None = None) -> Model:
    """The model of all texts of ``docs``; without words the start.

    ``blocks`` are those of ``docs`` where they are there already.
    """
    blocks = blocks_of(docs) if blocks is None else blocks
    pairs = blocks.select(F.explode(F.arrays_zip("vocabulary", "counts")).alias("pair"))
    vocabulary = written(pairs.groupBy(F.col("pair.vocabulary").alias("word")).agg(
        F.sum("pair.counts").alias("n"), F.count("*").alias("n_blocks")), "vocabulary")
    classes = vocabulary.groupBy(F.shiftrightunsigned("word", 52).cast("int").alias("class")).agg(
        F.sum("n").alias("n"), F.count("*").alias("distinct"))
    totals = np.zeros((_PAD, 2))
    for row in classes.collect():  # a row per class
        totals[row["class"]] = row["n"], row["distinct"]
    return Model(_network(blocks), vocabulary, totals)


def _within(classes: np.ndarray, n: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The logarithm of each word's share of its class; ``n`` is 0 for words not in the corpus."""
    every, distinct = totals[classes].T
    return np.log(np.where(n > 0, n, np.maximum(distinct, 1)) / np.maximum(every + distinct, 1))


def _scored(network: Network, totals: np.ndarray):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        classes = left.column("classes")[0].values.to_numpy().astype(np.int64)
        n = np.zeros(len(classes))
        n[right.column("pos").to_numpy()] = right.column("n").to_numpy()
        lengths = left.column("lengths")[0].values.to_numpy()
        ids = _numbers(left.column("ids")[0].as_py())
        logs = log_probabilities(network, *_padded(classes[ids], lengths))
        logs += _within(classes, n, totals)[ids]
        ends = np.cumsum(lengths)
        sums = np.r_[0, np.cumsum(logs)]
        found = sums[ends] - sums[ends - lengths]
        mean = found / np.maximum(lengths, 1)
        return pa.table({"doc_id": left.column("doc_ids")[0].values,
                         "n_tokens": pa.array(lengths, pa.int64()), "log_likelihood": found,
                         "per_token": pa.array(mean, mask=lengths == 0)})
    return run


def scores(docs: DataFrame, model: Model, blocks: DataFrame | None = None) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, per_token`` for each row of ``docs``.

    Null and empty texts have no tokens, the likelihood 0 and a null mean. Repeated rows and
    rows without doc_id are scored like others; a very long text is a block of its own size, in
    one task. Other columns are ignored; an empty table gives no rows. Words of very many blocks
    are looked up by broadcast, fewer than ``HOT_WORDS`` of them. ``blocks`` as in ``train``.
    """
    blocks = blocks_of(docs) if blocks is None else blocks
    words = blocks.select("block", F.posexplode("vocabulary").alias("pos", "word"))
    known = model.vocabulary
    rows = known.agg(F.sum("n_blocks")).first()[0] or 0
    hot = F.col("n_blocks") > rows // HOT_WORDS + 1
    common = F.broadcast(known.where(hot).select("word", "n"))
    rare = words.join(common.select("word"), "word", "left_anti").join(
        known.where(~hot).select("word", "n"), "word", "left")
    counted = words.join(common, "word").unionByName(rare).select(
        "block", "pos", F.coalesce("n", F.lit(0)).alias("n"))
    classes = F.transform("vocabulary", lambda w: F.shiftrightunsigned(w, 52).cast("smallint"))
    return (blocks.select(F.col("block").alias("home"), "doc_ids", "lengths", "ids",
                          classes.alias("classes")).groupBy("home")
            .cogroup(counted.groupBy("block"))
            .applyInArrow(_scored(model.network, model.totals),
                          "doc_id long, n_tokens long, log_likelihood double, per_token double"))
