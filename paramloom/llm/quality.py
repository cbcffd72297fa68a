"""Quality rules: counts that speak for themselves, and a classifier trained on labelled rows.

The classifier is a logistic regression over hashed word and character n-grams (words, pairs of
words, three bytes), as shares of all n-grams of a text. It is fitted in numpy on ``LABELLED``
labelled rows at most, chosen by a hash of their id, and calibrated on those of them that it
was not fitted on. Texts are scored in Arrow batches, whole, against a fixed threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramloom.llm.words import Words, mix, powers, slices, windows, words_of

LABELLED = 2_000
HELD_OUT = 4
BUCKETS = 2_048
THRESHOLD = 0.25
LEAST_WORDS = 20
MOST_REPEATED = 30
REPEAT_WINDOW = 8
SYMBOLS = b"#*$%&|<>"
_SCALE = 30.0
_U = np.uint64
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_STEP = _U(0x9E3779B97F4A7C15)
_STEP_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _per_text(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring cuts."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[cuts[1:]] - total[cuts[:-1]]


def _same(texts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each item whether an equal one comes before it in its text, or anywhere in it."""
    keys = mix(hashes + texts.astype(np.uint64) * _U(0xD1342543DE82EF95))
    _, first, group, counts = np.unique(keys, return_index=True, return_inverse=True,
                                        return_counts=True)
    return np.arange(len(keys)) != first[group], counts[group] > 1


def base_counts(words: Words) -> dict[str, np.ndarray]:
    """The base rules' counts of each text of a slice."""
    data, cuts = words.data, words.text_start
    if not len(data):  # empty texts alone
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        return {name: np.zeros(len(words), np.int64) for name in names}
    solid = np.zeros(len(data) + 1, np.int8)
    np.add.at(solid, words.start, 1)
    np.add.at(solid, words.end, -1)
    solid = np.cumsum(solid[:-1], dtype=np.int8).astype(bool)
    n_words = np.diff(words.first)

    line_start = np.unique(np.r_[cuts[:-1][np.diff(cuts) > 0], np.flatnonzero(data == 10) + 1])
    line_start = line_start[line_start < len(data)]
    text_of_line = np.searchsorted(cuts, line_start, side="right") - 1
    line_end = np.r_[line_start[1:], len(data)].astype(np.int64)
    line_end = line_end - ((line_end > line_start) & (data[np.maximum(line_end, 1) - 1] == 10))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * powers(_STEP, len(data)), out=total[1:])
    hashes = mix((total[line_end] - total[line_start])
                 * powers(_STEP_INVERSE, len(data) + 1)[line_start])
    hashes = mix(hashes + (line_end - line_start).astype(np.uint64))
    filled = np.r_[0, np.cumsum(solid)]
    worded = filled[line_end] > filled[line_start]
    again, _ = _same(text_of_line[worded], hashes[worded])
    n_dup_lines = np.bincount(text_of_line[worded][again], minlength=len(words))

    runs, places = windows(words, REPEAT_WINDOW)
    texts = np.searchsorted(words.first, places, side="right") - 1
    _, repeated = _same(texts, runs)
    cover = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(cover, places[repeated], 1)
    np.add.at(cover, places[repeated] + REPEAT_WINDOW, -1)
    return {
        "n_words": n_words,
        "word_chars": _per_text(solid & ((data & 0xC0) != 0x80), cuts),
        "n_symbols": _per_text(_IS_SYMBOL[data], cuts),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": _per_text(np.cumsum(cover)[:-1] > 0, words.first),
    }


def _grams(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all words, word pairs and byte triples of a slice, with the texts' cuts."""
    top = _U(64 - int(BUCKETS).bit_length() + 1)
    pairs, places = windows(words, 2)
    data = words.data.astype(np.uint32)
    triples = np.zeros(len(data), np.uint32)
    if len(data) > 2:
        triples[:-2] = (data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77)
                        + data[2:] * np.uint32(0xC2B2AE3D))
        triples ^= triples >> np.uint32(15)
        triples *= np.uint32(0x2C1B3C6D)
    ends = np.maximum(words.text_start[1:] - 2, words.text_start[:-1])
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, words.text_start[:-1], 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    byte_cuts = np.r_[0, np.cumsum(inside)][words.text_start]
    return [((words.hash >> top).astype(np.int64), words.first),
            ((pairs >> top).astype(np.int64), np.searchsorted(places, words.first)),
            ((triples[inside] >> np.uint32(32 - int(BUCKETS).bit_length() + 1)).astype(np.int64),
             byte_cuts)]


@dataclass
class Model:
    """Weights per kind of n-gram and bucket, the bias, and the calibration's line."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    threshold: float = THRESHOLD

    def probability(self, words: Words) -> np.ndarray:
        logit = np.full(len(words), self.bias)
        for kind, (buckets, cuts) in enumerate(_grams(words)):
            logit += (_SCALE * _per_text(self.weights[kind][buckets], cuts)
                      / np.maximum(np.diff(cuts), 1))
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.offset, -500, 500)))


def _features(batches):
    for batch in batches:
        texts = batch.column(1)
        for begin, end in slices(texts):
            words = words_of(texts.slice(begin, end - begin))
            rows = np.zeros((len(words), 3 * BUCKETS), np.float32)
            for kind, (buckets, cuts) in enumerate(_grams(words)):
                for i in range(len(words)):
                    part = buckets[cuts[i]:cuts[i + 1]]
                    rows[i, kind * BUCKETS:(kind + 1) * BUCKETS] = (
                        np.bincount(part, minlength=BUCKETS) / max(len(part), 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(begin, end - begin),
                 pa.array([_packed(r) for r in rows], pa.binary()),
                 batch.column(2).slice(begin, end - begin)], ["label", "shares", "place"])


def _packed(row: np.ndarray) -> bytes:
    places = np.flatnonzero(row).astype(np.int32)
    return places.tobytes() + row[places].tobytes()


def _unpacked(rows: list[bytes]) -> np.ndarray:
    out = np.zeros((len(rows), 3 * BUCKETS), np.float32)
    for i, packed in enumerate(rows):
        n = len(packed) // 8
        out[i, np.frombuffer(packed, np.int32, n)] = np.frombuffer(packed, np.float32, n, 4 * n)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent with momentum; both classes weigh the same."""
    share = max(min(y.mean(), 1 - 1e-6), 1e-6)
    sample = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / len(y)
    x, y = np.ascontiguousarray(x, np.float32), y.astype(np.float32)
    sample = sample.astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), np.float32(0)
    vw, vb = np.zeros_like(w), 0.0
    rate = np.float32(4 / (np.einsum("ij,ij->i", x, x).max() + 1))
    for _ in range(steps):
        error = sample * (1 / (1 + np.exp(-(x @ w + b))) - y)
        vw = 0.9 * vw - rate * (error @ x + np.float32(penalty) * w)
        vb = 0.9 * vb - rate * error.sum()
        w, b = w + vw, b + vb
    return w, b


def fit(labelled: DataFrame, most: int = LABELLED, threshold: float = THRESHOLD) -> Model:
    """A model from ``doc_id, text, label`` (1 good, 0 bad), on at most ``most`` labelled rows.

    Rows with a null label or text are left out. A hash of the text says which rows are held out
    for the calibration and in which order all are summed, so that the model doesn't depend on
    how the rows are stored. Without rows of both classes the model takes every text for good.
    """
    chosen = (labelled.where("label is not null and text is not null")
              .select(F.col("label").cast("int").alias("label"), "text",
                      F.xxhash64("text").alias("place")))
    table = chosen.mapInArrow(_features, "label int, shares binary, place long").toArrow()
    y = table.column("label").to_numpy().astype(float)
    x = _unpacked(table.column("shares").to_pylist()) * _SCALE
    place = table.column("place").to_numpy()
    held_out = place % HELD_OUT == 0
    order = np.lexsort((y, place, held_out))
    x, y = x[order], y[order]
    if len(set(y.tolist())) < 2:
        return Model(np.zeros((3, BUCKETS), np.float32), 0.0, 1.0, 20.0, threshold)
    cut = len(y) - int(held_out.sum())
    if len(set(y[:cut].tolist())) < 2:  # too few rows to hold any out
        cut = len(y)
    w, b = _logistic(x[:cut], y[:cut], 1e-5, 300)
    held = (x[cut:] @ w + b)[:, None]
    if len(set(y[cut:].tolist())) < 2:
        slope, offset = 1.0, 0.0
    else:
        spread = held.std() + 1e-9
        line, offset = _logistic(held / spread, y[cut:], 1e-3, 400)
        slope = max(float(line[0] / spread), 1e-3)
    return Model(w.reshape(3, BUCKETS).astype(np.float32), float(b), float(slope), float(offset),
                 threshold)


def sample_of(labels: DataFrame, docs: DataFrame, label: str, most: int = LABELLED) -> DataFrame:
    """``label, text`` of ``most`` labelled rows at most, by a hash of the id.

    An id with several labels or texts has the least of each.
    """
    rows = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
            .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.min(F.col(label)).alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(rows), "doc_id").groupBy("doc_id").agg(
        F.min("label").alias("label"), F.min("text").alias("text")).select("label", "text")


def _scored(model: Model):
    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            for begin, end in slices(texts):
                words = words_of(texts.slice(begin, end - begin))
                counts = base_counts(words)
                n, repeated = counts["n_words"], counts["n_repeat_words"]
                failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
                good = model.probability(words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin),
                     *(pa.array(c, pa.int64()) for c in counts.values()),
                     pa.array(failed), pa.array(good), pa.array(~failed & (good >= model.threshold))],
                    ["doc_id", *counts, "base_failed", "probability", "kept"])
    return run


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """Counts, ``base_failed``, ``probability`` and ``kept`` for each row of ``docs``.

    Null and empty texts have no words and fail the base rules. Rows without doc_id and repeated
    rows are judged like others. Other columns are ignored; an empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _scored(model),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, base_failed boolean, probability double, kept boolean")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, all columns, without the rows that the rules reject."""
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for begin, end in slices(texts):
                words = words_of(texts.slice(begin, end - begin))
                counts = base_counts(words)
                n = counts["n_words"]
                good = ((n >= LEAST_WORDS) & (100 * counts["n_repeat_words"] <= MOST_REPEATED * n)
                        & (model.probability(words) >= model.threshold))
                yield batch.slice(begin, end - begin).filter(pa.array(good))
    return docs.mapInArrow(run, docs.schema)
