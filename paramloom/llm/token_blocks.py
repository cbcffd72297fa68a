"""Token ids of documents in files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents, each document's ids with the end id behind
them, cut into blocks of ``BLOCK`` ids (the last may be shorter). A block stores its minimum,
the offsets from it in as many bits as cover ``COVERED`` of them, and a list of exceptions for
the others. Layout, all numbers little-endian:

    "PFOR1\\0\\0\\0" | blocks one after the other | index | footer
    block:  for each 64 ids ``width`` 8-byte words, then exceptions: places (uint16), values (uint32)
    index:  per block byte offset (uint64), minimum (uint32), ids (uint16), width (uint8),
            pad (uint8), exceptions (uint32)
    footer: number of blocks, number of ids, byte offset of the index (uint64 each)

Files are written by tasks in ascending doc_id order under names of their own, through the
file system that the folder's URI names. A written file counts once the table of documents,
which Spark commits, names it: a task that ran twice leaves an unnamed file and no harm.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paramloom.llm.tables import written
from paramloom.llm.words import run_hashes, slices, text_bytes
from paramloom.session import work_path

BLOCK = 1024
COVERED = 0.95
END_ID = 2
FILE_BYTES = 64 << 20
KNOWN_PIECES = 500_000
AT_ONCE = 1 << 16
MAGIC = b"PFOR1\0\0\0"
_INDEX = np.dtype([("offset", "<u8"), ("low", "<u4"), ("n", "<u2"), ("width", "u1"), ("pad", "u1"),
                   ("exceptions", "<u4")])
_U = np.uint64
_SIGNS = ".,;:!?|"
_IS_SIGN = np.zeros(256, bool)
_IS_SIGN[list(_SIGNS.encode())] = True


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of a multiple of 64 values below 2^width, as ``width`` words for each 64."""
    groups = values.reshape(-1, 64).astype(np.uint64)
    words = np.zeros((len(groups), width), np.uint64)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        words[:, word] |= groups[:, i] << _U(shift)
        if shift + width > 64:
            words[:, word + 1] |= groups[:, i] >> _U(64 - shift)
    return words


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    groups = words.reshape(-1, width) if width else words
    out = np.zeros((len(groups), 64), np.uint64)
    mask = _U((1 << width) - 1)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        part = groups[:, word] >> _U(shift)
        if shift + width > 64:
            part = part | groups[:, word + 1] << _U(64 - shift)
        out[:, i] = part & mask
    return out


def encode_blocks(ids: np.ndarray, block: int = BLOCK, covered: float = COVERED
                  ) -> tuple[bytes, np.ndarray]:
    """The bytes of all blocks of ``ids`` (uint32) and their index, offsets from 0."""
    n = len(ids)
    count = -(-n // block)
    index = np.zeros(count, _INDEX)
    if not n:
        return b"", index
    starts = np.arange(count) * block
    sizes = np.minimum(starts + block, n) - starts
    low = np.minimum.reduceat(ids, starts)
    rows = np.zeros(count * block, np.uint32)
    rows[:n] = ids - np.repeat(low, sizes)
    rows = rows.reshape(count, block)
    bits = np.zeros(rows.shape, np.uint8)
    np.copyto(bits, np.frexp(rows.astype(np.float64))[1], casting="unsafe")
    least = np.sort(bits, axis=1)[np.arange(count), block - 1 - (sizes * (1 - covered)).astype(int)]
    over = bits > least[:, None]
    index["low"], index["n"], index["width"] = low, sizes, least
    index["exceptions"] = over.sum(axis=1)
    words_per = (-(-sizes // 64) * least.astype(np.int64)) * 8
    lengths = words_per + 6 * index["exceptions"].astype(np.int64)
    offsets = np.r_[0, np.cumsum(lengths)]
    index["offset"] = offsets[:-1]
    out = np.zeros(int(offsets[-1]), np.uint8)
    packed_rows = np.where(over, 0, rows)
    for width in np.unique(least).tolist():
        members = np.flatnonzero(least == width)
        packed = _pack(packed_rows[members], width).reshape(len(members), block // 64 * width)
        for row, words in zip(members, packed):
            out[offsets[row]:offsets[row] + words_per[row]] = (
                words[:words_per[row] // 8].astype("<u8").view(np.uint8))
    for row in np.flatnonzero(index["exceptions"]):
        places = np.flatnonzero(over[row])
        tail = places.astype("<u2").tobytes() + rows[row, places].astype("<u4").tobytes()
        begin = offsets[row] + words_per[row]
        out[begin:begin + len(tail)] = np.frombuffer(tail, np.uint8)
    return out.tobytes(), index


def decode_blocks(data: bytes, index: np.ndarray, base: int, block: int = BLOCK) -> np.ndarray:
    """Ids of the index's blocks; ``data`` begins at byte ``base`` of the file."""
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros((len(index), block), np.uint32)
    offsets = index["offset"].astype(np.int64) - base
    groups = -(-index["n"].astype(np.int64) // 64)
    for width in np.unique(index["width"]).tolist():
        rows = np.flatnonzero(index["width"] == width)
        words = np.zeros((len(rows), block // 64 * width), "<u8")
        for i, row in enumerate(rows):
            size = groups[row] * width * 8
            words[i, :size // 8] = raw[offsets[row]:offsets[row] + size].view("<u8")
        out[rows] = _unpack(words, width).reshape(-1, block) if width else 0
    for row in np.flatnonzero(index["exceptions"]):
        count = int(index["exceptions"][row])
        begin = offsets[row] + groups[row] * int(index["width"][row]) * 8
        places = raw[begin:begin + 2 * count].view("<u2")
        out[row, places] = np.frombuffer(raw[begin + 2 * count:begin + 6 * count].tobytes(), "<u4")
    out += index["low"][:, None].astype(np.uint32)
    inside = np.arange(block)[None, :] < index["n"][:, None]
    return out[inside]


class Encoder:
    """A byte-level tokenizer file's ids of whole texts.

    Texts are cut into pieces where the tokenizer's own pre-tokenization cuts too: before a
    single space or line end between two characters that are none, and between a letter and a
    sign. Equal pieces are found by a hash in numpy. Ids of pieces that occurred lately are
    kept, up to twice ``KNOWN_PIECES``. The others are encoded one after the other in joined
    texts, and parted again by the tokens' bytes. Texts that hold an added token's string go
    through the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        # A token of a byte-level vocabulary is spelled with one character per byte.
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)

    def _ids(self, text: str) -> np.ndarray:
        # The way without offsets, which nobody asks for here.
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found[0].ids, "<u4")

    def _learn(self, pieces: list[bytes]) -> None:
        held, size, known, before = [], 0, self.known, self.before
        for piece in pieces:
            if piece in known:
                continue
            found = before.get(piece)
            if found is not None:
                known[piece] = found
                continue
            first, last = piece[0], piece[-1]
            if last >= 0x80:
                solid = not piece.decode()[-1].isspace()
            else:
                solid = 0x20 < last < 0x7F
            if solid and (first == 0x20 or first == 0x0A):
                held.append(piece)
                size += len(piece)
            elif solid and first < 0x80 and _IS_SIGN[first]:
                held += [b" a", piece]  # a sign is parted from the letter before it
                size += len(piece) + 2
            else:
                known[piece] = self._ids(piece.decode()).tobytes()
            if size > AT_ONCE:
                self._learn_joined(held)
                held, size = [], 0
        if held:
            self._learn_joined(held)

    def _learn_joined(self, pieces: list[bytes]) -> None:
        ids = self._ids(b"".join(pieces).decode())
        ends = np.cumsum(self.bytes_of[ids])
        lengths = np.cumsum(list(map(len, pieces)))
        cuts = np.searchsorted(ends, lengths) + 1
        if not (ends[cuts - 1] == lengths).all():
            raise ValueError("a token reaches over a cut: no byte-level tokenizer of this kind")
        raw, cuts = ids.tobytes(), (4 * cuts).tolist()
        self.known.update(zip(pieces, [raw[a:b] for a, b in zip([0, *cuts], cuts)]))

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces begin. Characters beyond Latin letters are taken for white space."""
        plain = (data > 0x20) & (data < 0x7F)
        before, after = plain.copy(), plain | (data == 0xC3)
        before[1:] |= data[:-1] == 0xC3
        begins = np.zeros(len(data), bool)
        begins[1:-1] = ((data[1:-1] == 0x20) | (data[1:-1] == 0x0A)) & before[:-2] & after[2:]
        begins[1:] |= (data[:-1] >= ord("a")) & (data[:-1] <= ord("z")) & _IS_SIGN[data[1:]]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(begins)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts one after the other, and the number of each text's."""
        if len(self.known) > KNOWN_PIECES:
            self.known, self.before = {}, self.known
        data, offsets = text_bytes(column)
        starts = self._pieces(data, offsets)
        ends = np.r_[starts[1:], len(data)]
        _, first, which = np.unique(run_hashes(data, starts, ends), return_index=True,
                                    return_inverse=True)
        raw = data.tobytes()
        pieces = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        self._learn(pieces)
        found = list(map(self.known.__getitem__, pieces))
        lengths = np.array(list(map(len, found)), np.int64) // 4
        counts = lengths[which]
        total = np.r_[0, np.cumsum(counts)]
        place = np.repeat((np.cumsum(lengths) - lengths)[which] - total[:-1], counts)
        ids = np.frombuffer(b"".join(found), "<u4")[place + np.arange(total[-1])]
        cuts = total[np.searchsorted(starts, offsets)]
        if self.added is None or not self.added.search(raw.decode()):
            return ids, np.diff(cuts)
        parts = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
        for i, text in enumerate(column.to_pylist()):
            if text and self.added.search(text):
                parts[i] = self._ids(text)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """A file's encoder, built once in a Python worker; tasks share the pieces it knows."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class _File:
    """A file being written; blocks that are complete go out at once."""

    def __init__(self, folder: str, block: int):
        self.fs, root = pa.fs.FileSystem.from_uri(folder)
        self.name = f"ids-{uuid.uuid4().hex}.pfor"
        self.fs.create_dir(root, recursive=True)
        self.out = self.fs.open_output_stream(posixpath.join(root, self.name))
        self.out.write(MAGIC)
        self.at, self.total, self.block = len(MAGIC), 0, block
        self.rest, self.index = np.zeros(0, np.uint32), []

    def add(self, ids: np.ndarray, last: bool = False) -> None:
        self.total += 0 if last else len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) if last else len(ids) // self.block * self.block
        data, index = encode_blocks(ids[:whole], self.block)
        index["offset"] += self.at
        self.out.write(data)
        self.at += len(data)
        self.index.append(index)
        self.rest = ids[whole:]

    def close(self) -> None:
        self.add(np.zeros(0, np.uint32), last=True)
        index = np.concatenate(self.index)
        self.out.write(index.tobytes())
        self.out.write(np.array([len(index), self.total, self.at], "<u8").tobytes())
        self.out.close()


def _write(folder: str, tokenizer: str, end_id: int, block: int, file_bytes: int):
    def run(batches):
        encoder = encoder_of(tokenizer)
        file, number = None, 0
        for batch in batches:
            texts = batch.column(1)
            for begin, end in slices(texts):
                if file is not None and file.at > file_bytes:
                    file.close()
                    file, number = None, 0
                file = file or _File(folder, block)
                ids, sizes = encoder.encode(texts.slice(begin, end - begin))
                ends = np.cumsum(sizes)
                file.add(np.insert(ids, ends, np.uint32(end_id)))
                first = file.total - int(ends[-1]) - len(sizes)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(begin, end - begin),
                    pa.array([file.name] * len(sizes)),
                    pa.array(np.arange(number, number + len(sizes)), pa.int64()),
                    pa.array(first + np.r_[0, (ends + np.arange(1, len(ends) + 1))[:-1]]),
                    pa.array(sizes + 1, pa.int64())],
                    ["doc_id", "file", "row", "first", "n_tokens"])
                number += len(sizes)
        if file is not None:
            file.close()
    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID,
                 block: int = BLOCK, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes all ids below ``folder`` and returns the table of documents, as committed.

    Per row of ``docs``: ``doc_id, file, row`` (place in the file), ``first`` (ids of the file
    before it), ``n_tokens`` (with the end id) and ``start`` (ids of all files' documents before
    it). Documents are in ascending doc_id order, a null id first; repeated rows are written
    each. A null text is empty: its end id alone. Other columns are ignored; an empty table
    writes no file. ``folder`` must be one that all executors reach.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first())
    table = written(ordered.mapInArrow(
        _write(folder, tokenizer, end_id, block, file_bytes),
        "doc_id long, file string, row long, first long, n_tokens long"), "token-documents")
    files = table.groupBy("file").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
        F.sum("n_tokens").alias("ids"))
    before = Window.orderBy(F.col("low").asc_nulls_first(), F.col("high").asc_nulls_first(), "file")
    files = files.select("file", (F.sum("ids").over(before) - F.col("ids")).alias("before"))
    return table.join(files, "file").withColumn("start", F.col("before") + F.col("first")).drop(
        "before")


def read_index(fs: pa.fs.FileSystem, path: str) -> tuple[pa.NativeFile, np.ndarray]:
    file = fs.open_input_file(path)
    size = file.size()
    count, _, at = np.frombuffer(file.read_at(24, size - 24), "<u8").astype(np.int64)
    return file, np.frombuffer(file.read_at(size - 24 - at, at), _INDEX)[:count]


def ids_of_file(fs: pa.fs.FileSystem, path: str, firsts: np.ndarray, counts: np.ndarray,
                block: int = BLOCK) -> Iterator[np.ndarray]:
    """The ids of documents of a file, by their first place and number; reads only their blocks."""
    file, index = read_index(fs, path)
    begin = 0
    while begin < len(firsts):  # documents of about a million ids at once
        end = begin + 1
        while end < len(firsts) and firsts[end] + counts[end] - firsts[begin] < 1 << 20:
            end += 1
        a = int(firsts[begin]) // block
        b = -(-int(firsts[end - 1] + counts[end - 1]) // block)
        at = int(index["offset"][a])
        stop = int(index["offset"][b]) if b < len(index) else file.size() - 24 - index.nbytes
        ids = decode_blocks(file.read_at(stop - at, at), index[a:b], at, block)
        for i in range(begin, end):
            place = int(firsts[i]) - a * block
            yield ids[place:place + int(counts[i])]
        begin = end
    file.close()


def _read(folder: str, block: int):
    def run(key, table):
        fs, root = pa.fs.FileSystem.from_uri(folder)
        table = table.sort_by("first")
        checks = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in ids_of_file(
            fs, posixpath.join(root, key[0].as_py()), table.column("first").to_numpy(),
            table.column("n_tokens").to_numpy(), block)]
        return pa.table({"doc_id": table.column("doc_id"), "start": table.column("start"),
                         "n_tokens": table.column("n_tokens"),
                         "ids_crc32": pa.array(checks, pa.int64())})
    return run


def read_checks(table: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files that ``write_tokens`` named."""
    return table.select("file", "doc_id", "first", "start", "n_tokens").groupBy(
        "file").applyInArrow(_read(folder, block),
                             "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_folder(docs: DataFrame) -> str:
    """A fresh folder for files, with a scheme, in the shared folder."""
    path = work_path(docs.sparkSession, "tokens")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
