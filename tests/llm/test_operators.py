"""The operators against plain Python, with nulls, empty, long, tied, repeated and extra rows."""

import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from paramloom.llm import (chat, components, exact, licenses, mixing, near, pieces, pseudo_lm,
                           quality, substrings, token_blocks)

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
SCHEMA = "doc_id long, text string, lang string, source string, kept boolean, component_id string"


def some_words(seed, n):
    rng = random.Random(seed)
    return [f"{rng.choice(WORDS)}{rng.randrange(50)}" for _ in range(n)]


def texts():
    """(doc_id, text): copies, near copies, shared passages, odd and long texts."""
    base, passage = some_words(1, 300), some_words(2, 60)
    rows = [(0, " ".join(base)), (1, "  ".join(base)), (2, " ".join(base).upper())]
    for i in range(3, 40):  # a group of near copies
        edited = list(base)
        edited[i * 7] = f"edit{i}"
        rows.append((i, " ".join(edited)))
    for i in range(40, 80):  # one passage in many texts
        own = some_words(100 + i, 80)
        rows.append((i, " ".join(own[:40] + passage + own[40:])))
    rows += [(80, None), (81, ""), (82, " \t\n"), (83, "one two three"), (84, "one two three"),
             (85, "one  two\nthree"), (86, "line of words\nline of words\nother | | #\n\nother | | #"),
             (87, " ".join(some_words(5, 20_000))), (88, " ".join(["same"] * 500)),
             (89, "naïve café 中文 日本 🙂 ▁ x"), (90, "a" * 50_000), (91, "   x \x1c y"),
             (92, "<|endoftext|> in a text"), (93, "one two three four five six seven"),
             (94, "one two three four five six seven eight nine ten eleven"),
             (95, "zero one two three four five six seven eight nine ten eleven")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}", True, "x") for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows without doc_id and repeated rows."""
    body = " ".join(some_words(9, 60))
    return spark.createDataFrame(
        [(None, body, None, None, None, None), (None, None, None, None, None, None),
         (5, body, "en", "src1", None, None), (5, body, "en", "src1", None, None),
         (6, body + " end", "en", "src1", None, None)], SCHEMA)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# near duplicates

def test_near_duplicates_equal_brute_force(docs):
    got = by_id(near.near_duplicates(docs), "n_shingles", "component_id", "kept")
    assert got == brute.near_duplicates(texts())


def test_near_duplicates_in_lists_longer_than_the_small_ones(docs, monkeypatch):
    monkeypatch.setattr(near, "SMALL_LIST", 3)
    got = by_id(near.near_duplicates(docs), "n_shingles", "component_id", "kept")
    assert got == brute.near_duplicates(texts())


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_of_small_sets(spark, percent):
    """Sets with exactly as many odd shingles as the threshold allows, or one more."""
    rows, rng = [], random.Random(percent)
    for n in (*range(4, 24), 27, 30, 40, 55):
        for i in range(6):
            words = some_words(1000 * n + i, n + 4)
            odd = max(1, n * (100 - percent) // 100 + rng.randrange(2))
            begin = len(rows)
            rows.append((begin, " ".join(words)))
            if i % 3 == 0:
                other = words[odd:]
            elif i % 3 == 1:
                other = words[:-odd]
            else:
                other = some_words(77_000 + begin, odd) + words
            rows.append((begin + 1, " ".join(other)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = by_id(near.near_duplicates(df, percent), "n_shingles", "component_id", "kept")
    want = brute.near_duplicates(rows, percent)
    assert got == want
    assert 20 < sum(not kept for _, _, kept in want.values()) < len(rows) // 2


def test_near_duplicates_at_eighty_equal_brute_force(spark):
    """Large sets just above and below the threshold, and families around a common passage."""
    rows, rng = [], random.Random(80)
    passage = some_words(5, 60)
    for i in range(60):
        words = some_words(20_000 + i, 400)
        rows.append((2 * i, " ".join(words + passage)))
        other = list(words)
        for at in range(3, 400, rng.choice([44, 48, 52, 60])):  # each change makes five odd shingles
            other[at] = f"odd{i}x{at}"
        rows.append((2 * i + 1, " ".join(other + passage)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = by_id(near.near_duplicates(df, 80), "n_shingles", "component_id", "kept")
    want = brute.near_duplicates(rows, 80)
    assert got == want
    assert want != brute.near_duplicates(rows, 85)
    with pytest.raises(ValueError):
        near.near_duplicates(df, 79)


@pytest.mark.parametrize("small_list", [1, 3])
def test_near_duplicates_whose_runs_all_lie_in_long_lists(spark, monkeypatch, small_list):
    """Before each pair stand longer texts that hold the pair's and are similar to neither."""
    monkeypatch.setattr(near, "SMALL_LIST", small_list)
    rows, rng = [], random.Random(3)
    for family, n in enumerate([6, 7, 7, 8, 8, 10, 11, 12, 14, 14, 20, 20, 27, 34, 40] * 2):
        words = some_words(3000 + family, n + 4)
        more, begin = n * 2 // 5 + 1, len(rows)
        for other in range(6):
            odd = some_words(4000 + 10 * family + other, more)
            cut = rng.randrange(more + 1)
            rows.append((begin + other, " ".join(odd[:cut] + words + odd[cut:])))
        gone = max(1, n * 15 // 100)
        rows.append((begin + 6, " ".join(words)))
        rows.append((begin + 7, " ".join(words[gone:] if family % 2 else words[:-gone])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(near.near_duplicates(df), "n_shingles", "component_id", "kept")
    expected = brute.near_duplicates(rows)
    assert sum(not kept for _, _, kept in expected.values()) > 20
    assert got == expected


def test_rare_values_lose_no_pair():
    """Any two sets that reach the threshold share a listed value that is early in the smaller."""
    import numpy as np
    import pyarrow as pa
    rng, scale = np.random.default_rng(1), np.zeros(near.BUCKETS, np.uint8)
    for n in range(6, 90):
        for m in range(n, n * 100 // 85 + 1):
            common = -(-85 * (n + m) // 185)
            if common > n:
                continue
            values = rng.integers(-2**63, 2**63, n + m - common)
            sets = [values[:n], np.r_[values[:common], values[n:]]]
            batch = pa.RecordBatch.from_arrays(
                [pa.array([0, 1]), pa.array([n, m]), pa.array(sets, pa.list_(pa.int64()))],
                ["node", "n", "shingles"])
            listed = pa.Table.from_batches(near._prefixes(scale, 85)([batch])).to_pylist()
            early = {r["key"] for r in listed
                     if r["node"] == 0 and r["pos"] < n + 1 - -(-170 * n // 185)}
            assert early & {r["key"] for r in listed if r["node"] == 1}


def test_near_duplicates_of_odd_rows(odd, empty):
    got = near.near_duplicates(odd).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [
        (0, 0, True), (0, 0, True), (5, 5, True), (5, 5, True), (6, 5, False)]
    assert near.near_duplicates(empty).count() == 0


def test_components_of_a_long_path(spark):
    path = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["component"] for r in components.components(path).collect()} == {0}


# exact duplicates

def test_exact_duplicates_equal_brute_force(docs, monkeypatch):
    import hashlib
    import re
    groups = {}
    for i, t in texts():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = {i: (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())
            for t, ids in groups.items() for i in ids}
    assert by_id(exact.exact_duplicates(docs), "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact.keep_first(docs).columns == docs.columns
    assert {r["doc_id"] for r in exact.keep_first(docs).collect()} == {
        i for i, w in want.items() if w[2]}


def test_heavy_hitters_are_found_and_exact(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    heavy = exact.heavy_hitters(exact.digests(rows)).collect()
    assert (0, 1000) in [(r["keep_id"], r["group_size"]) for r in heavy]
    assert exact.exact_duplicates(rows).where("kept").count() == 2001


def test_exact_duplicates_of_odd_rows(odd, empty):
    got = exact.exact_duplicates(odd).collect()
    assert sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in got) == [
        (0, 0, 1, True), (0, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True), (6, 6, 1, True)]
    assert exact.exact_duplicates(empty).count() == 0


# repeated passages

@pytest.mark.parametrize("block_bytes", [2 << 20, 3_000])
def test_repeats_equal_brute_force(docs, monkeypatch, block_bytes):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block_bytes)
    got = by_id(substrings.remove_repeats(docs), "n_words", "n_removed", "kept_text")
    assert got == brute.without_repeats(texts())


def test_repeats_of_odd_rows(odd, empty):
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["removed"])
           for r in substrings.remove_repeats(odd).collect()]
    got.sort(key=lambda r: (r[0] or 0, r[1]))
    assert got == [(None, 0, 0, []), (None, 60, 0, []), (5, 60, 60, [(0, 60)]),
                   (5, 60, 60, [(0, 60)]), (6, 61, 60, [(0, 60)])]
    assert substrings.remove_repeats(empty).count() == 0


# quality

def test_quality_counts_equal_brute_force(docs):
    model = quality.Model(np.zeros((3, quality.BUCKETS), np.float32), 0.0, 1.0, 20.0)
    got = by_id(quality.judge(docs, model), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                "n_repeat_words", "base_failed")
    assert got == {i: brute.quality_counts(t) for i, t in texts()}
    assert quality.keep_good(docs, model).columns == docs.columns


def test_quality_classifier_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fitted = labels.where("doc_id % 2 = 0")
    model = quality.fit(quality.sample_of(fitted, docs, "quality"))
    rows = quality.judge(docs, model).where("not base_failed").join(
        labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "kept").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in rows) >= 0.97 * len(rows) > 0


def test_quality_model_hangs_on_the_rows_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    models = [quality.fit(quality.sample_of(labels, d, "quality"))
              for d in (docs, docs.repartition(5).union(docs.limit(40)))]
    assert models[0].slope == models[1].slope and models[0].bias == models[1].bias
    assert (models[0].weights == models[1].weights).all()


def test_quality_of_odd_rows(spark, odd):
    model = quality.Model(np.zeros((3, quality.BUCKETS), np.float32), 0.0, 1.0, 20.0)
    bare = spark.createDataFrame([(1, None), (None, ""), (1, None)], "doc_id long, text string")
    assert [tuple(r)[1:7] for r in quality.judge(bare.coalesce(1), model).collect()] == [
        (0, 0, 0, 0, 0, True)] * 3
    assert quality.keep_good(bare.coalesce(1), model).count() == 0
    assert quality.judge(odd.coalesce(1), model).count() == 5


def test_quality_without_labels(docs, empty):
    model = quality.fit(docs.limit(0).select(F.lit(1).alias("label"), "text"))
    assert quality.judge(docs, model).where("kept").count() > 50
    assert quality.judge(empty, model).count() == 0


# token files

def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 5000):
        for top in (1, 2, 50_000, 2**32 - 1):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            ids[::37] = 2**32 - 1
            data, index = token_blocks.encode_blocks(ids)
            assert (token_blocks.decode_blocks(data, index, 0) == ids).all()


def test_tokens_equal_the_library(docs, odd, empty, tmp_path):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, start, want = Tokenizer.from_file(path), 0, {}
    for i, t in texts():
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    folder = f"file://{tmp_path}/tokens"
    table = token_blocks.write_tokens(docs, folder, path)
    assert by_id(token_blocks.read_checks(table, folder), "start", "n_tokens", "ids_crc32") == want
    got = token_blocks.read_checks(token_blocks.write_tokens(odd, folder, path), folder).collect()
    assert sorted(r["start"] for r in got)[0] == 0 and len(got) == 5
    none = token_blocks.write_tokens(empty, folder, path)
    assert token_blocks.read_checks(none, folder).count() == 0


def test_tokens_of_many_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    folder = f"file://{tmp_path}/tokens"
    table = token_blocks.write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"),
                                      file_bytes=100_000)
    assert table.select("file").distinct().count() > 1
    rows = sorted(token_blocks.read_checks(table, folder).collect())
    assert len(rows) == docs.count()
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]


# mixing

def test_raking_meets_the_targets():
    rng = random.Random(4)
    cells = {(a, b): float(rng.randrange(1, 100)) for a in "xyz" for b in "pq"}
    targets = {"one": {"x": 0.5, "y": 0.3, "z": 0.2}, "two": {"p": 0.9, "q": 0.1}}
    factors = mixing.rake(cells, ["one", "two"], targets, 50)
    total = sum(cells.values())
    for i, goals in enumerate(targets.values()):
        for value, goal in goals.items():
            mass = sum(cells[k] * factors[k] for k in cells if k[i] == value)
            assert mass == pytest.approx(goal * total, rel=1e-6)


def test_mixing_of_all_rows(docs, odd, empty):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == len(texts())
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {
        i: len(brute.words(t)) for i, t in texts()}
    assert {r["lang"] for r in rows} == {"en", "other"}
    assert all(r["weight"] - 1 < r["copies"] < r["weight"] + 1 for r in rows)
    drawn = sorted(i for r in rows for i in [r["doc_id"]] * r["copies"])
    sampled = mixing.sample(docs)
    assert sampled.columns == docs.columns
    assert sorted(r["doc_id"] for r in sampled.collect()) == drawn
    plan = sampled._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    strange = [(r["doc_id"], r["source"], r["n_tokens"], r["kept"], r["copies"] > 0)
               for r in mixing.mixed(odd).collect()]
    assert sorted((i or 0, s, n) for i, s, n, *_ in strange) == [
        (0, "other", 0), (0, "other", 60), (5, "src1", 60), (5, "src1", 60), (6, "src1", 61)]
    assert all(kept == some for *_, kept, some in strange)
    assert mixing.mixed(empty).count() == 0 and mixing.sample(empty).count() == 0


def test_drawn_marginals_meet_the_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixing.mixed(docs).groupBy(*mixing.TARGETS).agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("n"), F.sum("n_tokens").alias("all")).collect()
    total = sum(r["n"] for r in rows)
    assert total / sum(r["all"] for r in rows) == pytest.approx(mixing.SHARE, abs=0.02)
    for dim, targets in mixing.TARGETS.items():
        there = {r[dim] for r in rows if r["all"]}
        whole = sum(w for v, w in targets.items() if v in there)
        for value in there:
            share = sum(r["n"] for r in rows if r[dim] == value) / total
            assert share == pytest.approx(targets[value] / whole, abs=0.01), (dim, value)


# pieces

@pytest.fixture(scope="module")
def model_file():
    return public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library(docs, empty, model_file):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=model_file)
    got = by_id(pieces.encoded(docs, model_file), "ids", "n_ids", "round_trip")
    for i, t in texts():
        assert got[i] == (library.encode(t or ""), len(got[i][0]), True)
    back = by_id(pieces.decoded(pieces.with_ids(docs, model_file), model_file), "text")
    assert back == {i: ((t or "").replace("▁", " "),) for i, t in texts()}
    assert pieces.encoded(empty, model_file).count() == 0
    assert pieces.with_ids(docs, model_file).columns == docs.columns + ["n_ids", "ids"]


def test_pieces_of_random_texts(model_file):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=model_file)
    machine, rng = pieces.transducer(model_file), random.Random(8)
    letters = "abcdefghiaeiouthe   \n\t.,ABé中文日本😀ñ▁0123'\"-=(){}<>/"
    for _ in range(500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        ids = machine.encode(text)
        assert ids.tolist() == library.encode(text)
        assert machine.decode(ids) == library.decode(ids.tolist())


# language model

def test_gradients_equal_differences(docs):
    import pyarrow as pa
    from paramloom.llm.words import words_of
    network = pseudo_lm.new_network()
    ids, places = pseudo_lm.stream(words_of(pa.array([t for _, t in texts()[40:43]])))
    found = pseudo_lm._gradients(network, ids, places)
    for name, gradient in found.items():
        at = np.argmax(np.abs(gradient))
        sides = []
        for step in (1e-3, -1e-3):
            moved = {k: v.astype(float) for k, v in network.items()}
            moved[name].ravel()[at] += step
            sides.append(-pseudo_lm.log_probabilities(moved, ids, places).mean())
        assert gradient.ravel()[at] == pytest.approx((sides[0] - sides[1]) / 2e-3, rel=1e-2)


def test_scores_prefer_what_was_learned(spark, docs, odd, empty):
    train = spark.createDataFrame(
        [(i, " ".join(["red", "green", "blue", "white"] * 200)) for i in range(60)],
        "doc_id long, text string").repartition(2)
    model = pseudo_lm.train(train)
    test = spark.createDataFrame([(1, "red green blue white red green blue white"),
                                  (2, "white white red red stone stone green stone"), (3, None)],
                                 "doc_id long, text string")
    got = by_id(pseudo_lm.scores(test, model), "n_tokens", "log_likelihood", "per_token")
    assert got[1][2] > got[2][2] + 1
    assert got[3] == (0, 0.0, None)
    assert pseudo_lm.scores(odd, model).count() == 5
    assert pseudo_lm.scores(docs, pseudo_lm.train(empty)).count() == len(texts())


def in_blocks(monkeypatch, size):
    monkeypatch.setattr(pseudo_lm, "BLOCK_BYTES", size)


def test_scores_equal_a_plain_loop(spark, docs, monkeypatch):
    """Blocks, rounds, averages, counts and scores as one program would get them."""
    import pyarrow as pa
    import xxhash
    from paramloom.llm.words import words_of
    in_blocks(monkeypatch, 20_000)
    rows = [(i, t) for i, t in texts() if t is not None]
    rows += [(None, "one two three"), (3, rows[0][1]), (5, ""), (5, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    size = sum(len(t.encode()) + pseudo_lm.ROW_BYTES for _, t in rows)
    number = -(-size // 20_000)
    key = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
    signed = lambda h: h - 2**64 if h >= 2**63 else h
    blocks = {}
    for i, t in rows:
        h = 42 if i is None else xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(t.encode(), h)
        blocks.setdefault(signed(h) % number, []).append((signed(key(t)), i, t))
    assert len(blocks) > 3
    streams = {}
    for b, part in blocks.items():
        part.sort(key=lambda r: (r[0], r[1] is None, r[1]))
        streams[b] = words_of(pa.array([t for _, _, t in part]))
    network = pseudo_lm.new_network()
    seen = {k: np.full_like(v, 1e-6) for k, v in network.items()}
    for number_of_round in range(number.bit_length()):
        done = []
        for b in sorted(streams):
            if b % number.bit_length() == number_of_round and len(streams[b].hash):
                descent = pseudo_lm.Descent(network, seen)
                descent.learn(*pseudo_lm.stream(streams[b]))
                done.append(descent)
        total = sum(d.words for d in done)
        if done:
            network, seen = ({k: sum(d.words * getattr(d, part)[k].astype(float) for d in done) / total
                              for k in network} for part in ("network", "seen"))
            network, seen = ({k: v.astype(np.float32) for k, v in p.items()} for p in (network, seen))
    counts = {}
    for words in streams.values():
        for h in words.hash.tolist():
            counts[h] = counts.get(h, 0) + 1
    every, distinct = np.zeros(4096), np.zeros(4096)
    for h, n in counts.items():
        every[h >> 52] += n
        distinct[h >> 52] += 1
    expected = []
    for b, part in blocks.items():
        words = streams[b]
        logs = (pseudo_lm.log_probabilities(network, *pseudo_lm.stream(words))
                if len(words.hash) else np.zeros(0))
        shares = [np.log(counts[h] / (every[h >> 52] + distinct[h >> 52]))
                  for h in words.hash.tolist()]
        for at, (_, i, _) in enumerate(part):
            run = slice(words.first[at], words.first[at + 1])
            expected.append((-1 if i is None else i, len(logs[run]),
                             float(logs[run].sum() + sum(shares[run]))))
    for layout in (table.repartition(1), table.repartition(7)):
        got = [(-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["log_likelihood"])
               for r in pseudo_lm.scores(layout, pseudo_lm.train(layout)).collect()]
        assert [r[:2] for r in sorted(got)] == [r[:2] for r in sorted(expected)]
        assert [r[2] for r in sorted(got)] == pytest.approx([r[2] for r in sorted(expected)], rel=1e-5)


def test_scores_beat_frequencies_on_other_texts(spark, sf_dir):
    """Held-out texts are likelier than by the words' frequencies alone."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = pseudo_lm.train(table.where("doc_id % 5 <> 0"))
    plain = pseudo_lm.Model({k: np.zeros_like(v) for k, v in model.network.items()},
                            model.vocabulary, model.totals)
    every = model.totals[:, 0].sum()
    rows = np.maximum(model.totals[:, 0], 0.5).reshape(64, 64)
    plain.network["rows_bias"][:] = np.log(rows.sum(axis=1) / every)
    plain.network["places_bias"][:] = np.log(rows / rows.sum(axis=1, keepdims=True))
    held = table.where("doc_id % 5 = 0")
    trained, frequencies = (pseudo_lm.scores(held, m).groupBy().sum("log_likelihood").first()[0]
                            for m in (model, plain))
    assert trained > frequencies


def test_hot_words_are_looked_up_like_others(spark, docs, monkeypatch):
    in_blocks(monkeypatch, 20_000)
    model = pseudo_lm.train(docs)
    usual = by_id(pseudo_lm.scores(docs, model), "n_tokens", "log_likelihood")
    monkeypatch.setattr(pseudo_lm, "HOT_WORDS", 10**9)
    assert by_id(pseudo_lm.scores(docs, model), "n_tokens", "log_likelihood") == usual
    monkeypatch.setattr(pseudo_lm, "HOT_WORDS", 1)
    assert by_id(pseudo_lm.scores(docs, model), "n_tokens", "log_likelihood") == usual


def test_calls_and_results_meet_in_a_hash_join(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    plan = chat.link(*chat.calls_of(table))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan


def test_probabilities_sum_to_one():
    network = pseudo_lm.new_network()
    ids = np.full(12, 7)
    total = 0.0
    for bucket in range(pseudo_lm.SIDE ** 2):
        ids[5] = bucket
        total += float(np.exp(pseudo_lm.log_probabilities(network, ids, np.array([5]))[0]))
    assert total == pytest.approx(1, rel=1e-3)


# licences

def wrapped(text, width=60, sign="# "):
    import textwrap
    return "\n".join(sign + line for line in textwrap.wrap(text, width))


#: Whole notices as they stand in files, and what they are.
NOTICES = [
    ("Copyright (c) 2020 Jane Doe\n\nPermission is hereby granted, free of charge, to any person "
     "obtaining a copy\nof this software and associated documentation files (the \"Software\"), to "
     "deal\nin the Software without restriction, including without limitation the rights\nto use, "
     "copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and "
     "to permit persons to whom the Software is\nfurnished to do so, subject to the following "
     "conditions:", {"MIT"}),
    (wrapped("This program is free software: you can redistribute it and/or modify it under the "
             "terms of the GNU General Public License as published by the Free Software "
             "Foundation, either version 3 of the License, or (at your option) any later version."),
     {"GPL"}),
    (wrapped("This library is free software; you can redistribute it and/or modify it under the "
             "terms of the GNU Lesser General Public License as published by the Free Software "
             "Foundation; either version 2.1 of the License.", 50, " * "), {"LGPL"}),
    (wrapped('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this '
             "file except in compliance with the License. You may obtain a copy of the License at "
             "http://www.apache.org/licenses/LICENSE-2.0", 72, "// "), {"Apache-2.0"}),
    ("ISC License", {"ISC"}), ("SPDX-License-Identifier: MIT", {"MIT"}),
    ("/* SPDX-License-Identifier: GPL-2.0-only */", {"GPL"}),
    ("Licensed under CC BY-NC 4.0.", {"CC-BY-NC"}), ("Licensed under CC BY 4.0.", {"CC-BY"}),
    ("This text is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
     "License.", {"CC-BY-SA"}),
    ("See http://creativecommons.org/licenses/by-nd/4.0/ for the terms.", {"CC-BY-ND"}),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy "
     "of the MPL was not distributed with this\nfile, You can obtain one at "
     "https://mozilla.org/MPL/2.0/.", {"MPL-2.0"}),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted "
     "provided that the following conditions are met:", {"BSD"}),
    ("This is free and unencumbered software released into the public domain.", {"Unlicense"}),
    ("Licensed under the Foo License.", {"unknown"}),
    ("Released under the Hyperion Public License, version 1.0.", {"unknown"}),
    ("He renewed his license in the spring.", set()), ("The copyright office was closed.", set()),
    ("Plain words stand here, nothing else.", set()), ("mit der Version 2.0 kam er", set()),
]


def test_licences_equal_plain_python(spark, empty, odd):
    prose = " ".join(some_words(3, 400))
    rows = [(i, text) for i, (text, _) in enumerate(NOTICES)]
    rows += [(100 + i, f"{prose}\n{text}\n{prose}") for i, (text, _) in enumerate(NOTICES)]
    rows += [(300, None), (301, ""), (302, " \n \n"), (303, " ".join(some_words(3, 5000)) + "\n" +
             NOTICES[7][0] + " " + prose), (304, "\n\n".join(t for t, _ in NOTICES)),
             (305, NOTICES[5][0] + "\nLicensed under the Foo License."), (None, NOTICES[4][0])]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows],
                               "doc_id long, text string, family string, probability double")
    model = licenses.fit()
    found = licenses.scan(df.repartition(3), model).collect()
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["paragraph"], r["family"],
                  round(r["probability"], 4), r["similarity"]) for r in found)
    want = sorted((-1 if i is None else i, p, f, round(v, 4), s) for i, t in rows
                  for p, f, v, s in licenses.scan_one(t, model))
    assert got == want
    families = {}
    for d, _, f, *_ in got:
        families.setdefault(d, set()).add(f)
    for i, (text, expected) in enumerate(NOTICES):
        assert families.get(i, set()) >= expected, text
        assert expected or i not in families, text
        assert families.get(100 + i, set()) == families.get(i, set()) - {"unknown"} or (
            expected == {"unknown"}), text
    assert families[303] == {"CC-BY-NC"} and families[305] == {"MIT"} and families[-1] == {"ISC"}
    assert licenses.scan(empty, model).count() == 0
    twice = spark.createDataFrame([(1, NOTICES[4][0])] * 2, "doc_id long, text string")
    assert [r["family"] for r in licenses.scan(twice, model).collect()] == ["ISC", "ISC"]


def test_windows_without_anchors_are_judged(spark):
    """A notice without any of the anchors is found, also behind long prose of its own paragraph;
    a word of the vocabulary alone, prose, or a line that names no licence is none."""
    notice = ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
              "software, either in source code form or as a compiled binary, for any purpose.")
    assert not set(licenses._tokens(notice)) & set(licenses.ANCHORS)
    prose = "der Hund geht mit der Katze in den Wald "
    texts = [notice, prose * 40 + notice + " " + prose * 40, prose * 40, "mit", "All rights reserved."]
    model = licenses.fit()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = licenses.scan(df, model).collect()
    assert {(r["doc_id"], r["family"]) for r in found} == {
        (0, "Unlicense"), (1, "Unlicense")}
    assert sorted((r["doc_id"], r["family"], r["similarity"]) for r in found) == sorted(
        (i, f, v) for i, t in enumerate(texts) for _, f, _, v in licenses.scan_one(t, model))


def test_planted_licences_are_all_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = licenses.scan(docs, licenses.fit()).select("doc_id", "family").collect()
    planted = {r["doc_id"]: r["text"] for r in docs.where("text rlike '[Ll]icense'").collect()}
    names = {"GNU General": "GPL", "CC BY-NC": "CC-BY-NC", "MIT": "MIT", "Apache": "Apache-2.0"}
    want = {(i, f) for i, t in planted.items() for n, f in names.items() if n in t}
    assert {(r["doc_id"], r["family"]) for r in rows} == want != set()


def test_licence_scan_runs_no_python(docs):
    model = licenses.fit()
    for df in (licenses.scan(docs, model), exact.exact_duplicates(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InArrow" not in plan and "Pandas" not in plan


# chats

def test_calls_are_linked_ordered_and_checked(spark):
    calls = spark.createDataFrame([
        (1, "a", 0, "search", '{"query": "x", "limit": 3}', []),
        (1, "a", 2, "search", '{"query": "later copy"}', []),
        (1, "b", 2, "translate", '{"to": "fr", "text": "é"}', ["a"]),
        (1, "c", 1, "count", '{"unique": 1, "text": "t", "z": 0}', ["b", "a"]),
        (1, "d", 5, "count", "{", ["x"]),
        (2, "a", 0, "search", '["q"]', ["b"]), (2, "b", 1, "nothing", "{}", ["a"]),
        (None, "a", 0, "search", None, None)],
        "conv_id long, call_id string, turn int, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([
        (1, "a", 1, "first"), (1, "a", 3, "second"), (1, "b", 3, None), (9, "a", 0, "lost")],
        "conv_id long, call_id string, turn int, content string")
    rows = {(r["conv_id"], r["call_id"]): r for r in chat.link(calls, results).collect()}
    assert {k: (r["level"], r["status"], r["errors"]) for k, r in rows.items()} == {
        (1, "a"): (0, "linked", []), (1, "b"): (1, "linked", []),
        (1, "c"): (2, "no result", ["unique: no boolean", "z: unknown"]),
        (1, "d"): (0, "missing need", ["arguments: no JSON"]),
        (2, "a"): (None, "circle", ["arguments: no object"]),
        (2, "b"): (None, "circle", ["name: no such tool"]),
        (None, "a"): (None, "no id", ["arguments: no JSON"])}
    assert rows[1, "a"]["record"] == (
        '{"arguments":{"limit":3,"query":"x"},"id":"a","name":"search","needs":[],"result":"first"}')
    assert rows[1, "b"]["record"].startswith('{"arguments":{"text":"é","to":"fr"}')
    assert [r["conv_id"] for r in chat.orphans(calls, results).collect()] == [9]
    assert chat.link(calls.limit(0), results).count() == 0


def test_calls_of_plain_chats(spark, sf_dir):
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = chat.link(*chat.calls_of(chats)).collect()
    assert len(rows) == chats.where("role = 'user'").select("conv_id", "turn").distinct().count()
    level = {(r["conv_id"], r["call_id"]): r["level"] for r in rows}
    assert max(level.values()) >= 1
    assert {r["valid"] for r in rows} == {True, False}
