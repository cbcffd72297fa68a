"""Each stage of the pipeline against plain Python on what the stage before it kept."""

import re

import brute
import public_tokenizers
import pytest

import corpus_pipeline
from paramloom.llm import mixing, quality
from paramloom.llm.tables import documents, written


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Documents, and what each stage made of them."""
    made = [documents(spark, sf_dir)]
    for name, stage in corpus_pipeline.STAGES:
        made.append(written(stage(spark, made[-1], sf_dir), "test-stage"))
    return made


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns_stay(stages):
    for made in stages[1:-1]:
        assert made.columns == stages[0].columns
    assert stages[-1].columns == stages[0].columns + ["n_ids", "ids"]


def test_quality_keeps_what_the_rules_keep(spark, sf_dir, stages):
    docs = stages[0]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(quality.sample_of(labels, docs, "quality"))
    kept = {r["doc_id"] for r in quality.judge(docs, model).where("kept").collect()}
    assert set(rows(stages[1])) == kept
    assert not any(brute.quality_counts(t)[-1] for t in rows(stages[1]).values())


def test_exact_copies_go(stages):
    first = {}
    for i, text in sorted(rows(stages[1]).items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), i)
    assert set(rows(stages[2])) == set(first.values())


def test_near_copies_go(stages):
    found = brute.near_duplicates(list(rows(stages[2]).items()), 80)
    assert set(rows(stages[3])) == {i for i, (_, _, kept) in found.items() if kept}


def test_mixture_is_drawn(stages):
    want = sorted(i for r in mixing.mixed(stages[3]).collect() for i in [r["doc_id"]] * r["copies"])
    got = sorted(r["doc_id"] for r in stages[4].collect())
    assert got == want
    assert 0 < len(set(got)) < stages[3].count()


def test_ids_equal_the_library(stages):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in stages[5].collect():
        assert r["ids"] == library.encode(r["text"] or "")
        assert r["n_ids"] == len(r["ids"])


def test_odd_rows_and_other_columns(spark, sf_dir):
    """Null ids and texts, repeated rows, and columns named like the operators' own."""
    body = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(None, body, None, None, "x", 1), (7, body + " end", "en", "src1", None, 2),
         (7, body + " end", "en", "src1", None, 2), (8, None, "en", "src1", "y", 3)],
        "doc_id long, text string, lang string, source string, kept string, component_id int")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        if name != "source mixing":
            assert made.count() <= 4
        assert {r["doc_id"] for r in made.collect()} <= {None, 7, 8}
        assert made.columns[:6] == docs.columns
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.count() == 0
