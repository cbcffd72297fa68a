"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paramloom.llm import (chat, cover_tree, exact, licenses, mixing, near, pieces, prefix_trie,
                           pseudo_lm, quality, repair, substrings, token_blocks)
from paramloom.llm.tables import documents
from paramloom.plans.registry import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir), licenses.fit())


def op2_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = token_blocks.tokens_folder(docs)
    written = token_blocks.write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_blocks.read_checks(written, folder)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.remove_repeats(documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed",
                       F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(*chat.calls_of(table(spark, sf_dir, "conversations")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.fit(quality.sample_of(table(spark, sf_dir, "labels"), docs, "quality"))
    return quality.judge(docs, model)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    blocks = pseudo_lm.blocks_of(docs)
    return pseudo_lm.scores(docs, pseudo_lm.train(docs, blocks), blocks)


def op11_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_license_scan": op1_license_scan,
    "op2_token_blocks": op2_token_blocks,
    "op3_source_mixing": op3_source_mixing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_tool_call_linking": op5_tool_call_linking,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_pseudo_likelihood": op10_pseudo_likelihood,
    "op11_embedding_near_dedup": op11_embedding_near_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_conversation_trie": op13_conversation_trie,
}
ORACLES: dict[str, str] = {
    "op3_source_mixing": mixing.SQL,
    "op4_substring_dedup": substrings.SQL,
    "op6_exact_dedup": exact.SQL,
    "op11_embedding_near_dedup": cover_tree.SQL,
    "op12_conversation_repair": repair.SQL,
    "op13_conversation_trie": prefix_trie.SQL,
}
