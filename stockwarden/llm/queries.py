"""Registered queries of the operators: each over its whole table, with production parameters, as the fixed digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockwarden.llm import extraction, forest_dedup, language, lexical, mixing, packing, passages, quality, simhash, topk, toxicity, trie, warc
from stockwarden.llm.common import table


def vocabulary() -> str:
    """The public vocabulary that the packing query fixes."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_forest_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return forest_dedup.near_vectors(table(spark, folder, "embeddings"))


def op2_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, folder, "documents"))


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.languages(table(spark, folder, "documents"))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents")).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    read = warc.archived(table(spark, folder, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), vocabulary(), keep_ids=False)


def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract(table(spark, folder, "pages"))


def op8_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.repeated_passages(table(spark, folder, "documents"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.prefix_trie(table(spark, folder, "conversations"))


def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_forest_dedup, op2_simhash_groups, op3_language, op4_mixing, op5_warc, op6_best_fit_packing, op7_main_text, op8_repeated_passages,
        op9_quality, op10_top_k, op11_prefix_trie, op12_toxicity, op13_ranked_search, pipeline,
    )
}
ORACLES: dict[str, str] = {
    "op1_forest_dedup": forest_dedup.ORACLE_SQL,
    "op4_mixing": mixing.ORACLE_SQL,
    "op10_top_k": topk.ORACLE_SQL,
    "op11_prefix_trie": trie.ORACLE_SQL,
    "op13_ranked_search": lexical.ORACLE_SQL,
}
