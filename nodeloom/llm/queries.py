"""The queries which this subpackage adds, their SQL, and nothing else."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nodeloom.llm import ann, chat_format, jaccard_join, suffix_dedup
from nodeloom.llm.bpe import digests
from nodeloom.llm.html_extract import main_text
from nodeloom.llm.jaccard_join import jaccard_components
from nodeloom.llm.packing import pack
from nodeloom.llm.quality_classifier import score_quality
from nodeloom.llm.quality_rules import judge
from nodeloom.llm.suffix_dedup import remove_repeats
from nodeloom.llm.token_files import round_trip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render(_table(spark, sf_dir, "conversations"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = judge(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "byte_share", "entropy")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_token_files": op4_token_files,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_bpe": op6_bpe,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_quality_rules": op9_quality_rules,
    "op10_html_extraction": op10_html_extraction,
}
SQL: dict[str, str] = {"op1_ngram_jaccard_join": jaccard_join.SQL, "op5_chat_formatting": chat_format.SQL, "op7_suffix_array_dedup": suffix_dedup.SQL, "op8_nearest_neighbours": ann.SQL}
