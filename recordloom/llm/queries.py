"""The queries of the training-data operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import chat, chroma, decontam, exact_dedup, fim, langid, mixing, quality, simhash, suffix_dedup, tokens, toxicity, vector_codes
from recordloom.llm.common import table
from recordloom.llm.oracle import SQL


def op1_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    shown = F.transform("word_spans", lambda x: F.concat(F.shiftright(x, 32).cast("string"), F.lit("-"), x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("string")))
    return found.withColumn("word_spans", F.array_join(shown, ",")).drop("items", "spans")


def op2_edit_aware_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op3_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(chat.with_probe(table(spark, sf_dir, "conversations")))


def op4_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.align_with_members(chroma.recordings(table(spark, sf_dir, "embeddings")))


def op6_cnn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.detect(table(spark, sf_dir, "documents"))


def op8_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op10_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op13_hamerly_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def llm_oracle_sql() -> dict[str, str]:
    return dict(SQL)
