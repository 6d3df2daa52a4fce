"""The queries over the driver's tables: each operator with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, lm_score, media, oracles, packing, secrets, simhash, substring_dedup, suffix_dedup, toxicity
from .common import columns, read


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan_secrets(read(spark, sf_dir, "documents")))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(read(spark, sf_dir, "documents")).drop("kept")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op5_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.audio_digests(read(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("spans")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(read(spark, sf_dir, "documents")).drop("kept")


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(packing.TOKENIZER), public_tokenizers.path(packing.RANKS)).drop("cost")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_rows(simhash.near_duplicates(read(spark, sf_dir, "documents")))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = columns(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(rows.unionByName(more), public_tokenizers.path(packing.TOKENIZER)).drop("n_tokens", "n_loss_tokens")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_substring_dedup, op3_lm_score, op4_toxicity, op5_audio_features, op6_decontaminate, op7_suffix_dedup, op8_pack, op9_simhash, op10_chat_format)}
ORACLE_SQL: dict[str, str] = {"op1_secret_scan": oracles.SECRETS, "op2_substring_dedup": oracles.SUBSTRING, "op6_decontaminate": oracles.DECONTAMINATE, "op7_suffix_dedup": oracles.SUFFIX, "op10_chat_format": oracles.CHAT}
