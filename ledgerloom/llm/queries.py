"""The ten digest queries: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, fingerprints, mixing, near_duplicates, neighbours, packing, quality, substrings, toxicity, warc
from .common import read

CONTROL = r"\### Assistant: </turn> ok"


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(read(spark, sf_dir, "documents"))


def op2_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], chats.schema)
    return chat.digests(chat.format_chats(chats.union(extra)))


def op4_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classified(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"))


def op7_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classified(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"))


def op10_relative_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_winnowing, op2_bbit_minhash, op3_chat_formatting, op4_warc_transactions, op5_toxicity, op6_entropy_balancing, op7_rule_ensemble, op8_power_of_two_packing, op9_cross_polytope, op10_relative_lempel_ziv)
}

#: For the others SQL has no way to say the same; tests hold them against brute force or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op2_bbit_minhash": near_duplicates.SQL,
    "op3_chat_formatting": chat.SQL,
    "op4_warc_transactions": warc.SQL,
    "op10_relative_lempel_ziv": substrings.SQL,
}
