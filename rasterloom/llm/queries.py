"""The queries opN_<name> of this subpackage and their SQL, for the driver's contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import alignment, bitplanes, bpe, conversations, packing, quality_rules, simhash, suffix_dedup, tokens, toxicity, url_filter, warc, weighted_sampling, wfst
from rasterloom.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfst.round_trip(table(spark, sf_dir, "documents"), tokens.vocabulary("piece_bpe_32k.model"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.round_trip(table(spark, sf_dir, "documents"), tokens.vocabulary("word_bpe_49k.json"))


def op6_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 9))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"))


def op11_bpe_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.round_trip(table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digests(conversations.repair(conversations.damage(table(spark, sf_dir, "conversations"))))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.links(table(spark, sf_dir, "documents"), tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("piece_bpe_32k.model"))
    digest = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return found.withColumn("groups_sha256", digest).drop("groups")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_sentencepiece, op3_warc, op4_toxicity, op5_token_planes, op6_weighted_sampling, op7_url_filter, op8_suffix_dedup, op9_quality_rules, op10_packing, op11_bpe_backtracking, op12_conversation_repair, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.ORACLE, "op8_suffix_dedup": suffix_dedup.ORACLE, "op9_quality_rules": quality_rules.ORACLE, "op12_conversation_repair": conversations.ORACLE}
