"""The queries of this subpackage: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import chat, covertree, fim, jaccard, licenses, linededup, mixing, packing, pii, quality, secrets, toxicity, whitening
from sextant.llm.queries_sql import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"), appeal=mixing.length_appeal).drop("copies")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality.quality_report(_table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.shingle_report(_table(spark, sf_dir, "documents"))


def op4_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op5_segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(_table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_chats(rows.unionByName(probe)))


def op7_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_table(spark, sf_dir, "documents")).drop("spans")


def op8_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op9_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scores.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fim.fill_in_middle(_table(spark, sf_dir, "documents"))
    return d.withColumn("restored_sha256", fim.restored_sha256(F.col("output"), F.col("form"))).drop("output")


def op12_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(_table(spark, sf_dir, "documents")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(whitening.whiten(_table(spark, sf_dir, "embeddings")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_groups": op3_token_groups,
    "op4_secret_owners": op4_secret_owners,
    "op5_segment_lines": op5_segment_lines,
    "op6_chat_format": op6_chat_format,
    "op7_license_automaton": op7_license_automaton,
    "op8_best_fit_pack": op8_best_fit_pack,
    "op9_cover_tree_topk": op9_cover_tree_topk,
    "op10_compression_toxicity": op10_compression_toxicity,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_pii_anchors": op12_pii_anchors,
    "op13_whitening": op13_whitening,
}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
