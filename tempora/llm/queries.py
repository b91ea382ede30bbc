"""The registered query of each operator: its whole table, production parameters, full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tempora.llm import bitsliced, bpe, divergence, fingerprint, jaccard_join, langid, lm_score, mixing, quality, substring_dedup, suffix_dedup, superminhash, toxicity

Query = Callable[[SparkSession, str], DataFrame]

#: op 9 also counts the bytes of shorter repeats, such as passages of 50 words
PASSAGE_BYTES = 240


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_language(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_pairs(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = mixing.label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mixing_rates(documents(spark, sf_dir), labels, mixing.TARGETS, anchor="good")


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(documents(spark, sf_dir), also=PASSAGE_BYTES)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_words(documents(spark, sf_dir))


def op11_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


#: op 13 takes shingles of two words
SHORT_SHINGLES = 2


def op13_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(documents(spark, sf_dir), words=SHORT_SHINGLES)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_toxicity, op2_language_id, op3_quality_rules, op4_jaccard_join, op5_fingerprint, op6_bpe, op7_mixing, op8_lm_score, op9_suffix_dedup, op10_substring_dedup, op11_bitsliced, op12_divergence, op13_superminhash)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality.QUALITY_SQL, "op4_jaccard_join": jaccard_join.JACCARD_SQL, "op9_suffix_dedup": suffix_dedup.suffix_sql(suffix_dedup.SIZE, PASSAGE_BYTES), "op10_substring_dedup": substring_dedup.SUBSTRING_SQL, "op11_bitsliced": bitsliced.RANKED_SQL, "op12_divergence": divergence.DIVERGENCE_SQL, "op13_superminhash": superminhash.NEAR_SQL}
