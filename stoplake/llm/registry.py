"""The queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stoplake.llm import (
    decontaminate,
    filter_audit,
    hard_negatives,
    jaccard_join,
    language_id,
    maxent_lm,
    pii_surrogates,
    quality_rules,
    secret_scan,
    sentencepiece_bpe,
    simhash_trie,
    token_orc,
    warc,
)
from stoplake.llm.common import table


def op1_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.protect(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", relabelled), F.col("vec_id") % 100 == 0)


def op12_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.join(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable]:
    each = (
        op1_maxent_lm,
        op2_quality_rules,
        op3_secret_scan,
        op4_token_orc,
        op5_pii_surrogates,
        op6_language_id,
        op7_jaccard_join,
        op8_sentencepiece,
        op9_decontaminate,
        op10_warc,
        op11_hard_negatives,
        op12_simhash_trie,
        op13_filter_audit,
    )
    return {f.__name__: f for f in each}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality_rules.ORACLE, "op10_warc": warc.ORACLE, "op11_hard_negatives": hard_negatives.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
