"""The queries of this folder's operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldspark.llm import ann, bpe, divergence, langid, licenses, lmscore, media, mixing, neardup, negatives, pii, quality, suffixes


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_read(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score(_read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_read(spark, sf_dir, "documents")).drop("copies")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_read(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(_read(spark, sf_dir, "documents"))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(_read(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(_read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(negatives.relabelled(negatives.usable(_read(spark, sf_dir, "embeddings"))))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_licenses, op2_pii, op3_language, op4_bpe, op5_lm_score, op6_mixing, op7_neighbours, op8_quality, op9_media, op10_neardup, op11_suffix_dedup, op12_hard_negatives, op13_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op1_licenses": licenses.sql(), "op6_mixing": mixing.SQL, "op12_hard_negatives": negatives.SQL, "op13_divergence": divergence.SQL}
