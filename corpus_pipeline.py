"""A training-data pipeline of five of the ``llm`` operators.

language -> near_duplicates -> personal_data -> mixing -> tokens. Each stage works on all that
the one before it kept, and its decisions take effect: documents of no recognised language
go, one document of each group of near-duplicates stays, personal data is replaced by its
kind, documents are repeated or left out towards the sources' targets, and what is left
is encoded. All stages but the last return the columns of ``documents``. Ties go to the least
doc_id or, in languages, the first by code point. An empty table passes as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm import bpe, langid, mixing, neardup, pii, store


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognised language."""
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group: of the least doc_id, where that repeats of the least hash of the text, rows without a doc_id
    last. Rows are told apart by doc_id and text; of equal ones in both one stays. Rows without words are in no group and stay."""
    kept = neardup.keepers(docs).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("repeated").alias("_repeated"))
    whole = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    out = whole.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_row")))
    if kept.filter("_repeated").limit(1).count():
        out = out.filter("not _repeated").unionByName(out.filter("_repeated").dropDuplicates(["_id", "_row"]))
    return out.select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts."""
    return pii.redact(docs, pii.fit(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row."""
    return bpe.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixed), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store.table(stage(spark, docs, sf_dir), name)
    return docs
