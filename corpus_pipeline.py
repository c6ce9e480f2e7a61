"""A corpus pipeline: quality, language, near-duplicates, packing. Each stage is one operator over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import language, ngram_join, packing, quality_model

#: Columns that every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").alias("good"))
    return quality_model.scored(docs, labels).where("quality_kept").select(*COLUMNS)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: without a letter, or with under a fifth of typical n-grams, they go."""
    train = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    found = language.predictions(docs, language.fit(train))
    return found.where("lang_pred <> 'und' and lang_score >= 0.2").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id. Texts without words stay."""
    groups = ngram_join.near_groups(docs, shingle=5, percent=80, parts=2, left_out=1)
    gone = groups.where("component_id <> id").select(F.col("id").alias("doc_id")).distinct()
    if gone.count() <= ngram_join.BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their bins."""
    return packing.packed(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("languages", languages), ("near_duplicates", near_duplicates), ("pack", pack)]

#: No SQL: fitted models and components; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    from tidemill.llm._common import Workspace

    work, docs = Workspace(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return docs
