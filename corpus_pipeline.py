"""The corpus pipeline: toxicity, quality, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of documents.  Between stages the
rows are written as Parquet and read again, so a lost executor costs a stage's
tasks and no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import materialize, table
from rillflow.llm.neardup import drop_near_duplicates
from rillflow.llm.packing import pack_texts
from rillflow.llm.quality import reject_poor, train_quality
from rillflow.llm.registry import TOKENIZERS
from rillflow.llm.secrets import redact_texts
from rillflow.llm.toxicity import reject_toxic, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.3, learned from all labels."""
    fitted = train_toxicity(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), F.lit(True))
    return reject_toxic(docs, fitted, 0.3)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5, learned from all labels of documents that are left."""
    return reject_poor(docs, train_quality(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), F.lit(True)), 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: shingles of five words, similarity from 0.8."""
    return drop_near_duplicates(docs, words=5, threshold=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked and n_chars brought in line."""
    return redact_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in windows of 2048."""
    return pack_texts(docs, f"{TOKENIZERS}/word_bpe_49k.json")


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: Learned scores, near-duplicate groups and token ids aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
