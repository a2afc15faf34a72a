"""The corpus pipeline: documents to piece ids, in five stages.

Quality rules drop documents, near-dedup keeps one of each group, secrets are masked in the texts, mixing draws by
calibrated probabilities, and what is left is encoded. Each stage gets what the one before kept, written and read again.
All stages but the last return the columns of documents; the last adds the piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import mixing, near_dedup, pieces, quality, secrets
from pulsegrid.llm.common import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def secret_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample_mix(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.with_pieces(docs, pieces.default_model())


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_masking", secret_masking),
          ("source_mixing", source_mixing), ("piece_encoding", piece_encoding)]

#: EM, the trained models and the tokenizer's pieces have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = step(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs, name)
    return docs
