"""The corpus pipeline: documents to encoded training rows, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept: quality rules drop rejected documents, near-duplicate
classes keep one document each, personal data is replaced by tags, the mix draws whole documents
(up to twice) towards the source targets, and the last stage encodes texts into
pieces. Between stages the rows are written as Parquet in the shared folder and
reread, so a lost executor never recomputes an earlier stage.

Edge cases are those of the stages' operators: null or empty texts fail the
quality rules; an empty table passes through every stage as an empty table; columns
beside doc_id, text, source and n_chars are carried along to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import near_dedup, pii, pieces, quality_rules
from tidemark.llm.common import ready, spill
from tidemark.llm.mixing import mix


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def _private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def _encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs)


STAGES = [
    ("quality_rules", _quality),
    ("near_dedup", _near),
    ("pii", _private),
    ("mixing", _mix),
    ("sentencepiece", _encode),
]

# hashed ratios, sampling, trained span models and N-best search are beyond SQL;
# tests/llm/test_pipeline.py holds the stages against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = spill(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
