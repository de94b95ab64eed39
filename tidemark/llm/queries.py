"""The registered queries ``opN_<name>``: each applies its operator, with its
production parameters, to its whole table and returns the full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import pii
from .collocations import ORACLE as COLLOCATIONS_SQL
from .collocations import collocations
from .knn_quality import score as knn_score
from .licenses import scan_documents
from .mixing import taken_words
from .near_dedup import near_classes
from .pieces import encode_digest
from .quality_rules import quality_rules
from .sharding import ORACLE as SHARDING_SQL
from .sharding import index as shard_index
from .substring_dedup import dedup_digest
from .suffix_tree_lm import score as lm_score
from .top_k import ORACLE as TOP_K_SQL
from .top_k import top_k_of_table
from .vector_codes import ORACLE as VECTOR_CODES_SQL
from .vector_codes import code_digest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(_table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(_table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digest(_table(spark, sf_dir, "documents"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_of_table(_table(spark, sf_dir, "embeddings"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(_table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_index(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_digest(_table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_mixing": (op1_mixing, None),
    "op2_top_k": (op2_top_k, TOP_K_SQL),
    "op3_quality_classifier": (op3_quality_classifier, None),
    "op4_lm_scoring": (op4_lm_scoring, None),
    "op9_license_scan": (op9_license_scan, None),
    "op10_near_dedup": (op10_near_dedup, None),
    "op5_pii": (op5_pii, None),
    "op6_sentencepiece": (op6_sentencepiece, None),
    "op7_quality_rules": (op7_quality_rules, None),
    "op8_suffix_array_dedup": (op8_suffix_array_dedup, None),
    "op11_sharding": (op11_sharding, SHARDING_SQL),
    "op12_vector_codes": (op12_vector_codes, VECTOR_CODES_SQL),
    "op13_collocations": (op13_collocations, COLLOCATIONS_SQL),
}
