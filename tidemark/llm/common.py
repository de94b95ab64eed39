"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import boundary, bounded_batches, ensure_checkpoint_dir, ship_package

# a word: a run of characters other than space and the ASCII controls 9 to 13
WORD = r"[^\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> None:
    """Shared checkpoint folder set, package importable in the Python workers, and
    Arrow batches of at most ``BATCH_BYTES``, so a worker's memory does not follow the row size."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    bounded_batches(spark)


def text_of(column: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def word_hashes(text: Column) -> Column:
    """Array of 64-bit word hashes, in text order."""
    return F.transform(words_of(text), lambda w: F.xxhash64(w))


def spill(df: DataFrame, tag: str, **options) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: later stages and executors that replace lost ones read
    the written table instead of recomputing it. The folder goes when the application ends.
    """
    return boundary(df, tag, **options)


@contextmanager
def shuffles_go(spark: SparkSession):
    """Shuffle files of what is run meanwhile go when it has ended, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (wrapping multiply, xor, shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def small_batches(batches, size: int, column: str = "text"):
    """The rows in batches of about ``size`` bytes of text, so that a worker holds few rows as Python objects."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(1, batch.column(column).nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def list_parts(array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets (from 0) of an Arrow list column without nulls."""
    offsets = array.offsets.to_numpy()
    values = array.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    return values, (offsets - offsets[0]).astype(np.int64)
