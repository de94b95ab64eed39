"""A set of 64-bit hashes as a bit table of fixed size, built by Spark.

Used to pass over rows that certainly have no partner. A hash sets four bits in one of
``WORDS`` 64-bit words (8 MB), or of as many as ``words_for`` a counted set takes (128 MB at
most); that is the bound of what is collected and broadcast. Membership has
false positives, never false negatives: results stay exact, a fuller table
only passes more rows on to the exact step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

WORDS = 1 << 20
MOST_WORDS = 1 << 24
SEGMENT = 1 << 13


def words_for(n: int) -> int:
    """Table size for ``n`` hashes: 16 to 32 bits each up to ``MOST_WORDS``."""
    return max(SEGMENT, min(MOST_WORDS, 1 << (n // 4).bit_length()))


def word_and_mask(h: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    m = mix64(h.view(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    mask = np.zeros(len(m), np.uint64)
    for shift in (0, 6, 12, 18):
        mask |= np.uint64(1) << ((m >> np.uint64(shift)) & np.uint64(63))
    return ((m >> np.uint64(24)) % np.uint64(words)).astype(np.int64), mask


def contains(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    word, mask = word_and_mask(h, len(table))
    return table[word] & mask == mask


def _set_bits(words: int):
    def run(batches):
        table = np.zeros(words, np.uint64)
        for batch in batches:
            word, mask = word_and_mask(batch.column(0).to_numpy(), words)
            np.bitwise_or.at(table, word, mask)
        at = np.flatnonzero(table)
        yield pa.record_batch([pa.array(at), pa.array(table[at].view(np.int64))], names=["word", "mask"])

    return run


def _pack_segments(words: int):
    """Words with their bits as dense segments, so few and small rows reach the driver."""
    def run(batches):
        table, touched = np.zeros(words, np.uint64), set()
        for batch in batches:
            word = batch.column("word").to_numpy()
            np.bitwise_or.at(table, word, batch.column("mask").to_numpy().view(np.uint64))
            touched.update(np.unique(word // SEGMENT).tolist())
        at = sorted(touched)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array([table[s * SEGMENT:(s + 1) * SEGMENT].tobytes() for s in at], pa.binary())],
                              names=["segment", "bits"])

    return run


def bit_table(hashes: DataFrame, size: int = WORDS):
    """Broadcast bit table (``size`` words) of a one-column frame of longs (no nulls)."""
    words = hashes.mapInArrow(_set_bits(size), "word long, mask long")
    rows = (words.repartition(F.floor(F.col("word") / SEGMENT))
            .mapInArrow(_pack_segments(size), "segment long, bits binary").collect())
    table = np.zeros(size, np.uint64)
    for r in rows:
        table[r.segment * SEGMENT:(r.segment + 1) * SEGMENT] = np.frombuffer(r.bits, np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(table)


def maybe_in(table, hash_column):
    """Boolean column: False where the hash is certainly not in the table."""
    @F.arrow_udf("boolean")
    def check(h: pa.Array) -> pa.Array:
        return pa.array(contains(table.value, h.to_numpy(zero_copy_only=False)))

    return check(hash_column)
