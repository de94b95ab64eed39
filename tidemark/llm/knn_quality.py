"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text is a vector of hashed byte trigrams (square roots of their shares) and three
repetition shares (words equal to their predecessor, words and lines
seen before in the text). Up to ``PER_CLASS`` training documents of each label, those of the smallest
id hash, are the labelled vectors; their singular directions span the latent
space (``DIMS``). They are the only thing that is fitted on a sample and the only thing that is
broadcast: at most ``2 x PER_CLASS x DIMS`` numbers and the projection.
Every document's cosine with every labelled vector is computed in blocks; its ``K``
nearest vote with their label, weighted by similarity. Labels are used of training
rows only (crc32 of the id as text, mod 5, not 0), and a score sees the text alone.

Edge cases: null and empty texts have no direction and get the share of good
labels among the labelled vectors (by vote of equal weights); without labels
every score is 0.5; contradicting labels of one id are not used; rows with a null id
are scored, held_out is null for them; other columns are ignored; repeated rows get equal scores.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, text_of

PER_CLASS = 3000
DIMS = 48
K = 25
FEATURES = 2048
EXTRA = 3
THRESHOLD = 0.3
FOLDS = 5
BLOCK = 512


def in_fold(column: str = "doc_id"):
    """crc32 of the id as text, mod ``FOLDS``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


def features(text: str) -> np.ndarray:
    out = np.zeros(FEATURES + EXTRA, np.float32)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(b) == 0:
        return out
    if len(b) < 3:
        b = np.concatenate([b, np.full(3 - len(b), 32, np.uint32)])
    code = (b[:-2] * np.uint32(2654435761) + b[1:-1] * np.uint32(2246822519) + b[2:] * np.uint32(3266489917))
    code = (code ^ (code >> np.uint32(15))) * np.uint32(668265263)
    counts = np.bincount(code >> np.uint32(21), minlength=FEATURES)
    out[:FEATURES] = np.sqrt(counts / len(code))
    words, lines = text.split(), text.split("\n")
    if words:
        out[FEATURES] = sum(map(eq, words[1:], words)) / len(words)
        out[FEATURES + 1] = max(0.0, 1 - len(set(words)) / len(words) - 0.5)
    out[FEATURES + 2] = 1 - len(set(lines)) / len(lines)
    norm = float(np.sqrt((out * out).sum()))
    return out / norm if norm > 0 else out


class Neighbours:
    """Projection, unit latent vectors of the labelled sample, labels."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.labels = labels.astype(np.float32)
        if len(x):
            values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
            self.basis = vectors[:, np.argsort(-values)[:DIMS]].astype(np.float32)
            self.points = _unit(x @ self.basis)

    def scores(self, x: np.ndarray) -> np.ndarray:
        n = len(self.labels)
        if n == 0:
            return np.full(len(x), 0.5)
        z, k = _unit(x @ self.basis), min(K, n)
        out = np.empty(len(z))
        for at in range(0, len(z), BLOCK):
            cosine = z[at:at + BLOCK] @ self.points.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** 4
            total = weight.sum(1)
            vote = (weight * self.labels[near]).sum(1)
            out[at:at + BLOCK] = np.where(total > 0, vote / np.where(total > 0, total, 1), self.labels.mean())
        return np.clip(out, 0, 1)


def _unit(z: np.ndarray) -> np.ndarray:
    norm = np.sqrt((z * z).sum(1, keepdims=True))
    return np.where(norm > 1e-12, z / np.where(norm > 1e-12, norm, 1), 0)


def sample_ids(labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id and label of the training sample, at most ``per_class`` of each label."""
    agreed = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id")
              .agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
              .filter(F.col("label") == F.col("other")).filter(in_fold() != 0).select("doc_id", "label"))
    picked = [agreed.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return picked[0].unionByName(picked[1])


def _feature_rows(batches):
    for batch in batches:
        rows = [features(t).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())],
                              names=["doc_id", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Neighbours:
    sample = sample_ids(labels, per_class).withColumnRenamed("doc_id", "s_id")
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
            .join(F.broadcast(sample), F.col("doc_id") == F.col("s_id"))  # at most 2 x per_class ids
            .select("doc_id", F.col("label").cast("int").alias("label"), "text")
            .mapInArrow(_feature_rows, "doc_id long, label int, x binary").orderBy("doc_id", "x").toArrow())
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, FEATURES + EXTRA)
    return Neighbours(x, rows.column("label").to_numpy())


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Per input row: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    ready(spark)
    model = spark.sparkContext.broadcast(fit(docs, labels, per_class))

    def run(batches):
        for batch in batches:
            texts, got = batch.column("text").to_pylist(), []
            for at in range(0, len(texts), BLOCK):
                got.append(model.value.scores(np.stack([features(t) for t in texts[at:at + BLOCK]])))
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.concatenate(got) if got else np.zeros(0))],
                                  names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, score double")
    return scored.select("doc_id", (in_fold() == 0).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
