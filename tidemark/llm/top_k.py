"""Exact top-k by inner product with a three-phase uniform threshold.

Vectors are quantised to integers, floor(256 x). The dimensions are cut into
``GROUPS`` groups; a group's partial products are one score list a query, and a
score is the sum of its partials. Vectors are packed into blocks, queries into slots of
about ``SLOT``, and every block meets every slot.

1. Each (block, slot) pair gathers the k best entries of each of its score lists; only these few
   candidates get their other partials added. The k-th largest of all their scores is a cutoff that
   the true k-th score cannot fall below.
2. The cutoff goes out with the slots. A candidate that reaches it must have a
   partial of at least cutoff / ``GROUPS`` in some group (uniform threshold), so the pairs
   collect just those entries from the lists.
3. Their remaining partials are added exactly; those at the cutoff or above are ranked,
   ties to the smaller id.

Candidate and query blocks are bounded by ``BLOCK`` and ``SLOT``; they meet by an equi-join on
the slot and a salt of the block, so a slot's blocks are spread over tasks of about ``TOGETHER`` blocks.
Nothing is broadcast by hand.

Edge cases: null vectors, vectors with null or non-finite components, and rows with
a null id take no part; shorter vectors count as zero in the missing dimensions;
several rows of one id are candidates of their own and are never matched with a
query of the same id; a repeated query id is asked once (its smallest vector); fewer than k candidates are all returned; an
empty table gives an empty result; other columns are ignored. Sums stay exact below
2^53 in doubles and are computed in Python integers beyond; a score must fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, spill

K = 5
EVERY = 50
SCALE = 256
GROUPS = 4
BLOCK = 4096
SLOT = 1024
TOGETHER = 16


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and ``q`` (floor(256 x) as doubles) of the rows that take part."""
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("x"))
    ok = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return d.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ok).select(
        "vec_id", F.transform("x", lambda v: F.floor(v * SCALE).cast("double")).alias("q"))


def _matrix(column) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _blocks(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            m = _matrix(part.column("q"))
            yield pa.record_batch([
                pa.array([part.column("vec_id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                pa.array([m.tobytes()], pa.binary()), pa.array([m.shape[1]], pa.int32())], names=["ids", "m", "width"])


def _open(ids: bytes, m: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(m, np.float64).reshape(len(i), width)


def _aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = min(a.shape[1], b.shape[1])  # what one of them lacks counts as zero
    a, b = a[:, :width], b[:, :width]
    top = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0))
    if top * top * max(1, width) >= 2.0 ** 53:
        a, b = (np.array([[int(v) for v in r] for r in x], object).reshape(x.shape) for x in (a, b))
    return a, b


def _groups(width: int) -> list[slice]:
    edges = [width * g // GROUPS for g in range(GROUPS + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _rows(query, cand, score):
    return pa.record_batch([pa.array(query, pa.int64()), pa.array(cand, pa.int64()),
                            pa.array([int(s) for s in score], pa.int64())], names=["query_id", "vec_id", "score"])


def _gather(k: int):
    """Phase 1: each list's k best entries of a pair's queries, scored by adding their other partials."""
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                (qi, q), (ci, c) = _open(r["q_ids"], r["q_m"], r["q_width"]), _open(r["ids"], r["m"], r["width"])
                order = np.argsort(ci, kind="stable")
                ci, c = ci[order], c[order]
                q, c = _aligned(q, c)
                listed: list[list[np.ndarray]] = [[] for _ in qi]
                for g in _groups(q.shape[1]):
                    part = q[:, g] @ c[:, g].T  # one score list a query, dropped after its best entries
                    for j, one in enumerate(qi):
                        at = np.flatnonzero(ci != one)
                        listed[j].append(at[np.argsort(-part[j][at], kind="stable")[:k]] if len(at) <= 4 * k or part.dtype == object
                                         else _best(part[j], at, k))
                for j, one in enumerate(qi):
                    at = np.unique(np.concatenate(listed[j]))
                    score = c[at] @ q[j]
                    best = np.argsort(-score, kind="stable")[:k]
                    yield _rows([one] * len(best), ci[at[best]], score[best])
    return run


def _best(s: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    cut = np.partition(s[at], len(at) - k)[len(at) - k]
    at = at[s[at] >= cut]
    return at[np.argsort(-s[at], kind="stable")[:k]]


def _resolve(batches):
    """Phases 2 and 3: entries by the uniform threshold, resolved exactly."""
    for batch in batches:
        for r in batch.to_pylist():
            (qi, q), (ci, c) = _open(r["q_ids"], r["q_m"], r["q_width"]), _open(r["ids"], r["m"], r["width"])
            cutoff = np.frombuffer(r["cutoff"], np.int64).astype(float)
            q, c = _aligned(q, c)
            parts = [q[:, g] @ c[:, g].T for g in _groups(q.shape[1])]
            entry = parts[0] >= cutoff[:, None] / GROUPS
            for p in parts[1:]:
                entry |= p >= cutoff[:, None] / GROUPS
            entry &= qi[:, None] != ci[None, :]
            j, i = np.nonzero(entry)
            score = sum(p[j, i] for p in parts)
            good = score >= cutoff[j]
            yield _rows(qi[j[good]], ci[i[good]], score[good])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``vectors``, ``queries``: vec_id and q. query_id, rank (from 1), vec_id, score."""
    spark = vectors.sparkSession
    ready(spark)
    queries = spill(queries.groupBy("vec_id").agg(F.min("q").alias("q")), "queries")
    slots = max(1, -(-queries.count() // SLOT))
    blocks = spill(vectors.mapInArrow(_blocks, "ids binary, m binary, width int"), "blocks")
    salts = max(1, -(-blocks.count() // TOGETHER))

    def pack(rows):
        m = _matrix(pa.array(rows["q"].tolist(), pa.list_(pa.float64())))
        import pandas as pd
        return pd.DataFrame({"slot": rows["slot"].iloc[:1].to_numpy(), "q_ids": [rows["vec_id"].to_numpy(np.int64).tobytes()],
                             "q_m": [m.tobytes()], "q_width": np.array([m.shape[1]], np.int32),
                             "cutoff": [rows["cutoff"].to_numpy(np.int64).tobytes()]})

    def slotted(rows):
        return (rows.withColumn("slot", F.pmod(F.xxhash64("vec_id"), F.lit(slots)).cast("int"))
                .groupBy("slot").applyInPandas(pack, "slot int, q_ids binary, q_m binary, q_width int, cutoff binary")
                .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))

    pairs = (blocks.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int"))
             .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))))
    score = "query_id long, vec_id long, score long"
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    local = pairs.join(slotted(queries.withColumn("cutoff", F.lit(0).cast("long"))), ["slot", "salt"]).mapInArrow(_gather(k), score)
    # rank k of what was gathered; with fewer than k candidates, the smallest
    cutoffs = (local.withColumn("r", F.row_number().over(best_first)).filter(F.col("r") <= k)
               .groupBy("query_id").agg(F.min("score").alias("cutoff")))
    asked = queries.join(cutoffs, F.col("vec_id") == F.col("query_id")).select("vec_id", "q", "cutoff")
    final = pairs.join(slotted(asked), ["slot", "salt"]).mapInArrow(_resolve, score)
    return (final.withColumn("rank", F.row_number().over(best_first).cast("int")).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def top_k_of_table(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """The rows whose id is divisible by ``every`` ask all other rows."""
    q = quantised(embeddings)
    return top_k(q, q.filter(F.col("vec_id") % every == 0), k)


ORACLE = f"""
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
