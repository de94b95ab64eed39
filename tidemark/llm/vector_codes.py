"""Vector codes: four codebooks, assigned by a lexicographic trie over distinct parts.

Components become integers floor(``SCALE`` * x). Vectors are cut into ``PARTS`` equal parts; a part
position's codebook starts as that part of the ``ENTRIES`` smallest vector ids. Rounds assign every
part to its nearest entry (squared distance, ties to the lower index) and replace each entry by the
floored mean of its parts. All sums are of distinct parts weighted by their counts.

The assignment walks a trie of sorted distinct parts depth first. A node holds the
distances from its prefix to all entries, added up once for all parts below it; a subtree of at most
``LEAVES`` parts is finished level by level, again one row of distances a distinct prefix. Leaves
take the argmin and, in a round, add their weighted part to the entry's sum.

Spark counts the distinct parts once, range-partitioned in trie order (a part held by a third of all rows is
one row a task before it moves); a round returns at most parts x entries x (part length + 1) sums a task,
added up by Spark, and the new codebooks (``ENTRIES`` vectors) are all that the driver holds or broadcasts. The last
assignment walks each batch of vectors and moves nothing but one total a label: labels of more than a
thousandth of all rows (at most a thousand) are broadcast back, others joined.

Edge cases: vectors that are null or hold null or non-finite components are dropped; the length is that of the
smallest id whose length is a multiple of four; kept vectors of another length get a null code and a null error
(they are no part of any sum); fewer than 256 vectors make smaller codebooks; equal ids are ordered
by their components; components beyond 64 bits saturate, distances are exact at any size (Python integers where
64 bits might not do) and an error beyond 64 bits saturates; an empty table gives an empty result; null labels are
one group; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import list_parts, ready, spill

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LEAVES = 512
# components below this keep part sums and squared distances of up to 2^10 dimensions within 64 bits
SAFE = 1 << 25
LONG = (1 << 63) - 1
HOT = 1000


def nearest(parts: np.ndarray, book: np.ndarray, leaves: int = LEAVES) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each row of ``parts``, distinct and in lexicographic order.

    ``book`` has an entry a row. Works on int64 or, for exactness beyond it, on object arrays.
    """
    n, depth = parts.shape
    entry, distance = np.zeros(n, np.int64), np.zeros(n, parts.dtype)
    columns = np.ascontiguousarray(book.T)

    def finish(lo: int, hi: int, level: int, above: np.ndarray) -> None:
        held, node = above[None, :], np.zeros(hi - lo, np.int64)
        for d in range(level, depth):
            value = parts[lo:hi, d]
            first = np.ones(hi - lo, bool)
            first[1:] = (node[1:] != node[:-1]) | (value[1:] != value[:-1])
            step = columns[d][None, :] - value[first][:, None]
            held = held[node[first]] + step * step
            node = np.cumsum(first) - 1
        best = np.argmin(held, axis=1)
        entry[lo:hi] = best[node]
        distance[lo:hi] = held[np.arange(len(held)), best][node]

    stack = [(0, n, 0, np.zeros(len(book), parts.dtype))]
    while stack:
        lo, hi, level, above = stack.pop()
        if hi - lo <= leaves or level == depth:
            if hi > lo:
                finish(lo, hi, level, above)
            continue
        value = parts[lo:hi, level]
        cuts = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1).tolist(), hi - lo]
        # small neighbours share one level-wise finish, so a wide node costs no call for each child
        at = 0
        while at < len(cuts) - 1:
            to = at + 1
            while to < len(cuts) - 1 and cuts[to + 1] - cuts[at] <= leaves:
                to += 1
            if to > at + 1:
                stack.append((lo + cuts[at], lo + cuts[to], level, above))
            else:
                step = columns[level] - value[cuts[at]]
                stack.append((lo + cuts[at], lo + cuts[to], level + 1, above + step * step))
            at = to
    return entry, distance


def in_order(parts: np.ndarray) -> np.ndarray:
    """Row numbers in lexicographic order."""
    return np.lexsort(parts.T[::-1]) if parts.shape[1] else np.arange(len(parts))


def assign(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` of rows in any order, with repeats."""
    if len(parts) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0))) >= SAFE or parts.min(initial=0) == -LONG - 1:
        parts, book = parts.astype(object), book.astype(object)
        order = np.array(sorted(range(len(parts)), key=lambda i: tuple(parts[i])), np.int64)
    else:
        order = in_order(parts)
    rows = parts[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    entry, distance = nearest(rows[first], book)
    back = np.empty(len(rows), np.int64)
    back[order] = np.cumsum(first) - 1
    return entry[back], distance[back]


def _matrix(array, width: int) -> np.ndarray:
    values, _ = list_parts(array)
    return values.reshape(-1, width).astype(np.int64)


def _round_sums(books, width: int):
    """Per task: weighted sums (``d`` from 0) and counts (``d`` -1) of each position's entries."""
    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            pos, n = batch.column("pos").to_numpy(), batch.column("n").to_numpy()
            rows = _matrix(batch.column("part"), width)
            for p in np.unique(pos).tolist():
                at = np.flatnonzero(pos == p)
                book = books.value[p]
                entry, _ = assign(rows[at], book)
                total = sums.setdefault(p, np.zeros((len(book), width + 1), object))
                weighted = np.column_stack([n[at], rows[at].astype(object) * n[at][:, None]]) \
                    if np.abs(rows[at]).max(initial=0) * int(n[at].sum()) >= 1 << 62 else np.column_stack([n[at], rows[at] * n[at][:, None]])
                order = np.argsort(entry, kind="stable")
                used, start = np.unique(entry[order], return_index=True)
                total[used] += np.add.reduceat(weighted[order], start, axis=0).astype(object)
        for p, total in sums.items():
            used = np.flatnonzero(total[:, 0] > 0)
            k = len(used)
            yield pa.record_batch([
                pa.array(np.full(k * (width + 1), p, np.int32)), pa.array(np.repeat(used, width + 1).astype(np.int32)),
                pa.array(np.tile(np.arange(-1, width, dtype=np.int32), k)),
                pa.array([str(x) for x in total[used].reshape(-1).tolist()], pa.string())], names=["pos", "entry", "d", "s"])

    return run


def _moved(books: list[np.ndarray], sums: list) -> list[np.ndarray]:
    """Entries replaced by the floored means of their parts; unused ones stay."""
    count = {(r.pos, r.entry): int(r.s) for r in sums if r.d < 0}
    new = [b.copy() for b in books]
    for r in sums:
        if r.d >= 0:
            new[r.pos][r.entry, r.d] = int(r.s) // count[r.pos, r.entry]
    return new


def digest(books: list[np.ndarray]) -> str:
    """Hash of all components, by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def _codes(books, width: int):
    def run(batches):
        for batch in batches:
            values, at = list_parts(batch.column("v"))
            n = len(at) - 1
            fit = np.diff(at) == width * PARTS
            rows = values.reshape(-1, width * PARTS) if fit.all() and width else \
                values[np.repeat(fit, np.diff(at))].reshape(int(fit.sum()), width * PARTS)
            error = np.zeros(len(rows), object)
            hexes = np.zeros((len(rows), PARTS), np.int64)
            for p in range(PARTS):
                entry, distance = assign(rows[:, p * width:(p + 1) * width].astype(np.int64), books.value[p])
                hexes[:, p] = entry
                error = error + distance.astype(object)
            code, errors = np.full(n, None, object), np.full(n, None, object)
            code[fit] = ["".join(f"{x:02x}" for x in r) for r in hexes.tolist()]
            errors[fit] = [min(int(e), LONG) for e in error.tolist()]
            yield pa.record_batch([batch.column("vec_id"), batch.column("label"), pa.array(code.tolist(), pa.string()),
                                   pa.array(errors.tolist(), pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label and the integer components ``v`` of every vector that takes part."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return (vectors.filter(F.col("embedding").isNotNull() & ~bad)
            .select("vec_id", "label", F.transform(x, lambda e: F.floor(e * F.lit(float(SCALE)))).alias("v")))


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every kept vector, and the final codebooks."""
    spark = vectors.sparkSession
    ready(spark)
    kept = spill(kept_vectors(vectors), "vectors")
    head = kept.filter(F.size("v") % PARTS == 0).orderBy("vec_id", "v").limit(1).collect()
    width = len(head[0].v) // PARTS if head else 0
    fit = kept.filter(F.size("v") == width * PARTS)
    first = [r.v for r in fit.orderBy("vec_id", "v").select("v").limit(entries).collect()] if head else []
    grid = np.array(first, np.int64).reshape(len(first), PARTS * width)
    books = [grid[:, p * width:(p + 1) * width] for p in range(PARTS)]
    if first and width:
        cut = F.posexplode(F.array(*[F.slice("v", p * width + 1, width) for p in range(PARTS)])).alias("pos", "part")
        parts = fit.select(cut).groupBy("pos", "part").agg(F.count("*").alias("n"))
        parts = spill(parts.repartitionByRange("pos", "part").sortWithinPartitions("pos", "part"), "parts")
        for _ in range(rounds):
            held = spark.sparkContext.broadcast(books)
            sums = (parts.mapInArrow(_round_sums(held, width), "pos int, entry int, d int, s string")
                    .groupBy("pos", "entry", "d").agg(F.sum(F.col("s").cast(T.DecimalType(38, 0))).alias("s"))).collect()
            books = _moved(books, sums)
            held.destroy()
    label = dict(vectors.dtypes)["label"]
    ids = dict(vectors.dtypes)["vec_id"]
    codes = kept.mapInArrow(_codes(spark.sparkContext.broadcast(books), width), f"vec_id {ids}, label {label}, code string, error long") \
        if first else kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return spill(codes, "codes"), books


def code_digest(vectors: DataFrame) -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    codes, books = compress(vectors)
    totals = spill(codes.groupBy("label").agg(F.sum(F.col("error").cast(T.DecimalType(38, 0))).alias("s"), F.count("*").alias("n"))
                   .select(F.col("label").alias("t_label"), F.least("s", F.lit(LONG).cast(T.DecimalType(38, 0))).cast("long").alias("label_error"), "n"), "totals")
    few = totals.agg(F.sum("n")).first()[0] or 0
    common = F.col("n") * HOT > few  # less than HOT labels can be so common
    hot, cold = totals.filter(common).drop("n"), totals.filter(~common).drop("n")
    same = F.col("label").eqNullSafe(F.col("t_label"))
    out = ("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
    near = codes.join(F.broadcast(hot), same)
    far = codes.join(F.broadcast(hot), same, "left_anti").join(cold, same)
    return near.select(*out).unionByName(far.select(*out))


def _sql_round(k: int, last: bool) -> str:
    near = f"""
near{k} AS MATERIALIZED (
    SELECT id, pos, arg_min(entry, (d, entry)) AS entry, min(d) AS d, any_value(part) AS part FROM (
        SELECT p.id, p.pos, p.part, b.entry, list_sum(list_transform(list_zip(p.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM parts p JOIN book{k} b USING (pos)) GROUP BY id, pos)"""
    if last:
        return near
    return near + f""",
mean{k} AS (
    SELECT pos, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS part FROM (
        SELECT pos, entry, i, sum(x)::HUGEINT AS s, count(*) AS n
        FROM (SELECT pos, entry, unnest(part) AS x, generate_subscripts(part, 1) AS i FROM near{k}) GROUP BY pos, entry, i) GROUP BY pos, entry),
book{k + 1} AS MATERIALIZED (SELECT b.pos, b.entry, coalesce(m.part, b.part) AS part FROM book{k} b LEFT JOIN mean{k} m USING (pos, entry)),"""


ORACLE = f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT id, p AS pos, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS part FROM kept, range({PARTS}) AS t(p)),
book0 AS MATERIALIZED (SELECT pos, id - 1 AS entry, part FROM parts WHERE id <= {ENTRIES}),
{''.join(_sql_round(k, k == ROUNDS) for k in range(ROUNDS + 1))},
codes AS (
    SELECT id, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY pos) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY id),
book_digest AS (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN codes USING (id), book_digest"""
