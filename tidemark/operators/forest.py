"""M4 at size: the random forest over binned rows instead of rows.

A tree only sees a row's bins (at most ``BINS`` a feature), its class and its weight, so rows of equal bins are one
*cell* with a count for each class. A bootstrap draws each row Poisson(1) times, hence ``n`` equal rows Poisson(n)
times: the trees have the distribution they have over the rows. The work of a tree follows the cells, which
correlated features keep few; each tree is grown by one task from the broadcast cells, level by level, and the
forest scores each cell once.

As in MLlib's forest: thresholds at quantiles, ceil(sqrt(features)) features a node, Gini gain, leaves where nothing
is gained, at ``maxDepth`` and in pure nodes; sibling leaves of the same prediction are merged; scores are mean leaf
shares. Up to ``ROWS`` rows, and above ``CELLS`` cells (a task's memory), MLlib trains on the rows.

Edge cases: null and NaN features are a bin of their own above all others; rows without a label are not learnt from.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = 50_000       # rows that MLlib trains on as they are
CELLS = 1 << 21     # cells that a task holds at most
BINS = 32
WIDTH = 6           # bits of a bin number in a cell's key: one more than BINS is that of null and NaN
STEP = 1 << 16      # cells scored at a time


def thresholds(df: DataFrame, cols: list[str]) -> list[list[float]]:
    """Lower ends of the bins above the first, of each column: all values of a column of few, else quantiles."""
    value = [F.col(f"`{c}`").cast("double") for c in cols]
    valid = [F.when(~F.isnan(v), v) for v in value]
    probs = [i / BINS for i in range(1, BINS)]
    r = df.agg(*[F.approx_count_distinct(v).alias(f"n{i}") for i, v in enumerate(valid)],
               *[F.percentile_approx(v, probs, 10000).alias(f"p{i}") for i, v in enumerate(valid)],
               *[F.min(v).alias(f"m{i}") for i, v in enumerate(valid)]).first()
    out = []
    for i, v in enumerate(valid):
        cuts = {float(x) for x in r[f"p{i}"] or ()}
        if 0 < r[f"n{i}"] <= 2 * BINS:
            some = [x[0] for x in df.select(v.alias("v")).distinct().limit(BINS + 2).collect() if x[0] is not None]
            if len(some) <= BINS:
                cuts = {float(x) for x in some}
        # -0.0 is 0.0; ends of the number line split nothing
        out.append(sorted({x + 0.0 for x in cuts if math.isfinite(x) and x > r[f"m{i}"]}))
    return out


def with_cell(df: DataFrame, cols: list[str], cuts: list[list[float]], name: str = "__cell") -> DataFrame:
    """``df`` with the packed bin numbers of its columns."""
    key: Column = F.lit(0).cast("long")
    for i, (c, own) in enumerate(zip(cols, cuts)):
        v = F.col(f"`{c}`").cast("double")
        df = df.withColumn("__v", F.coalesce(v, F.lit(float("nan"))))
        if own:
            df = Bucketizer(splits=[float("-inf"), *own, float("inf")], inputCol="__v", outputCol=f"__b{i}", handleInvalid="keep").transform(df)
        else:
            df = df.withColumn(f"__b{i}", F.isnan("__v").cast("double"))
        key = key + F.shiftleft(F.col(f"__b{i}").cast("long"), WIDTH * i)
    return df.withColumn(name, key).drop("__v", *[f"__b{i}" for i in range(len(cols))])


def unpacked(keys: np.ndarray, n: int) -> np.ndarray:
    """Bin numbers, a row for each feature."""
    return np.stack([(keys >> (WIDTH * i) & ((1 << WIDTH) - 1)).astype(np.uint8) for i in range(n)])


def grow(bins: np.ndarray, w0: np.ndarray, w1: np.ndarray, depth: int, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature or -1, last bin that goes left, left child, share of class 1) of a tree's nodes; a right child follows its left one."""
    n_features, size = len(bins), BINS + 1
    some = max(1, math.ceil(math.sqrt(n_features)))
    feature, cut, left, share = [np.full(1, -1, np.int8)], [np.zeros(1, np.uint8)], [np.zeros(1, np.int32)], []
    cells, node, m, done = np.arange(bins.shape[1]), np.zeros(bins.shape[1], np.int64), 1, 0
    for level in range(depth + 1):
        t0, t1 = np.bincount(node, w0, m), np.bincount(node, w1, m)
        total = np.maximum(t0 + t1, 1e-300)
        share.append(t1 / total)
        if level == depth:
            break
        # the impurity of a node times its weight is 2 t0 t1 / (t0 + t1)
        own = t0 * t1 / total
        best, best_f, best_b = np.zeros(m), np.zeros(m, np.int64), np.zeros(m, np.int64)
        drawn = rng.random((m, n_features)).argsort(1)[:, :some]
        for j in range(some):
            f = drawn[:, j]
            at = node * size + bins[f[node], cells]
            l0, l1 = (np.cumsum(np.bincount(at, w, m * size).reshape(m, size), 1)[:, :-1] for w in (w0, w1))
            r0, r1 = np.maximum(t0[:, None] - l0, 0), np.maximum(t1[:, None] - l1, 0)
            l, r = l0 + l1, r0 + r1
            tiny = 1e-9 * total[:, None]
            gain = np.where((l > tiny) & (r > tiny), own[:, None] - l0 * l1 / np.maximum(l, 1e-300) - r0 * r1 / np.maximum(r, 1e-300), 0)
            b = gain.argmax(1)
            g = gain[np.arange(m), b]
            more = g > best
            best, best_f, best_b = np.where(more, g, best), np.where(more, f, best_f), np.where(more, b, best_b)
        split = best > 1e-12 * total
        n = int(split.sum())
        first = done + m
        child = np.where(split, 2 * (np.cumsum(split) - 1), 0)
        feature[-1][split], cut[-1][split], left[-1][split] = best_f[split], best_b[split], first + child[split]
        if not n:
            break
        go = split[node]
        cells, node, w0, w1 = cells[go], node[go], w0[go], w1[go]
        node = child[node] + (bins[best_f[node], cells] > best_b[node])
        feature.append(np.full(2 * n, -1, np.int8))
        cut.append(np.zeros(2 * n, np.uint8))
        left.append(np.zeros(2 * n, np.int32))
        done, m = first, 2 * n
    feature, cut, left, share = (np.concatenate(x) for x in (feature, cut, left, share))
    for i in np.flatnonzero(feature >= 0)[::-1].tolist():  # children come after their parent
        a = left[i]
        if feature[a] < 0 and feature[a + 1] < 0 and (share[a] > 0.5) == (share[a + 1] > 0.5):
            feature[i] = -1
    return feature, cut, left, share


def _grown(held, n_features: int, depth: int, seed: int):
    def run(batches):
        keys, n0, n1, weights = held.value
        bins = unpacked(keys, n_features)
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, tree])
                w0, w1 = rng.poisson(n0) * weights[0], rng.poisson(n1) * weights[1]
                drawn = np.flatnonzero(w0 + w1)
                parts = grow(bins[:, drawn], w0[drawn], w1[drawn], depth, rng)
                yield pa.record_batch([pa.array([tree]), *(pa.array([x.tobytes()], pa.binary()) for x in parts)],
                                      names=["tree", "feature", "cut", "left", "share"])

    return run


def shares(trees: list, keys: np.ndarray, n_features: int, depth: int) -> np.ndarray:
    """Mean share of class 1 over the trees' leaves."""
    bins = unpacked(keys, n_features).astype(np.int64)
    total, every = np.zeros(len(keys)), np.arange(len(keys))
    for feature, cut, left, share in trees:
        node = np.zeros(len(keys), np.int64)
        for _ in range(depth):
            f = feature[node]
            inner = f >= 0
            if not inner.any():
                break
            right = bins[np.maximum(f, 0), every] > cut[node]
            node = np.where(inner, left[node] + right, node)
        total += share[node]
    return total / max(len(trees), 1)


class CellForest:
    """A fitted forest as the scores of all cells."""

    def __init__(self, cols: list[str], cuts: list[list[float]], n_trees: int, scores):
        self.cols, self.cuts, self.n_trees, self.scores = cols, cuts, n_trees, scores

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``rawPrediction``, ``probability`` and ``prediction``."""
        scores = self.scores

        @F.arrow_udf("double")
        def of(key: pa.Array) -> pa.Array:
            keys, p = scores.value
            at = np.minimum(np.searchsorted(keys, wanted := key.to_numpy(zero_copy_only=False)), len(keys) - 1)
            assert (keys[at] == wanted).all(), "a row that was not among those given to the forest"
            return pa.array(p[at])

        df = with_cell(df, self.cols, self.cuts).withColumn("__p", of("__cell"))
        p = F.col("__p")
        return (df.withColumn("rawPrediction", array_to_vector(F.array((1 - p) * self.n_trees, p * self.n_trees)))
                .withColumn("probability", array_to_vector(F.array(1 - p, p)))
                .withColumn("prediction", (p > 0.5).cast("double")).drop("__p", "__cell"))


class ForestClassifier:
    """Fits ``small`` (MLlib's forest) on up to ``ROWS`` rows, else a ``CellForest`` that scores all of ``rows``."""

    def __init__(self, small, cols: list[str], rows: DataFrame, n: int, label: str, weight: str, numTrees: int, maxDepth: int, seed: int):
        self.small, self.cols, self.rows, self.n, self.label, self.weight = small, cols, rows, n, label, weight
        self.trees, self.depth, self.seed = numTrees, maxDepth, seed

    def fit(self, train: DataFrame):
        if self.n <= ROWS or WIDTH * len(self.cols) > 62:
            return self.small.fit(train)
        from tidemark.session import boundary

        spark, k = train.sparkSession, len(self.cols)
        cuts = thresholds(train, self.cols)
        y = F.col(self.label)
        cells = with_cell(train, self.cols, cuts).groupBy("__cell").agg(F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1"))
        every = with_cell(self.rows, self.cols, cuts).select("__cell").distinct()
        every = boundary(every.join(cells, "__cell", "left").fillna(0, ["n0", "n1"]), "cells")
        if every.count() > CELLS:
            return self.small.fit(train)
        weights = {r[0]: r[1] for r in train.groupBy(y).agg(F.first(self.weight)).collect()}
        got = every.toArrow()
        keys, n0, n1 = (got.column(i).to_numpy().astype(np.int64) for i in range(3))
        order = np.argsort(keys)  # no run depends on the order in which cells arrive
        keys, n0, n1 = keys[order], n0[order], n1[order]
        learnt = n0 + n1 > 0
        held = spark.sparkContext.broadcast((keys[learnt], n0[learnt], n1[learnt], (weights.get(0.0, 1.0), weights.get(1.0, 1.0))))
        grown = spark.range(0, self.trees, 1, min(self.trees, 4 * spark.sparkContext.defaultParallelism)).mapInArrow(
            _grown(held, k, self.depth, self.seed), "tree long, feature binary, cut binary, left binary, share binary").toArrow().sort_by("tree")
        kinds = np.int8, np.uint8, np.int32, np.float64
        trees = [tuple(np.frombuffer(x, kind) for x, kind in zip(row, kinds))
                 for row in zip(*(grown.column(i).to_pylist() for i in range(1, 5)))]
        forest, depth = spark.sparkContext.broadcast(trees), self.depth

        def scored(batches):
            for batch in batches:
                own = batch.column(0).to_numpy()
                for lo in range(0, len(own), STEP):
                    part = own[lo:lo + STEP]
                    yield pa.record_batch([pa.array(part), pa.array(shares(forest.value, part, k, depth))], names=["cell", "p"])

        spread = min(spark.sparkContext.defaultParallelism * 4, math.ceil(len(keys) / 1000))
        out = every.select("__cell").repartition(max(1, spread), "__cell").mapInArrow(scored, "cell long, p double").toArrow().sort_by("cell")
        return CellForest(self.cols, cuts, self.trees, spark.sparkContext.broadcast(tuple(out.column(i).to_numpy() for i in range(2))))
