"""Isolation-forest outlier flag (Liu, Ting & Zhou, 2008).

MLlib has no isolation forest, so:

1. equal feature vectors are counted, and every tree takes its own ``psi = min(256, n)``
   rows without replacement, in the JVM: every copy of a vector arrives in every tree at an exponential
   time given by hashes of (seed, vector, tree, copy), and a tree takes the psi first. One hash a vector
   gives its first arrival anywhere, which passes over nearly all vectors of a large table; the others'
   arrivals before a time that almost surely suffices are drawn in order (the k-th of n copies after a gap of
   rate n - k + 1, so a vector held by a third of all rows costs psi draws a tree). Each tree is grown from its
   group with ``applyInPandas``. The choice depends on the values and their counts alone, not on partitions
   or arrival order of rows;
2. the forest (``trees x <= 511`` nodes, fixed by the parameters) goes to the
   tasks, which score every row in Arrow batches with ``mapInPandas``;
3. rows scoring above the exact (1 - contamination) quantile are flagged.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import config as C
from tidemark.operators.rank import quantiles

EULER = 0.5772156649015329
TREE_SCHEMA = "tree int, node int, feat int, thr double, left int, right int, size long"


def avg_path(n: float) -> float:
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    nodes = []  # (feat, thr, left, right, size)

    def build(idx: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append(None)
        sub = x[idx]
        if depth >= max_depth or len(idx) <= 1:
            nodes[me] = (-1, 0.0, -1, -1, len(idx))
            return me
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        ok = np.flatnonzero(hi > lo)
        if ok.size == 0:
            nodes[me] = (-1, 0.0, -1, -1, len(idx))
            return me
        f = int(rng.choice(ok))
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < thr
        left = build(idx[go_left], depth + 1)
        right = build(idx[~go_left], depth + 1)
        nodes[me] = (f, thr, left, right, len(idx))
        return me

    build(np.arange(len(x)), 0)
    return nodes


def _exponential(*keys) -> Column:
    """A standard exponential number hashed from ``keys``."""
    return -F.log((F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + 0.5) / float(1 << 53))


def sample_rows(counted: DataFrame, cols: list[str], n_trees: int, n: int, psi: int, seed: int) -> DataFrame:
    """Each tree's rows (``__tree``, ``__h``, features) out of distinct vectors with counts ``__n``."""
    # a tree's rows under the bound are binomial: eight deviations of room
    share = (psi + 8 * math.sqrt(psi) + 8) / max(n, 1)
    bound = -math.log1p(-share) if share < 1 else float("inf")
    v = counted.withColumn("__v", F.xxhash64(F.lit(seed), *cols))
    # the first of n_trees x n arrivals, in a tree that is drawn too; the rest start anew from there
    v = v.withColumn("__h0", _exponential("__v", F.lit(-1)) / (F.lit(n_trees) * F.col("__n"))).where(F.col("__h0") < bound)
    lead = F.pmod(F.xxhash64("__v", F.lit(-2)), F.lit(n_trees))
    first = F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: F.when(t == lead, F.col("__h0")).otherwise(
        F.col("__h0") + _exponential("__v", t, F.lit(1)) / F.col("__n")))
    each = v.select(*cols, "__n", "__v", F.posexplode(first).alias("__tree", "__h")).where(F.col("__h") < bound)
    more = F.aggregate(
        F.sequence(F.lit(2), F.least(F.col("__n"), F.lit(psi)).cast("int")), F.struct(F.col("__h").alias("at"), F.array("__h").alias("all")),
        lambda s, j: F.struct((s["at"] + _exponential("__v", "__tree", j) / (F.col("__n") - j + 1)).alias("at"),
                              F.concat(s["all"], F.array(s["at"] + _exponential("__v", "__tree", j) / (F.col("__n") - j + 1))).alias("all")),
        lambda s: s["all"])
    copies = F.when(F.col("__n") > 1, more).otherwise(F.array("__h"))
    drawn = each.select(*cols, "__tree", F.explode(copies).alias("__h")).where(F.col("__h") < bound)
    # a few hundred rows a tree are left
    nth = Window.partitionBy("__tree").orderBy("__h", *cols)
    return drawn.withColumn("__nth", F.row_number().over(nth)).where(F.col("__nth") <= psi).select("__tree", "__h", *cols)


def _tree_builder(cols: list[str], max_samples: int, seed: int):
    max_depth = int(math.ceil(math.log2(max(max_samples, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["__tree"].iloc[0])
        x = pdf.sort_values(["__h", *cols])[cols].to_numpy(dtype=float)
        rng = np.random.default_rng(seed + tree)
        nodes = _grow(x, rng, max_depth)
        return pd.DataFrame({
            "tree": tree, "node": np.arange(len(nodes), dtype="int32"),
            "feat": [n[0] for n in nodes], "thr": [n[1] for n in nodes],
            "left": [n[2] for n in nodes], "right": [n[3] for n in nodes],
            "size": [n[4] for n in nodes]})
    return grow


def _scorer(cols: list[str], forest: pd.DataFrame, max_samples: int):
    trees = []
    for _, t in forest.groupby("tree"):
        t = t.sort_values("node")
        leaf_adj = np.array([avg_path(s) for s in t["size"]])
        trees.append((t["feat"].to_numpy(), t["thr"].to_numpy(), t["left"].to_numpy(),
                      t["right"].to_numpy(), leaf_adj))
    norm = avg_path(max_samples)

    def score(batches):
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype=float)
            total = np.zeros(len(x))
            for feat, thr, left, right, adj in trees:
                node = np.zeros(len(x), dtype=int)
                depth = np.zeros(len(x))
                active = feat[node] >= 0
                while active.any():
                    f = feat[node[active]]
                    go_left = x[np.flatnonzero(active), f] < thr[node[active]]
                    node[active] = np.where(go_left, left[node[active]], right[node[active]])
                    depth[active] += 1
                    active = feat[node] >= 0
                total += depth + adj[node]
            mean_path = total / len(trees)
            pdf["__iso_score"] = np.power(2.0, -mean_path / norm) if norm > 0 else 0.5
            yield pdf
    return score


def isolation_scores(df: DataFrame, cols: list[str], n_trees: int = 100, max_samples: int = 256,
                     seed: int = C.SEED, n: int | None = None) -> DataFrame:
    """Add ``__iso_score`` (higher = more isolated) for the feature columns
    (nulls filled with the column median first)."""
    meds = quantiles(df, {c: [0.5] for c in cols})
    filled = df.withColumns({f"__f{i}": F.coalesce(F.col(f"`{c}`").cast("double"),
                                                    F.lit(meds[c][0] if meds[c][0] is not None else 0.0))
                             for i, c in enumerate(cols)})
    fcols = [f"__f{i}" for i in range(len(cols))]
    n = n if n is not None else filled.count()
    psi = min(max_samples, n)
    counted = filled.groupBy(*fcols).agg(F.count("*").alias("__n"))
    forest = (sample_rows(counted, fcols, n_trees, n, psi, seed)
              .groupBy("__tree").applyInPandas(_tree_builder(fcols, psi, seed), TREE_SCHEMA)
              .toPandas())  # trees x nodes, bounded by n_trees and max_samples
    out_schema = T.StructType(filled.schema.fields + [T.StructField("__iso_score", T.DoubleType())])
    scored = filled.mapInPandas(_scorer(fcols, forest, psi), out_schema)
    return scored.drop(*fcols)


def flag_outliers(df: DataFrame, key_cols: list[str] | None = None,
                  contamination: float = C.ISOLATION_CONTAMINATION) -> tuple[DataFrame, int]:
    """Adaptive M11: needs >= 2 numeric non-key columns and >= 50 rows; the flag
    column ``_is_outlier`` is kept only when under 10% of rows are flagged."""
    from pyspark.sql.types import NumericType
    keys = key_cols or ["tenure", "MonthlyCharges", "TotalCharges", "Churn", "Churn_Prob", "Predicted_CLV"]
    others = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in keys]
    if len(others) < 2:
        return df, 0
    n = df.count()
    if n < C.ISOLATION_MIN_ROWS:
        return df, 0
    from tidemark.session import materialize
    # scored twice below (cut, count): write it once instead of re-running the trees
    scored = materialize(isolation_scores(df, others, n=n), "checkpoint")
    cut = quantiles(scored, {"__iso_score": [1 - contamination]})["__iso_score"][0]
    flagged = scored.withColumn("_is_outlier", (F.col("__iso_score") > F.lit(cut)).cast("int"))
    count = flagged.agg(F.sum("_is_outlier")).first()[0] or 0
    if 0 < count < n * 0.1:
        return flagged.drop("__iso_score"), count
    return df, 0
