"""The forest over cells against MLlib's over rows."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators import forest, ml

COLS = C.CORE_FEATURES


def table(spark, n=4000):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, len(COLS)))
    x[:, 1] = rng.integers(0, 3, n)
    x[:, 2] = rng.integers(0, 2, n) * (rng.random(n) < 0.02)  # a rare value
    p = 1 / (1 + np.exp(-2 * x[:, 0] - 2 * (x[:, 1] - 1) - x[:, 3] * x[:, 4]))
    rows = [(i, *map(float, r), float(y)) for i, (r, y) in enumerate(zip(x, rng.random(n) < p))]
    return spark.createDataFrame(rows, ", ".join(["id long", *(f"{c} double" for c in COLS), "Churn double"]))


def fitted(df, monkeypatch, rows, trees=60, depth=6):
    monkeypatch.setattr(forest, "ROWS", rows)
    train, _ = ml.class_weights(df)
    train = VectorAssembler(inputCols=COLS, outputCol="features", handleInvalid="keep").transform(train)
    small = RandomForestClassifier(labelCol="Churn", weightCol="__w", seed=3, numTrees=trees, maxDepth=depth)
    model = forest.ForestClassifier(small, COLS, df, df.count(), "Churn", "__w", trees, depth, 3).fit(train)
    out = model.transform(train).select("id", "Churn", "prediction", vector_to_array("probability")[1].alias("p"), vector_to_array("rawPrediction")[1].alias("raw"))
    return model, out.toPandas().set_index("id").sort_index()


def test_scores_are_those_of_mllib_up_to_the_draws(spark, monkeypatch):
    df = table(spark).cache()
    _, want = fitted(df, monkeypatch, 10**6)
    model, got = fitted(df, monkeypatch, 0)
    assert isinstance(model, forest.CellForest) and not isinstance(_, forest.CellForest)
    assert len(got) == len(want) == 4000 and got.p.between(0, 1).all() and np.allclose(got.raw, 60 * got.p)
    assert (got.prediction == (got.p > 0.5)).all()
    assert np.corrcoef(got.p, want.p)[0, 1] > 0.98 and (got.p - want.p).abs().mean() < 0.03
    for one in (got, want):
        assert ((one.p > 0.5) == one.Churn).mean() > 0.8
    # the same wherever the rows lie
    _, again = fitted(df.repartition(5, "Churn"), monkeypatch, 0)
    assert (again.p == got.p).all()


def test_missing_values_are_a_bin_of_their_own(spark, monkeypatch):
    x = F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 5 == 1, float("nan")).otherwise(F.col(COLS[0]))
    df = table(spark, 500).withColumn(COLS[0], x).withColumn("Churn", (F.col("id") % 5 < 2).cast("double"))
    _, got = fitted(df, monkeypatch, 0, 20, 4)
    assert ((got.p > 0.5) == got.Churn).all() and got.p[got.index % 5 < 2].min() > got.p[got.index % 5 > 1].max()


def test_many_cells_are_left_to_mllib(spark, monkeypatch):
    monkeypatch.setattr(forest, "CELLS", 10)
    model, got = fitted(table(spark, 300), monkeypatch, 0, 5, 3)
    assert not isinstance(model, forest.CellForest) and len(got) == 300


def test_large_tables_do_not_pass_every_row_through_every_tree(spark, monkeypatch):
    monkeypatch.setattr(forest, "ROWS", 100, raising=False)
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *a: pytest.fail("rows were passed through the trees"))
    monkeypatch.setattr(C, "CORE_RF", {"numTrees": 40, "maxDepth": 8})
    scored, note, acc, auc = ml.core_model(table(spark), "auto", False, 4000)
    assert note == "Random Forest" and acc > 0.7 and auc > 0.8 and scored.count() == 4000


def test_a_tree_without_draws(monkeypatch):
    class Given:
        random = staticmethod(lambda size: np.tile(np.arange(size[1]), (size[0], 1)))

    # one of two features a node: the first
    bins = np.array([[0, 0, 1, 1, 2, 2], [0, 1, 0, 1, 0, 1]], np.uint8)
    one = np.array([0.0, 0, 3, 4, 9, 8])
    monkeypatch.setattr(forest.math, "sqrt", lambda n: 1.0)
    feature, cut, left, share = forest.grow(bins, 10 - one, one, 3, Given)
    assert feature[0] == 0 and cut[0] == 1 and np.isclose(share[0], 24 / 60)
    p = forest.shares([(feature, cut, left, share)], np.array([0, 1, 2]), 1, 3)
    assert np.allclose(p, [0.175, 0.175, 0.85])  # siblings of one prediction are one leaf
