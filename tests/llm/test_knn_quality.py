from zlib import crc32

import numpy as np

from tidemark.llm import knn_quality as K


def test_held_out_accuracy_and_folds(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = K.score(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    q = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in q]
    assert np.mean([r.predicted == q[r.doc_id] for r in held]) > 0.93


def test_blocked_scores_equal_plain_votes():
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(80, K.FEATURES + K.EXTRA))).astype(np.float32)
    y = rng.integers(0, 2, 80)
    m = K.Neighbours(x, y)
    some = x[:5] + 0.01
    z = some @ m.basis
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for s, row in zip(m.scores(some), z):
        c = m.points @ row
        near = np.argsort(-c)[:K.K]
        w = np.maximum(c[near], 0).astype(float) ** 4
        assert abs(s - (w * y[near]).sum() / w.sum()) < 1e-4


def test_edges(edge, nothing, labels, spark):
    rows = K.score(edge, labels).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {None}
    assert {r.score for r in K.score(edge, labels.limit(0)).collect()} == {0.5}
    assert K.score(nothing, labels).count() == 0
    twisted = spark.createDataFrame([(7, 0), (7, 1), (None, 1), (8, None)], "doc_id long, quality int")
    assert {r.score for r in K.score(edge, twisted).collect()} == {0.5}
