import math

import numpy as np

from tidemark.llm import top_k as K


def brute(rows, k=K.K, every=K.EVERY):
    v = {}
    for i, x in rows:
        if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            v[i] = [math.floor(256 * c) for c in x]
    out = set()
    for q in v:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:k]
            out |= {(q, r + 1, c, -n) for r, (n, c) in enumerate(s)}
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 40)
    monkeypatch.setattr(K, "SLOT", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(400)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert set(map(tuple, K.top_k_of_table(df).collect())) == brute(rows)


def test_edges(spark):
    rows = [(0, [1.0, -2.0]), (1, None), (2, [float("nan"), 1.0]), (3, [1.0, None]), (50, [0.5]), (None, [1.0, 1.0]),
            (4, [float("inf"), 0.0]), (5, [-1.0, 0.25]), (100, [1e6, -1e6]), (6, [3e6, 1e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as q", "'y' as slot", "1 as score")
    assert set(map(tuple, K.top_k_of_table(df).collect())) == brute(rows)
    assert K.top_k_of_table(df.limit(0)).count() == 0


def test_blocks_of_a_slot_are_spread(spark, monkeypatch):
    monkeypatch.setattr(K, "TOGETHER", 2)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 4)]) for i in range(400)]
    seen = spark.sparkContext.accumulator(0)
    gather = K._gather

    def counted(k):
        run = gather(k)

        def one(batches):
            batches = list(batches)
            seen.add(1 if sum(b.num_rows for b in batches) else 0)
            yield from run(batches)

        return one

    monkeypatch.setattr(K, "_gather", counted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = set(map(tuple, K.top_k_of_table(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(12)).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows) and seen.value > 2  # one slot, several tasks
