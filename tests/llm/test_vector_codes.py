import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import vector_codes as V


def brute(rows, entries=V.ENTRIES):
    """Plain nested loops over Python integers."""
    kept = sorted(((i, lab, [math.floor(V.SCALE * x) for x in v]) for i, v, lab in rows
                   if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0], r[2]))
    width = len(kept[0][2]) // 4
    cut = [[v[p * width:(p + 1) * width] for p in range(4)] for _, _, v in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(4)]

    def near(p, part):
        d = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(V.ROUNDS):
        for p in range(4):
            got = defaultdict(list)
            for c in cut:
                got[near(p, c[p])[0]].append(c[p])
            for e, members in got.items():
                books[p][e] = [sum(col) // len(members) for col in zip(*members)]
    out, by_label = [], defaultdict(int)
    for (i, lab, _), c in zip(kept, cut):
        pairs = [near(p, c[p]) for p in range(4)]
        out.append((i, "".join(f"{e:02x}" for e, _ in pairs), sum(d for _, d in pairs), lab))
        by_label[lab] += out[-1][2]
    sha = V.digest([np.array(b, object) for b in books])
    return sorted((i, c, e, by_label[lab], sha) for i, c, e, lab in out)


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumns(
        {c: F.lit("x") for c in ("v", "code", "error", "pos", "part", "n", "entry", "d")})


def result(df):
    return sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in V.code_digest(df).collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in np.float32(rng.normal(0, 0.2, 8))], [None, 1, 2][i % 3]) for i in range(330)]
    rows += [(1000 + i, rows[5][1], 7) for i in range(40)]  # a common vector
    rows += [(2000, None, 1), (2001, [0.1, None] * 4, 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] + [0.0] * 7, 1)]
    got = result(table(spark, rows).repartition(3))
    assert got == brute(rows)
    assert got == result(table(spark, rows).repartition(7))


def test_trie_equals_plain_argmin():
    rng = np.random.default_rng(1)
    for depth, spread, leaves in ((1, 9, 3), (3, 4, 5), (5, 300, 16), (4, 2, 1), (16, 3, 512)):
        parts = np.unique(rng.integers(-spread, spread, (700, depth)), axis=0)
        book = rng.integers(-spread, spread, (40, depth))
        entry, distance = V.nearest(parts, book, leaves)
        every = ((parts[:, None, :] - book[None]) ** 2).sum(2)
        assert (entry == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_ties_go_to_the_lower_entry():
    entry, distance = V.assign(np.array([[2, 2], [2, 2], [0, 0]]), np.array([[4, 2], [0, 2], [2, 4]]))
    assert entry.tolist() == [0, 0, 1] and distance.tolist() == [4, 4, 4]


def test_components_beyond_64_bits(spark):
    rows = [(i, [float(i), 1e6 * i, -2e5, 3e7], 1) for i in range(9)] + [(9, [1e30, -1e30, 0.0, 1.0], 2)]
    got = V.code_digest(table(spark, rows, "double")).collect()
    assert len(got) == 10 and all(r.error is not None and r.error >= 0 for r in got)
    plain = rows[:9]
    assert result(table(spark, plain, "double")) == brute(plain)


def test_edges(spark):
    assert V.code_digest(table(spark, [])).count() == 0
    rows = [(1, [0.5] * 4, 1), (1, [0.25] * 4, 1), (1, [0.25] * 4, None), (None, [0.1] * 4, None), (5, [0.1] * 3, 1), (6, [], 2)]
    got = {(r.vec_id, r.code is None, r.error) for r in V.code_digest(table(spark, rows)).collect()}
    assert (5, True, None) in got and (6, True, None) in got and (1, False, 0) in got and len(V.code_digest(table(spark, rows)).collect()) == 6
    empty = [(1, [], 1), (2, [], 1)]
    assert {r.code for r in V.code_digest(table(spark, empty)).collect()} <= {None, "00000000"}


@pytest.mark.parametrize("spread", [2, 500])
def test_rounds_with_unused_entries(spark, spread):
    rng = np.random.default_rng(spread)
    rows = [(int(i), [float(x) / 1024 for x in rng.integers(0, spread, 4)], int(i % 2)) for i in range(300)]
    assert result(table(spark, rows)) == brute(rows)
