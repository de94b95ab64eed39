import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import mixing as M


def by_source(rows, key):
    out = defaultdict(int)
    for r in rows:
        out[r.source] += r[key]
    return out


def test_targets_by_water_filling():
    got = M.targets([("a", 100), ("b", 100), ("c", 100), (None, 100)])
    assert sum(got.values()) == pytest.approx(600) and got["a"] == 200 and got[None] == 200
    assert got["b"] / got["c"] == pytest.approx(2)
    assert M.targets([]) == {} and M.targets([("a", 0)]) == {"a": 0.0}


def test_splitting_tree_keeps_quotas_exactly():
    quotas = np.array([1000, 3, 0, 517, 80])
    got = M.split_quotas(quotas, 13, np.random.default_rng(1))
    assert (got.sum(0) == quotas).all() and got.sum(1).max() - got.sum(1).min() <= 1 and (got >= 0).all()
    share = np.mean([M.split_quotas(quotas, 2, np.random.default_rng(i))[0] for i in range(300)], axis=0)
    assert np.abs(share - quotas / 2).max() < 3


def test_taken_words(small):
    docs = {r.doc_id: r for r in small.collect()}
    rows = M.taken_words(small).collect()
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in docs.items()}
    want = M.targets(list(by_source([type("R", (), {"source": docs[i].source, "__getitem__": lambda s, k, n=n: n})() for i, n in sizes.items()], "n").items()))
    taken, total = defaultdict(int), sum(sizes.values())
    for r in rows:
        s = docs[r.doc_id].source
        assert r.size == sizes[r.doc_id] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert len(rows) == len(docs)
    assert all(abs(taken[s] - want[s]) <= 0.02 * total for s in want)


def test_mix_holds_the_taken_copies(small):
    taken = {r.doc_id: r.taken // r.size for r in M.taken_words(small).collect() if r.size}
    copies = Counter(r.doc_id for r in M.mix(small).collect())
    assert copies == {i: n for i, n in taken.items() if n}
    again = Counter(r.doc_id for r in M.mix(small.repartition(5)).collect())
    assert again == copies


def test_edges(edge, nothing):
    rows = M.taken_words(edge).collect()
    assert len(rows) == edge.count() and all(r.taken <= 2 * r.size for r in rows)
    out = M.mix(edge)
    assert out.columns == edge.columns
    sizes = Counter((r.doc_id, r.size) for r in rows if r.size)
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in out.collect()) == sum(r.taken for r in rows) and sizes
    assert M.taken_words(nothing).count() == 0 and M.mix(nothing).count() == 0


def test_tables_of_the_driver_need_no_python_workers(small):
    sources, plan, _ = M._plan(M._sized(small, M.SEED), M.SEED, None)
    for table in (sources, plan):
        assert "ExistingRDD" not in table._jdf.queryExecution().executedPlan().toString()
    assert dict(plan.dtypes) == {"source_no": "int", "block": "bigint", "turn": "int", "room": "bigint", "shard": "int"}
