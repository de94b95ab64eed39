import random

import numpy as np
import pytest

from tidemark.llm import pieces as P


@pytest.fixture(scope="module")
def v():
    return P.load_vocabulary()


def every(v, s):
    """All segmentations (score, ids, negative lengths from the end)."""
    if not s:
        return [(0.0, (), ())]
    out = []
    for d in range(1, len(s) + 1):
        i = v.ids.get(s[-d:])
        if i is None and d > 1:
            continue
        w, i = (v.unknown, len(v.pieces) + ord(s[-1])) if i is None else (v.scores[i], i)
        out += [(a + w, p + (i,), (-d,) + n) for a, p, n in every(v, s[:-d])]
    return out


def test_n_best_against_all_segmentations(v):
    rng = random.Random(3)
    for _ in range(150):
        s = P.SPACE + "".join(rng.choice("aehinrst.é") for _ in range(rng.randint(1, 8)))
        want = sorted(every(v, s), key=lambda x: (-x[0], x[2]))[:6]
        assert P.n_best(v, s, 6) == [(a, p) for a, p, _ in want]


def test_many_at_once_equals_one_by_one(v):
    rng = random.Random(4)
    chunks = sorted({P.SPACE + "".join(rng.choice("abcdeinorstuñ→") for _ in range(rng.randint(0, 20))) for _ in range(400)})
    best, loss, flat, length = P._best_many(v, chunks)
    ends = np.cumsum(length)
    for i, c in enumerate(chunks):
        one = P._best_one(v, c)
        assert one == (best[i], loss[i], tuple(flat[ends[i] - length[i]:ends[i]].tolist()))
        two = P.n_best(v, c, 2)
        assert two[0][0] == best[i] and (len(two) == 1 or two[0][0] - two[1][0] == loss[i])


def test_text_n_best_is_exact_over_chunks(v):
    text = "the cat\nsat tea"
    _, score, found = next(P.Encoder(v, 5).encode_all([text]))
    combos = [0.0]
    for c in v.chunk.findall(P.escape(text)):
        combos = [a + b[0] for a in combos for b in every(v, c)]
    assert [s for s, _ in found] == sorted(combos, reverse=True)[:5] and score == max(combos)


@pytest.mark.parametrize("text", ["", " ", "a", "  two  spaces ", "▁ literal ▁▁", "\x00\x01", "ab", "日本語 😀 ñ\r\n\tend ", "x" * 500, "é" * 100])
def test_round_trip_of_all_segmentations(v, text):
    e = P.Encoder(v)
    ids, _, found = next(e.encode_all([text]))
    assert e.decode(ids) == text == P.decode(v, ids.tolist())
    for _, changes in found:
        assert P.decode(v, e.with_changes(text, changes)) == text


def test_forgetting_changes_nothing(v, monkeypatch, small):
    texts = [r.text for r in small.limit(30).collect()]
    want = [(i.tolist(), s, f) for i, s, f in P.Encoder(v).encode_all(texts)]
    monkeypatch.setattr(P, "CACHE", 50)
    monkeypatch.setattr(P, "STEP", 1000)
    assert [(i.tolist(), s, f) for i, s, f in P.Encoder(v).encode_all(texts)] == want


def test_table_and_edges(small, edge, nothing):
    rows = P.encode_digest(small).collect()
    assert len(rows) == small.count() and all(r.round_trip and r.best_scores[0] == r.score for r in rows)
    assert all(r.best_scores == sorted(r.best_scores, reverse=True) for r in rows)
    full = P.encode(edge)
    back = sorted(((r.doc_id or 0, r.text) for r in P.decode_ids(full).collect()))
    assert back == sorted((r.doc_id or 0, r.text or "") for r in edge.collect())
    assert P.encode(nothing).count() == 0

def test_a_worker_holds_few_rows_and_a_bounded_cache(v, monkeypatch):
    import pyarrow as pa

    batch = pa.record_batch([pa.array([f"{i} " * 50 for i in range(1000)])], names=["text"])
    monkeypatch.setattr(P, "STEP", 2000)
    parts = list(P._small([batch]))
    assert sum(p.num_rows for p in parts) == 1000 and max(p.num_rows for p in parts) <= 40
    monkeypatch.setattr(P, "CACHE", 200)
    coder = P.Encoder(v)
    for _ in coder.encode_all(batch.column("text").to_pylist()):
        assert len(coder.slot) <= 200
    first = set(list(coder.slot)[:100])
    assert {P.SPACE + str(i) for i in range(90)} <= first  # the older half stays
    monkeypatch.setattr(P, "CACHE_CHARS", 5000)
    list(coder.encode_all([chr(97 + i) * 4000 for i in range(5)]))
    assert coder.chars <= 5000 + 4001
