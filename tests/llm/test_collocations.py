import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import collocations as C
from tests.llm.conftest import edge_docs


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
        if words := re.findall(r"[^\x20\x09]+", piece):
            yield words


def brute(rows, support, longest=5, best=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        frequent = {p: c for p, c in counts.items() if c >= support}
        explained = set()
        for p, c in frequent.items():
            for j in range(2, len(p)):
                for i in range(len(p) - j + 1):
                    if 100 * c >= 100 * counts[p[i:i + j]]:
                        explained.add(p[i:i + j])
        rows_ = []
        for p, a in frequent.items():
            if len(p) < 2 or p in explained:
                continue
            score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows_)[:best], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def result(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("support,best", [(20, 2000), (3, 50)])
def test_against_brute_force(small, support, best):
    rows = [(r.lang, r.text) for r in small.collect()]
    want = brute(rows, support, best=best)
    assert want and result(C.collocations(small.repartition(6), support, best=best)) == want


def test_segments_do_not_change_counts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a", "Bb", "ccc", "d\td", "é"], 400)) for _ in range(6)]
    texts += ["x y. " * 200, "z" * 500 + " " + "p q r s t u " * 50, "no break here, " * 40, "\n".join(["one two three"] * 60)]
    docs = spark.createDataFrame([(None if i % 4 == 0 else "en", t) for i, t in enumerate(texts)], "lang string, text string")
    want = brute([(r.lang, r.text) for r in docs.collect()], 15)
    assert want == result(C.collocations(docs, 15))
    for size in (23, 64, 300):
        for t in texts:
            whole = Counter(tuple(w[i:i + k]) for w in pieces(t) for k in range(1, 6) for i in range(len(w) - k + 1))
            cut = Counter()
            for part, carried in C.segments(t.encode().lower(), size):
                left = carried
                for w in pieces(part.decode()):
                    for k in range(1, 6):
                        cut.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1) if i + k > left)
                    left = max(0, left - len(w))
            assert cut == whole


def test_local_supports_lose_nothing(spark, monkeypatch):
    # a phrase spread thinly over all shards, beside one that lives in a single partition
    docs = spark.createDataFrame([("en", f"thin spread phrase w{i} v{i}") for i in range(60)] +
                                 [("en", "only here, only here, only here") for _ in range(10)], "lang string, text string")
    for parts in (1, 13, 40):
        got = {r.phrase: r.a for r in C.collocations(docs.repartition(parts), 30).collect()}
        assert got == {"thin spread phrase": 60, "only here": 30}


def test_words_of_bytes():
    start, end, h, first = C.tokens(np.frombuffer(b"one two. one\ttwo", np.uint8), C.Powers())
    assert start.tolist() == [0, 4, 9, 13] and end.tolist() == [3, 7, 12, 16]
    assert first.tolist() == [True, False, True, False] and h[0] == h[2] and h[1] == h[3] != h[0]


def test_edges(spark, edge, nothing):
    rows = [(r.lang, r.text) for r in edge.collect()]
    assert result(C.collocations(edge, 2)) == brute(rows, 2)
    assert C.collocations(nothing).count() == 0
    assert C.collocations(edge_docs(spark, [(1, None, None, None), (2, " .,;\n", "en", "s")]), 1).count() == 0
