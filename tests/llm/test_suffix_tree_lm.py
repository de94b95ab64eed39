import math
import re
from collections import Counter
from zlib import crc32

import numpy as np

from tidemark.llm import suffix_tree_lm as L
from tidemark.llm.common import text_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def toks(text):
    return WORD.findall((text or "").translate(LOWER)) + [None]


def check_base(rows, docs):
    counts = Counter()
    for i, t in docs:
        if i is not None and crc32(str(i).encode()) % 7 != 2:
            counts.update(toks(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((i or 0, len(x := toks(t)), sum(counts[w] > 0 for w in x),
                   round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x), 6)) for i, t in docs)
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-7, atol=1e-5)
    assert {r.train_tokens for r in rows} <= {n}


def test_base_and_gain_over_it(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = L.score(docs).collect()
    check_base(rows, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_words_outside_the_broadcast_table_count_by_join(small, monkeypatch):
    monkeypatch.setattr(L, "SYMBOL_SHARE", 1e-3)  # the same symbols in both runs
    want = sorted((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in L.score(small).collect())
    monkeypatch.setattr(L, "WORD_SHARE", 1e-3)  # most words now meet their counts by the join
    monkeypatch.setattr(L, "STEP", 500)
    got = sorted((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in L.score(small).collect())
    assert got == want


def test_probabilities_of_every_state_sum_to_one(spark):
    text = " ".join(["a b c"] * 300 + ["a d e"] * 200 + ["b b"] * 50)
    docs = spark.createDataFrame([(i, text + f" rare{i}") for i in range(20)], "doc_id long, text string")
    tree, _ = L.fit(docs.select(L.tokens(text_of()).alias("t")))
    assert tree.retained[0] > 0 and tree.retained[1] > 0
    n = tree.symbols.size
    for one in range(1, n + 2):
        for two in range(0, n + 2):
            total = 0.0
            for b in range(n + 1):
                p = tree._prob1(np.array([one]), np.array([b]), tree.keys1, tree.lam1, tree.val1)
                j = L._find(tree.pair_keys, np.array([two * L.WIDE + one]))
                if j[0] >= 0:
                    own = L._find(tree.keys2, j * L.WIDE + b)
                    p = tree.lam2[j] * p + (tree.val2[own] if own[0] >= 0 else 0)
                total += float(p[0])
            assert math.isclose(total, 1, rel_tol=1e-9)


def test_edges(edge, nothing):
    rows = L.score(edge).collect()
    check_base(rows, [(r.doc_id, r.text) for r in edge.collect()])
    assert all(math.isfinite(r.score) for r in rows)
    assert L.score(nothing).count() == 0
    unlearnt = L.score(edge.filter("doc_id is null")).collect()
    assert len(unlearnt) == 2 and all(r.base_score == 0 and r.train_tokens == 0 for r in unlearnt)


def brute_force(texts):
    """log10 of each text's probability and the greatest length of a context, by tuples."""
    docs = [["<s>"] + [w or "</s>" for w in toks(t)] for t in texts]
    words = Counter(w for d in docs for w in d[1:])
    norm = sum(words.values()) + len(words) + 1
    keep, tried, k = {(): None}, {()}, 0

    def p(c, w):
        if not c:
            return (words[w] + 1) / norm
        lam, own = keep.get(c, (1, {}))
        return lam * p(c[1:], w) + own.get(w, 0)

    while tried:
        k += 1
        grams = Counter((tuple(d[i - k:i]), d[i]) for d in docs for i in range(k, len(d)))
        held, nexts = Counter(), {}
        for (c, w), n in grams.items():
            held[c] += n
            if n >= 5 and c[1:] in tried and (c[1:] in keep or c[2:] in keep):
                nexts.setdefault(c, {})[w] = n
        found = {}
        for c, of in nexts.items():
            n, q, df = held[c], {w: p(c[1:], w) for w in of}, len(of)
            g, rest = sum(m * math.log(m / n / q[w]) for w, m in of.items()), n - sum(of.values())
            if rest:
                g += rest * math.log(rest / n / max(1 - sum(q.values()), 1e-12))
            if 2 * g > df + 4 * math.sqrt(2 * df) + 10:
                found[c] = 1 - sum((m - 0.75) / n for m in of.values()), {w: (m - 0.75) / n for w, m in of.items()}
        keep.update(found)
        tried = set(nexts)
    return [sum(math.log10(p(tuple(d[max(0, i - k):i]), d[i])) for i in range(1, len(d))) for d in docs], max(map(len, keep))


def chained():
    """Texts whose words mostly follow from the three before."""
    import random

    rng = random.Random(5)
    follows = {(a, b, c): rng.choice("abcd") for a in "abcd" for b in "abcd" for c in "abcd"}
    texts = []
    for i in range(150):
        w = [rng.choice("abcd") for _ in range(3)]
        while len(w) < 40:
            w.append(follows[tuple(w[-3:])] if rng.random() < 0.8 else rng.choice("abcd"))
        texts.append(" ".join(w + [f"once{i}"]))
    return texts


def test_score_against_brute_force(spark):
    texts = chained()
    want, depth = brute_force(texts)
    ids = [i for i in range(3000) if crc32(str(i).encode()) % 7 != 2][:len(texts)]
    got = {r.doc_id: r.score for r in L.score(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")).collect()}
    assert depth > 2
    assert np.allclose([got[i] for i in ids], want, rtol=1e-9)


def test_no_share_of_the_corpus_cuts_what_is_retained(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(chained())), "doc_id long, text string")
    want = sorted((r.doc_id, round(r.score, 6)) for r in L.score(docs).collect())
    for share in ("SYMBOL_SHARE", "PAIR_SHARE", "EDGE_SHARE", "WORD_SHARE"):
        monkeypatch.setattr(L, share, 0.05)
    assert sorted((r.doc_id, round(r.score, 6)) for r in L.score(docs).collect()) == want
    # what a corpus retains stays retained when the corpus is doubled
    train = docs.select(L.tokens(text_of()).alias("t"))
    contexts = [{r.context for level in L.grow(t)[3] for r in level.filter("retained").select("context").collect()}
                for t in (train, train.union(train))]
    assert contexts[0] and contexts[0] <= contexts[1]


def runs_and_rests():
    """Runs of one word whose length tells the word after them: each longer context rules one out."""
    return [" ".join(["w"] * n + [f"after{n}"]) for n in range(1, 35) for _ in range(50)]


def test_long_contexts_grow_in_few_rounds(spark, monkeypatch):
    texts = runs_and_rests()
    want, depth = brute_force(texts)
    assert depth > 30
    ids = [i for i in range(3000) if crc32(str(i).encode()) % 7 != 2][:len(texts)]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    grown, grow = [], L.grow
    monkeypatch.setattr(L, "grow", lambda train: grown.append(grow(train)) or grown[0])
    got = {r.doc_id: r.score for r in L.score(docs).collect()}
    assert len(grown[0][3]) <= 12  # a round of jobs for each length before
    assert np.allclose([got[i] for i in ids], want, rtol=1e-9)


def test_counts_travel_packed_and_are_whole(spark, monkeypatch):
    rng = np.random.default_rng(3)
    docs = [[int(x) for x in rng.integers(-2**63, 2**63 - 1, 40) // 2**55 * 2**55] for _ in range(300)]
    train = spark.createDataFrame([(d,) for d in docs], "t array<long>").repartition(5)
    want = Counter(x for d in docs for x in d)
    frame = L._summed(train, lambda words: [words], ["hash", "c"], 3, 2, 50, L._words)  # tasks send often
    assert {r.hash: r.c for r in frame.collect()} == {k: n for k, n in want.items() if n >= 2}
    monkeypatch.setattr(L, "SENT", 7)
    assert {r.hash: r.c for r in frame.collect()} == {k: n for k, n in want.items() if n >= 2}
    # no row for each key and task is built and shuffled
    assert len(train.mapInArrow(L._packed(lambda words: [words], ["hash", "c"], 4, 10**6, L._words), "part long, hash binary, c binary").collect()) <= 20


def test_shuffles_of_written_tables_go_at_once(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen = spark.conf.get(key), []
    real = L.spill
    L.spill = lambda df, tag, **o: seen.append(spark.conf.get(key)) or real(df, tag, **o)
    try:
        assert L._written(spark.range(10).repartition(3, "id"), "some").count() == 10
    finally:
        L.spill = real
    assert seen == ["true"] and spark.conf.get(key) == before


def test_tokens_of_plain_and_other_texts(spark):
    texts = ["AbC dEf\tG", "ÀÉ İ AbC", "", "Z\x00Z ſK \x1fQ"]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    want = [[r.h for r in spark.createDataFrame([(i, w or "") for i, w in enumerate(toks(t))], "i int, w string")
             .selectExpr("i", "xxhash64(w) h").orderBy("i").collect()] for t in texts]
    assert [r.t for r in d.select(L.tokens(text_of()).alias("t")).collect()] == want


def test_tables_that_nothing_reads_any_more_go(spark):
    import os
    from urllib.parse import urlparse

    folder = urlparse(spark.sparkContext.getCheckpointDir() or L.ready(spark) or spark.sparkContext.getCheckpointDir()).path
    before = set(os.listdir(folder))
    texts = chained()
    ids = [i for i in range(3000) if crc32(str(i).encode()) % 7 != 2][:len(texts)]
    rows = L.score(spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string"))
    left = sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before if x.startswith(("lm-", "word-counts")))
    assert left == ["lm-tokens", "lm-values"]
    got = {r.doc_id: r.score for r in rows.collect()}
    assert np.allclose([got[i] for i in ids], brute_force(texts)[0], rtol=1e-9)


def test_values_that_are_not_broadcast_meet_their_texts_packed(spark, monkeypatch):
    texts = chained()
    want, _ = brute_force(texts)
    ids = [i for i in range(3000) if crc32(str(i).encode()) % 7 != 2][:len(texts)]
    rows = [*zip(ids, texts), (None, texts[0]), (None, None)]
    monkeypatch.setattr(L, "HOT", 0)  # every value is asked for
    monkeypatch.setattr(L, "STEP", 700)
    monkeypatch.setattr(L, "SENT", 50)
    frame = L.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = frame.collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 2
    scores = {r.doc_id: r.score for r in got}
    assert np.allclose([scores[i] for i in ids], want, rtol=1e-9)
    check_base(got, rows)
    # no row for each text and value is built, sorted and joined
    assert "Join" not in frame._jdf.queryExecution().executedPlan().toString()
