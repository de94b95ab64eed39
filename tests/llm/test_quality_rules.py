import math
import re

import xxhash
from pyspark.sql import functions as F

from tidemark.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    many = {x for x in windows if windows.count(x) > 1} if len(w) < 3000 else None
    if many is None:
        seen, many = set(), set()
        for x in windows:
            (many if x in seen else seen).add(x)
    covered = {i + j for i, x in enumerate(windows) if x in many for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def buckets(text):
    tok = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[!-/:-@\[-`{-~]+", text or "")
    h = [xxhash.xxh64_intdigest(t.encode(), seed=42) for t in tok]
    two = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), seed=xxhash.xxh64_intdigest(a.to_bytes(8, "little"), seed=42))
           for a, b in zip(h, h[1:])]
    return [signed(x) % Q.BUCKETS for x in h + two]


def test_against_brute_force(small, labels):
    got = {r.doc_id: r for r in Q.quality_rules(small, labels).collect()}
    texts = {r.doc_id: r.text for r in small.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    raw, target = [Q.SMOOTHING] * Q.BUCKETS, [Q.SMOOTHING] * Q.BUCKETS
    grams = {i: buckets(t) for i, t in texts.items()}
    for i, g in grams.items():
        for b in g:
            raw[b] += 1
            target[b] += i in good
    n_raw, n_target = sum(raw), sum(target)
    ratio = [math.log(t / n_target) - math.log(r / n_raw) for t, r in zip(target, raw)]
    assert len(got) == len(texts)
    for i, t in texts.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t)
        llr = sum(ratio[b] for b in grams[i]) / max(1, len(grams[i]))
        assert math.isclose(r.llr, llr, abs_tol=1e-9)
        assert r.kept == (not r.base_failed and llr >= Q.THRESHOLD)


def test_labels_agree(small, labels):
    q = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in Q.quality_rules(small, labels).collect() if r.doc_id in q and not r.base_failed]
    assert rows and all(r.kept == (q[r.doc_id] == 1) for r in rows)


def test_edges(edge, nothing, labels):
    rows = Q.quality_rules(edge, labels).collect()
    want = sorted(base(r.text) for r in edge.collect())
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    kept = Q.keep_good(edge, labels)
    assert kept.columns == edge.columns and kept.count() == sum(r.kept for r in rows)
    assert Q.quality_rules(nothing, labels).count() == 0
    assert Q.quality_rules(edge, labels.limit(0)).filter("llr <> 0").count() == 0


def test_marks_pass_over_no_trusted_id(spark):
    ids = spark.range(0, 90_000, 7).withColumnRenamed("id", "t_id")
    every = spark.range(90_000).withColumn("maybe", Q._marked(F.col("id"), Q._marks(ids)))
    assert every.filter("id % 7 = 0 and not maybe").count() == 0
    assert every.filter("id % 7 <> 0 and maybe").count() < 900
    assert spark.range(10).filter(Q._marked(F.col("id"), Q._marks(ids.limit(0)))).count() == 0
