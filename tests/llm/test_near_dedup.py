from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import near_dedup as N
from tidemark.llm.common import text_of, word_hashes
from tidemark.llm.graph import components, joined


def brute(docs):
    hashed = docs.select("doc_id", word_hashes(text_of()).alias("h"))
    idf = N.log_idf_table(hashed)
    sets = {r.doc_id: N.shingles(np.array(r.h, np.int64)) for r in hashed.collect()}
    holders = defaultdict(list)
    for i, (h, _) in sets.items():
        for x in h.tolist():
            holders[x].append(i)
    pairs = {(a, b) for ids in holders.values() for a in ids for b in ids if a < b}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        if N.similarity(sets[a], sets[b], idf) >= N.SIMILARITY:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: root(i) for i in sets}


def test_classes_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) < 4000")
    got = {r.doc_id: r.class_id for r in N.near_classes(docs).collect()}
    want = brute(docs)
    lost = [i for i in want if got[i] != want[i]]
    assert len(got) == len(want) and len(lost) <= 0.01 * sum(want[i] != i for i in want)


def test_partitioning_does_not_matter(small):
    one = {r.doc_id: r.class_id for r in N.near_classes(small.coalesce(1)).collect()}
    many = {r.doc_id: r.class_id for r in N.near_classes(small.repartition(7)).collect()}
    assert one == many


def test_samples_agree_as_often_as_the_sets_are_similar():
    rng = np.random.default_rng(0)
    words = rng.integers(-2**62, 2**62, 400)
    other = words.copy()
    other[::40] = rng.integers(-2**62, 2**62, 10)
    idf = np.zeros(N.IDF_BUCKETS)
    a, b = N.shingles(words), N.shingles(other)
    sample = N.Sampler(2000)
    same = np.mean(sample(a[0], N.log_weights(*a, idf)) == sample(b[0], N.log_weights(*b, idf)))
    assert abs(same - N.similarity(a, b, idf)) < 0.04
    long = N.shingles(rng.integers(-2**62, 2**62, 3 * N.CHUNK))
    assert len(sample(long[0], N.log_weights(*long, idf))) == 2000


def test_edges(edge, nothing):
    rows = N.near_classes(edge).collect()
    assert len(rows) == edge.count()
    got = {r.doc_id: r.class_id for r in rows}
    assert got[5] == got[4] == 4 and got[8] == got[7] == 7  # copies
    assert [got[i] for i in (1, 2, 3)] == [1, 2, 3]         # nothing to compare
    assert got[None] is None
    kept = N.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 6, 7, 9, 10, 11]
    assert N.near_classes(nothing).count() == 0 and N.keep_one(nothing).count() == 0


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 400)] + [(1, 2)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(200, 400)} == {7} and got[2] == 1


def test_further_links_join_classes(spark):
    links = [(1, 2), (3, 4), (5, 6), (7, 8)]
    more = [(2, 3), (9, 6), (10, 11)]
    schema = "a long, b long"
    classes = components(spark.createDataFrame(links, schema))
    got = dict(map(tuple, joined(classes, spark.createDataFrame(more, schema)).collect()))
    want = dict(map(tuple, components(spark.createDataFrame(links + more, schema)).collect()))
    assert got == want and got[4] == 1 and got[9] == 5 and got[11] == 10 and got[8] == 7


def test_a_family_in_a_mixed_bucket_is_still_found(spark):
    # many different texts that share a passage, two of them near copies
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [passage + " " + " ".join(f"w{rng.integers(10**6)}" for _ in range(200)) for _ in range(60)]
    texts[41] = texts[23] + " tail"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in N.near_classes(docs).collect()}
    assert got[41] == 23 and len(set(got.values())) == 59
    assert N.near_classes(docs).filter(F.col("n_links") > 0).count() == 2


def test_pairs_inside_a_family_around_one_passage_are_found(spark):
    # 160 texts share 70-90 % of their weight; 80 pairs of them are 0.8-0.9 similar, most heads of their keys are neither
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(700)]
    word = lambda n: [f"w{x}" for x in rng.integers(10**9, size=n)]
    own = [word(12) for _ in range(80)]
    texts = [" ".join(passage + own[i % 80] + word(10)) for i in range(160)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(docs)
    assert all(want[i] == i % 80 for i in want)
    assert {r.doc_id: r.class_id for r in N.near_classes(docs).collect()} == want


def test_no_pair_is_lost_by_the_bounds_of_the_search(spark, monkeypatch):
    # a family of 200 around a passage, 100 pairs of 0.8 and more; the search in sample orders looks at one row only
    monkeypatch.setattr(N, "TREES", 1)
    monkeypatch.setattr(N, "NEXT", 1)
    monkeypatch.setattr(N, "BEST", 1)
    rng = np.random.default_rng(11)
    passage = [f"p{i}" for i in range(500)]
    word = lambda n: [f"w{x}" for x in rng.integers(10**9, size=n)]
    own = [word(12) for _ in range(100)]
    texts = [" ".join(passage + own[i % 100] + word(9)) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(docs)
    assert len(set(want.values())) < 200
    assert {r.doc_id: r.class_id for r in N.near_classes(docs).collect()} == want


def test_prefixes_hold_every_similar_pair_and_few_others(spark):
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(60):  # texts with 1 to 12 words changed, around one base
        words = [f"b{i}" for i in range(1500)]
        for at in rng.integers(1500, size=rng.integers(1, 13)):
            words[at] = f"x{rng.integers(10**9)}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashed = docs.select("doc_id", word_hashes(text_of()).alias("h"))
    idf = N.log_idf_table(hashed)
    sets = {r.doc_id: N.shingles(np.array(r.h, np.int64)) for r in hashed.collect()}
    want = {(a, b) for a in sets for b in sets if a < b and N.similarity(sets[a], sets[b], idf) >= 0.8}
    entries = N._prefixes(hashed, spark.sparkContext.broadcast(idf), 0.8)
    none = spark.createDataFrame([], "id long, class_id long")
    got = {tuple(r) for r in N._prefix_pairs(entries, none, 0.8).collect()}
    assert 50 < len(want) < 1500 and want <= got and len(got) < 60 * 59 / 2
    one = spark.createDataFrame([(i, i % 2) for i in range(60)], "id long, class_id long")
    split = {tuple(r) for r in N._prefix_pairs(entries, one, 0.8).collect()}
    assert split == {(a, b) for a, b in got if (a - b) % 2}


def test_loose_members_meet_in_sample_order():
    rng = np.random.default_rng(3)
    passage = rng.integers(-2**62, 2**62, 300)
    idf = np.zeros(N.IDF_BUCKETS)
    sample = N.Sampler(N.SKETCH)
    sets = []
    for _ in range(400):  # 200 pairs, about 0.85 similar, in a family whose members are about 0.6 similar
        own = rng.integers(-2**62, 2**62, 80)
        for _ in range(2):
            sets.append(N.shingles(np.concatenate([passage, own, rng.integers(-2**62, 2**62, 30)])))
    s = np.array([(sample(h, N.log_weights(h, n, idf)) >> np.uint64(24)).astype(np.uint8) for h, n in sets])
    found = set()
    cls = np.arange(len(s))
    for turn in range(3):
        for t in range(N.TREES):
            key = s[:, np.random.default_rng([turn, t]).permutation(N.SKETCH)]
            order = np.lexsort(key.T[::-1])
            a, b = N.neighbours(np.zeros(len(s), int), key[order], order, cls[order], 38)
            found |= set(zip(a.tolist(), b.tolist()))
        for a, b in found:  # linked pairs are one class from the next turn on
            if N.similarity(sets[a], sets[b], idf) >= 0.8:
                cls[b] = cls[a]
    want = {(i, i + 1) for i in range(0, 800, 2) if N.similarity(sets[i], sets[i + 1], idf) >= 0.8}
    assert len(want) > 300 and len(want & found) >= 0.97 * len(want) and len(found) < 3 * 800 * N.TREES * N.BEST


def test_a_hot_head_sends_its_text_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(N, "PER_HEAD", 7)
    texts = spark.range(100).selectExpr("id as doc_id", "concat('text ', id) as text")
    pairs = spark.range(1, 100).selectExpr("if(id < 80, 0L, 90L) as a", "id as b").filter("a < b")
    got = N._with_texts(pairs, texts).select("a", "b").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, pairs.collect()))


def test_sketches_and_their_orders_are_not_steps_of_one_task(spark):
    rng = np.random.default_rng(5)
    words = [[int(x) for x in rng.integers(0, 50, 30)] for _ in range(20)]
    loose = spark.createDataFrame(list(enumerate(words)), "doc_id long, h array<long>")
    classes = spark.createDataFrame([(1, 0)], "id long, class_id long")
    log_idf = spark.sparkContext.broadcast(np.ones(N.IDF_BUCKETS))
    plan = N._sample_pairs(loose, classes, log_idf, 0.8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2  # orders and neighbours, with an exchange between them
