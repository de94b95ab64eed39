"""Near-duplicate classes by consistent weighted sampling.

Documents are weighted sets of word 5-grams: weight = count x inverse document
frequency, where the document frequency is that of the shingle's hash bucket
(the hashing trick, ``IDF_BUCKETS`` buckets, counted over all documents). Improved
consistent weighted sampling draws ``BANDS x ROWS`` samples per document; two
documents agree on a sample with probability equal to their weighted Jaccard
similarity. Samples are banded; documents that share a band key are compared with
the smallest id under that key (the head), at two depths (one band, and two adjacent bands
together). Members of one head that are still in different components afterwards are loose. First their
sketches (64 further samples) are sorted in 8 sample orders, so that sets which agree on a run of
samples stand close, and each is compared with the two likest of the 64 that follow in every order; this only
joins the bulk of a family cheaply. Then an exact prefix join settles all others: with shingles in
one order (rarest among the loose first), the first shingle that two sets of similarity t share
must leave both a weight of t / (1 + t) of their sum, so it stands in a short prefix of each, and every pair of different
components that meets this bound is a candidate. No pair of loose members is lost, however large their bucket; a shingle
whose holders are one component is passed over, and members of its largest one meet the other members only.
Every candidate pair is verified by its
exact weighted Jaccard similarity (0.8 or more), and classes are the connected components
of the verified links; n_links counts the links that were verified, not those inside a component.

Texts with the same word sequence are collapsed first: one row per distinct
content takes part and its copies inherit the class, so a group of copies
costs a pre-aggregated minimum. Buckets are not expanded into pairs, and a head with very many members sends
its text to several tasks.

Edge cases: null, empty and word-less texts have no shingles and are each
their own class; a text of one to four words is one shingle; rows that share a doc_id
count as one document; a null doc_id gets a null class (and survives
``keep_one``); other columns, whatever their names, are carried by ``keep_one`` only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bits
from .common import list_parts, mix64, ready, spill, text_of, word_hashes
from .graph import components, joined

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 9
ROWS = 3
IDF_BUCKETS = 1 << 18
SKETCH = 64     # samples of a loose member's sketch, a byte each
TREES = 8       # sample orders in which loose members are sorted
NEXT = 64       # members that follow in an order and are looked at
BEST = 2        # of them, those that are verified if their samples agree enough (the prefix join has all others)
ORDER_BUCKETS = 1 << 20  # hash buckets of the counts that order the prefixes: they decide the work, not the result
SLACK = 1e-9    # relative, for sums of weights in another order
PER_HEAD = 1000  # pairs that one copy of a head's text serves
CHUNK = 8192  # shingles sampled at a time: bounds memory for very long texts

_QUANTILES = 1 << 16


def _gamma_table() -> np.ndarray:
    """Quantiles of Gamma(2, 1): solves 1 - (1 + x) exp(-x) = p by bisection."""
    p = (np.arange(_QUANTILES) + 0.5) / _QUANTILES
    lo, hi = np.zeros(_QUANTILES), np.full(_QUANTILES, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (sorted) and their counts of one text."""
    w = words.view(np.uint64)
    if len(w) == 0:
        return w, np.zeros(0, np.int64)
    n = max(1, len(w) - SHINGLE + 1)
    h = np.full(n, len(w) if len(w) < SHINGLE else 0, np.uint64)
    for i in range(min(SHINGLE, len(w))):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w[i:i + n])
    return np.unique(h, return_counts=True)


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(IDF_BUCKETS)).astype(np.int64)


def log_weights(h: np.ndarray, counts: np.ndarray, log_idf: np.ndarray) -> np.ndarray:
    return np.log(counts) + log_idf[bucket_of(h)]


class Sampler:
    """Consistent weighted samples: per sample, Gamma(2,1) r and c and a uniform shift,
    read from quantile tables at places given by a hash of (shingle, sample)."""

    def __init__(self, samples: int, first: int = 1):
        r = _gamma_table()
        self.r, self.inverse, self.log_c = r, 1 / r, np.log(r)
        self.shift = (np.arange(_QUANTILES) + 0.5) / _QUANTILES
        self.seeds = mix64(np.arange(first, first + samples, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def __call__(self, h: np.ndarray, log_w: np.ndarray) -> np.ndarray:
        k = len(self.seeds)
        best, pick = np.full(k, np.inf), np.zeros(k, np.uint64)
        every = np.arange(k)
        for at in range(0, len(h), CHUNK):
            part = h[at:at + CHUNK]
            bits = mix64(part[None, :] ^ self.seeds[:, None])
            r = (bits & np.uint64(0xFFFF)).astype(np.int64)
            c = ((bits >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)
            shift = self.shift[((bits >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)]
            level = np.floor(log_w[None, at:at + CHUNK] * self.inverse[r] + shift)
            log_a = self.log_c[c] - self.r[r] * (level - shift + 1)
            j = np.argmin(log_a, axis=1)
            low = log_a[every, j]
            new = mix64(part[j] + mix64(level[every, j].astype(np.int64).view(np.uint64)))
            better = low < best
            best, pick = np.where(better, low, best), np.where(better, new, pick)
        return pick


def _content_key(words: np.ndarray) -> tuple[int, int]:
    """128 bits of the whole word sequence."""
    w = words.view(np.uint64)
    place = mix64(np.arange(1, len(w) + 1, dtype=np.uint64))
    one = mix64(w + place)
    two = mix64(one ^ (place << np.uint64(1)))
    return int(one.sum(dtype=np.uint64).view(np.int64)), int(two.sum(dtype=np.uint64).view(np.int64))


def _count_buckets(place, buckets: int):
    """Task-wise numbers of the documents with a shingle in each bucket that ``place`` gives."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            values, at = list_parts(batch.column(0))
            for i in range(len(at) - 1):
                h, _ = shingles(values[at[i]:at[i + 1]])
                total[np.unique(place(h))] += 1
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    return run


def log_idf_table(hashed: DataFrame) -> np.ndarray:
    """ln of the inverse document frequency of every bucket, over all documents.

    ``IDF_BUCKETS`` numbers, however large the corpus: that is what reaches the
    driver and is broadcast.
    """
    counts = hashed.select("h").mapInArrow(_count_buckets(bucket_of, IDF_BUCKETS), "bucket long, n long")
    table = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(IDF_BUCKETS)
    df[table["bucket"].to_numpy(np.int64)] = table["n"].to_numpy(np.float64)
    n = hashed.count()
    return np.log(1 + np.log((n + 1) / (np.minimum(df, n) + 1)))


def _signatures(hashed: DataFrame, log_idf) -> DataFrame:
    def run(batches):
        sample, idf = Sampler(BANDS * ROWS), log_idf.value
        for batch in batches:
            values, at = list_parts(batch.column("h"))
            keys, bands = [], []
            for i in range(len(at) - 1):
                w = values[at[i]:at[i + 1]]
                keys.append(_content_key(w))
                h, n = shingles(w)
                got = sample(h, log_weights(h, n, idf)).reshape(BANDS, ROWS)
                key = mix64(np.arange(BANDS, dtype=np.uint64))
                for r in range(ROWS):
                    key = mix64(key + got[:, r])
                bands.append(key.view(np.int64))
            k = np.array(keys, np.int64).reshape(-1, 2)
            yield pa.record_batch([
                batch.column("doc_id"), pa.array(k[:, 0]), pa.array(k[:, 1]),
                pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS),
                                         pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))),
            ], names=["doc_id", "k1", "k2", "bands"])

    return hashed.mapInArrow(run, "doc_id long, k1 long, k2 long, bands array<long>")


def similarity(a: tuple, b: tuple, log_idf: np.ndarray) -> float:
    """Weighted Jaccard of two (hashes, counts) sets."""
    (ha, na), (hb, nb) = a, b
    wa, wb = np.exp(log_weights(ha, na, log_idf)), np.exp(log_weights(hb, nb, log_idf))
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    low = np.minimum(wa[ia], wb[ib]).sum()
    high = wa.sum() + wb.sum() - low
    return float(low / high) if high > 0 else 0.0


def _verified(pairs: DataFrame, log_idf, threshold: float) -> DataFrame:
    def run(batches):
        last, kept = None, None
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            va, oa = list_parts(batch.column("ha"))
            vb, ob = list_parts(batch.column("hb"))
            good = np.zeros(len(a), bool)
            for i in range(len(a)):
                if a[i] != last:
                    last, kept = a[i], shingles(va[oa[i]:oa[i + 1]])
                good[i] = similarity(kept, shingles(vb[ob[i]:ob[i + 1]]), log_idf.value) >= threshold
            yield pa.record_batch([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _sketches(log_idf):
    """``SKETCH`` samples of one byte each, of other seeds than the bands'."""
    def run(batches):
        sample = Sampler(SKETCH, first=BANDS * ROWS + 1)
        for batch in batches:
            values, at = list_parts(batch.column("h"))
            out = []
            for i in range(len(at) - 1):
                h, n = shingles(values[at[i]:at[i + 1]])
                out.append((sample(h, log_weights(h, n, log_idf.value)) >> np.uint64(24)).astype(np.uint8).tobytes())
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "sketch"])

    return run


def _orders(batches):
    """Each sketch in the ``TREES`` sample orders."""
    perms = [np.random.default_rng(t).permutation(SKETCH) for t in range(TREES)]
    for batch in batches:
        n = batch.num_rows
        s = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(n, SKETCH)
        keys = [r.tobytes() for p in perms for r in s[:, p]]
        every = pa.array(np.tile(np.arange(n), TREES))
        yield pa.record_batch([pa.array(np.repeat(np.arange(TREES, dtype=np.int32), n)), pa.array(keys, pa.binary()),
                               batch.column("doc_id").take(every), batch.column("class_id").take(every)],
                              names=["tree", "key", "doc_id", "class_id"])


def neighbours(tree: np.ndarray, s: np.ndarray, doc: np.ndarray, cls: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): each row with its ``BEST`` likest among the next ``NEXT`` rows of the same tree that are in
    other classes and agree on ``least`` samples or more."""
    n = len(doc)
    agree = np.zeros((n, NEXT), np.uint8)
    for d in range(1, min(NEXT, n - 1) + 1):
        same = (s[:-d] == s[d:]).sum(axis=1, dtype=np.uint8)
        same[(tree[:-d] != tree[d:]) | (cls[:-d] == cls[d:])] = 0
        agree[:n - d, d - 1] = same
    pick = np.argpartition(-agree.astype(np.int16), BEST - 1, axis=1)[:, :BEST]
    i = np.repeat(np.arange(n), BEST)
    j = pick.reshape(-1)
    good = agree[i, j] >= least
    i, j = i[good], i[good] + j[good] + 1
    return np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])


def _neighbour_pairs(least: int):
    def run(batches):
        held = None
        for batch in batches:
            s = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint8).reshape(-1, SKETCH)
            rows = [batch.column("tree").to_numpy(), s, batch.column("doc_id").to_numpy(), batch.column("class_id").to_numpy()]
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held, rows)]
            held = [r[-NEXT:] for r in rows]
            a, b = neighbours(*rows, least)
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _loose_words(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Word hashes of the members that share a head with members of other components."""
    members = pairs.join(classes.select(F.col("id").alias("b"), "class_id"), "b", "left").select(
        "a", "b", F.coalesce("class_id", "b").alias("class_id"))
    mixed = members.groupBy("a").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).filter("lo < hi").select("a")
    loose = members.join(mixed, "a").select(F.col("b").alias("doc_id")).distinct()
    return spill(texts.hint("merge").join(loose, "doc_id").select("doc_id", word_hashes(F.col("text")).alias("h")), "loose-words")


def _in_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with the class of their doc_id, itself where it has no link."""
    return rows.join(classes.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        *rows.columns, F.coalesce("class_id", "doc_id").alias("class_id"))


def _sample_pairs(loose: DataFrame, classes: DataFrame, log_idf, threshold: float) -> DataFrame:
    """Pairs (a, b) of likely similar members of different components, a bounded number a member."""
    # those that agree less often, though similar, are left to the prefix join
    least = int(SKETCH * threshold - (SKETCH * threshold * (1 - threshold)) ** 0.5)
    # written: the next step reads them twice, and in a worker of its own for each task if in the same stage
    rows = spill(_in_classes(loose.mapInArrow(_sketches(log_idf), "doc_id long, sketch binary"), classes), "sketches")
    ordered = (rows.mapInArrow(_orders, "tree int, key binary, doc_id long, class_id long")
               .repartitionByRange("tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id"))
    return ordered.mapInArrow(_neighbour_pairs(max(1, least)), "a long, b long").distinct()


def _place(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64) % ORDER_BUCKETS


def _prefixes(loose: DataFrame, log_idf, threshold: float) -> DataFrame:
    """(doc_id, h, before, total): the shingles that can be the first one shared with a set of similarity ``threshold``
    or more, in the order of their holders' number; ``before`` is the weight of the set's shingles that precede."""
    counts = loose.select("h").mapInArrow(_count_buckets(_place, ORDER_BUCKETS), "bucket long, n long")
    table = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    held = np.zeros(ORDER_BUCKETS, np.int32)
    held[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    held = loose.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        for batch in batches:
            values, at = list_parts(batch.column("h"))
            out, n = [], []
            for i in range(len(at) - 1):
                h, times = shingles(values[at[i]:at[i + 1]])
                h, w = h.view(np.int64), np.exp(log_weights(h, times, log_idf.value))
                order = np.lexsort((h, held.value[_place(h.view(np.uint64))]))
                before = np.concatenate([[0.0], np.cumsum(w[order])])
                before, total = before[:-1], before[-1]
                short = int(np.searchsorted(before, ((1 - threshold) + SLACK) * total, side="right"))
                out.append((h[order[:short]], before[:short], np.full(short, total)))
                n.append(short)
            if out:
                owner = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.record_batch([batch.column("doc_id").take(owner), *[pa.array(np.concatenate(c)) for c in zip(*out)]],
                                      names=["doc_id", "h", "before", "total"])

    return spill(loose.mapInArrow(run, "doc_id long, h long, before double, total double"), "prefixes")


def _prefix_pairs(prefixes: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a, b) of different components that share a prefix shingle from which on enough weight is left to both."""
    rows = _in_classes(prefixes, classes)
    kinds = (rows.groupBy("h", "class_id").agg(F.count("*").alias("n")).groupBy("h")
             .agg(F.max(F.struct("n", "class_id")).alias("top"), F.count("*").alias("classes")).filter("classes > 1"))
    met = spill(rows.join(kinds.select("h", F.col("top.class_id").alias("top_class")), "h")
                .withColumn("minor", F.col("class_id") != F.col("top_class")).drop("top_class"), "met")
    # the lighter set's prefix is the shorter one
    x = met.filter(F.col("before") <= ((1 - threshold) / (1 + threshold) + SLACK) * F.col("total")).select(
        "h", *[F.col(c).alias(f"{c}_x") for c in ("doc_id", "before", "total", "class_id", "minor")])
    lighter = F.struct("total_x", "doc_id_x") < F.struct(F.col("total").alias("total_x"), F.col("doc_id").alias("doc_id_x"))
    left = F.least(F.col("total_x") - F.col("before_x"), F.col("total") - F.col("before"))
    enough = left >= threshold / (1 + threshold) * (1 - SLACK) * (F.col("total_x") + F.col("total"))
    able = (F.col("class_id_x") != F.col("class_id")) & lighter & enough
    # two of a shingle's largest component need not meet
    parts = [x.filter("minor_x").hint("merge").join(met, "h"), x.filter("not minor_x").hint("merge").join(met.filter("minor"), "h")]
    found = [p.filter(able).select(F.least("doc_id_x", "doc_id").alias("a"), F.greatest("doc_id_x", "doc_id").alias("b")) for p in parts]
    return found[0].unionByName(found[1]).distinct()


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Both texts' word hashes beside each pair; a head's text goes out once for every ``PER_HEAD`` of its pairs."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_HEAD).cast("int").alias("parts"))
    heads = (texts.hint("merge").join(sizes.withColumnRenamed("a", "doc_id"), "doc_id")
             .select(F.col("doc_id").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("text").alias("ta")))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
    left = dealt.hint("merge").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    both = left.hint("merge").join(heads, ["a", "part"])
    return both.select("a", "b", word_hashes(F.col("ta")).alias("ha"), word_hashes(F.col("tb")).alias("hb"))


def near_classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), n_links."""
    spark = docs.sparkSession
    ready(spark)
    known = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    hashed = known.select("doc_id", word_hashes(F.col("text")).alias("h"))
    log_idf = spark.sparkContext.broadcast(log_idf_table(hashed))
    signed = spill(_signatures(hashed.filter("size(h) > 0"), log_idf), "signatures")

    # copies collapse to the smallest id of their content
    first = signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    first = spill(first, "contents")
    single = F.posexplode("bands").alias("band", "key")
    one = first.select("rep", single)
    double = F.posexplode(F.expr(f"transform(bands, (x, i) -> xxhash64(x, bands[pmod(i + 1, {BANDS})]))")).alias("band", "key")
    two = first.select("rep", double).withColumn("band", F.col("band") + BANDS)
    buckets = one.unionByName(two)
    heads = buckets.groupBy("band", "key").agg(F.min("rep").alias("a"), F.max("rep").alias("top")).filter("a < top")
    pairs = (buckets.join(heads.drop("top"), ["band", "key"]).filter("a < rep")
             .select("a", F.col("rep").alias("b")).distinct())
    pairs = spill(pairs, "pairs")

    # pairs grow with the corpus, so texts meet them by sort-merge; only texts
    # that may be in a pair are moved
    needed = spill(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "needed")
    table = bits.bit_table(needed.select(F.xxhash64("doc_id")))
    texts = spill(known.filter(bits.maybe_in(table, F.xxhash64("doc_id"))).join(needed.hint("merge"), "doc_id")
                  .groupBy("doc_id").agg(F.min("text").alias("text")), "texts")

    def linked(pairs):
        return spill(_verified(_with_texts(pairs, texts), log_idf, threshold), "links")

    links = linked(pairs)
    classes = components(links)
    # what failed against its head: most by sample orders, then all that are left by prefixes
    loose, tested = _loose_words(pairs, classes, texts), pairs
    if not loose.isEmpty():
        prefixes = _prefixes(loose, log_idf, threshold)
        for step in (lambda: _sample_pairs(loose, classes, log_idf, threshold), lambda: _prefix_pairs(prefixes, classes, threshold)):
            fresh = spill(step().join(tested.hint("merge"), ["a", "b"], "left_anti"), "loose-pairs")
            more = linked(fresh)
            if not more.isEmpty():
                links, classes = links.unionByName(more), joined(classes, more)
            tested = tested.unionByName(fresh)
    degree = (links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links")))
    reps = (first.select("k1", "k2", "rep").join(classes, F.col("rep") == F.col("id"), "left").drop("id")
            .join(degree, F.col("rep") == F.col("id"), "left")
            .select("k1", "k2", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    of_doc = signed.select("doc_id", "k1", "k2").join(reps, ["k1", "k2"]).groupBy("doc_id").agg(
        F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    some = ids.filter("doc_id is not null").join(of_doc, "doc_id", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    none = ids.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return some.unionByName(none)


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """The input rows, one document per class: the one with the smallest id."""
    ids = docs.select(F.col("doc_id").cast("long").alias("gone_id")).filter("gone_id is not null")
    gone = spill(near_classes(docs, threshold).filter("doc_id <> class_id").select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    repeated = ids.groupBy("gone_id").agg(F.count("*").alias("n")).filter("n > 1").select("gone_id")
    table = bits.bit_table(gone.unionByName(repeated).select(F.xxhash64("gone_id")))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.col("doc_id").cast("long").alias("id"))
    touched = F.col("id").isNotNull() & bits.maybe_in(table, F.xxhash64("id"))
    packed = packed.withColumn("touched", touched)
    # only rows that may go, or whose id may repeat, are moved
    some = packed.filter("touched").join(gone.hint("merge"), F.col("id") == F.col("gone_id"), "left_anti")
    order = Window.partitionBy("id").orderBy(F.xxhash64("row"))
    one = some.withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    return one.select("row.*").unionByName(packed.filter("not touched").select("row.*"))
