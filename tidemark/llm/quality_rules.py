"""Quality rules: base counts and a hashed n-gram log-likelihood ratio.

Tokens are runs of letters/digits and runs of ASCII punctuation. Unigrams and
bigrams of every document are hashed into ``buckets`` features. Two multinomials are
counted over all documents: the raw corpus and the trusted target (documents
labelled as good). A document's score is the mean over its n-grams of
``log p_target / p_raw``; it is kept if no base rule fails and the mean reaches
``threshold``. Everything is DataFrame functions; the model is one row with an
array of ``buckets`` doubles, passed to the scoring stage as a scalar subquery.

Edge cases: null or empty text has no words, fails the word-count rule and is
not kept; without trusted documents the ratio is 0 everywhere and only the
base rules decide; rows repeat as often as in the input; a null ``doc_id`` is
never trusted and is scored like any other; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, ready, text_of, words_of

BUCKETS = 10_000
THRESHOLD = -0.3
SMOOTHING = 1.0
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# a run of letters, digits and non-ASCII characters, or a run of ASCII punctuation
TOKEN = r"[\p{Alnum}[^\p{ASCII}]]++|\p{Punct}++"
SYMBOL = "[#*$%&|<>]"
# the marks of trusted ids: this many bitmaps of 32,768 bits each (1 MB in all)
BITMAPS = 256
BITMAP_BITS = 32768


def _token_hashes(text):
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.xxhash64(t))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that every label row marks as good (quality 1)."""
    return (labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id")
            .agg(F.min("quality").alias("worst")).filter("worst = 1").select("doc_id"))


def _place(doc_id):
    return F.pmod(F.xxhash64(doc_id), F.lit(BITMAPS * BITMAP_BITS))


def _marks(ids: DataFrame) -> DataFrame:
    """One row: ``BITMAPS`` bitmaps with the place of every id set (fixed size, however many ids)."""
    place = _place(F.col("t_id"))
    own = ids.select((place / BITMAP_BITS).cast("int").alias("part"), (place % BITMAP_BITS).alias("bit")).groupBy("part").agg(
        F.bitmap_construct_agg("bit").alias("bits"))
    table = own.agg(F.map_from_entries(F.collect_list(F.struct("part", "bits"))).alias("m"))
    return table.select(F.transform(F.sequence(F.lit(0), F.lit(BITMAPS - 1)), lambda i: F.col("m")[i]).alias("marks"))


def _marked(doc_id, marks: DataFrame):
    """False if the id is certainly not among the marked ones."""
    place = _place(doc_id)
    bit = place % BITMAP_BITS
    byte = F.substring(F.get(marks.scalar(), (place / BITMAP_BITS).cast("int")), (bit / 8).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.coalesce(doc_id.isNotNull() & (F.call_function("shiftright", value, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1), F.lit(False))


def ratio_model(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row: ``llr``, the log ratio of each n-gram bucket.

    The n-grams are exploded and counted with map-side partial aggregation, so
    each task sends at most ``buckets`` rows however frequent an n-gram is.
    """
    # the ids grow with the corpus, so they are never broadcast; texts whose id is certainly
    # not among them (by the marks) are counted where they are, the others meet the ids
    target = trusted.select(F.col("doc_id").alias("t_id")).distinct()
    texts = docs.select("doc_id", text_of().alias("text")).withColumn("maybe", _marked(F.col("doc_id"), _marks(target)))
    some = texts.filter("maybe").join(target.hint("merge"), F.col("doc_id") == F.col("t_id"), "left")
    every = some.select(F.col("t_id").isNotNull().cast("long").alias("good"), "text").unionByName(
        texts.filter("not maybe").select(F.lit(0).cast("long").alias("good"), "text"))
    h = every.select("good", _token_hashes(F.col("text")).alias("h"))
    grams = h.select("good", F.explode(F.concat(
        F.transform("h", lambda x: F.pmod(x, F.lit(buckets))),
        F.zip_with(F.col("h"), F.expr("slice(h, 2, greatest(size(h) - 1, 0))"),
                   lambda a, b: F.when(b.isNotNull(), F.pmod(F.xxhash64(a, b), F.lit(buckets)))),
    )).alias("bucket")).filter("bucket is not null")
    counts = grams.groupBy("bucket").agg(F.count("*").alias("n_raw"), F.sum("good").alias("n_good"))
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(counts, "bucket", "left").na.fill(0)
    # a fixed number of rows (``buckets``) meets in the last aggregate
    table = every.agg(F.sum("n_raw").alias("raw"), F.sum("n_good").alias("good"),
                      F.sort_array(F.collect_list(F.struct("bucket", "n_raw", "n_good"))).alias("t"))
    s, size = F.lit(SMOOTHING), F.lit(SMOOTHING * buckets)
    return table.select(F.when(F.col("good") == 0, F.array_repeat(F.lit(0.0), buckets)).otherwise(
        F.transform("t", lambda r: F.log((r["n_good"] + s) / (F.col("good") + size))
                    - F.log((r["n_raw"] + s) / (F.col("raw") + size)))).alias("llr"))


def with_base_counts(docs: DataFrame) -> DataFrame:
    """Adds the base columns to rows that have ``text`` (not null).

    Repeated windows are found by sorting one packed 64-bit number for each
    window (upper bits of its hash, lower bits its place) and comparing
    neighbours word by word, so long texts cost n log n.
    """
    d = docs.withColumn("w", words_of(F.col("text")))
    d = d.withColumn("n_words", F.size("w").cast("long"))
    d = d.withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    d = d.withColumn("bits", F.length(F.bin(F.size("w").cast("long"))))
    d = d.withColumn("keys", F.expr("""
        sort_array(transform(slice(wh, 1, greatest(size(wh) - 2, 0)), (x, i) ->
            shiftleft(shiftright(xxhash64(x, wh[i + 1], wh[i + 2]), bits), bits) | cast(i as bigint)))"""))
    d = d.withColumn("twin", F.expr("""
        flatten(filter(zip_with(keys, slice(keys, 2, greatest(size(keys) - 1, 0)), (a, b) ->
            if(b is not null and shiftright(a, bits) = shiftright(b, bits),
               array(cast(a & (shiftleft(1L, bits) - 1) as int), cast(b & (shiftleft(1L, bits) - 1) as int)),
               cast(null as array<int>))), p -> p is not null and
            w[p[0]] = w[p[1]] and w[p[0] + 1] = w[p[1] + 1] and w[p[0] + 2] = w[p[1] + 2]))"""))
    d = d.withColumn("lines", F.expr(f"filter(split(text, '\\n', -1), x -> x rlike r'{WORD}')"))
    return (d.withColumn("word_chars", F.aggregate("w", F.lit(0).cast("long"), lambda n, x: n + F.length(x)))
            .withColumn("n_symbols", F.regexp_count("text", F.lit(SYMBOL)).cast("long"))
            .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
            .withColumn("n_repeat_words", F.expr(
                "size(array_distinct(flatten(transform(twin, i -> array(i, i + 1, i + 2)))))").cast("long"))
            .withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                        | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
            .drop("w", "wh", "bits", "keys", "twin", "lines"))


def _with_ratio(docs: DataFrame, model: DataFrame, buckets: int) -> DataFrame:
    """Adds ``llr``: the mean log ratio over the text's n-grams (0 without any)."""
    d = docs.withColumn("h", _token_hashes(F.col("text"))).withColumn("ratios", model.scalar())
    total = F.expr(f"""aggregate(zip_with(h, slice(h, 2, greatest(size(h) - 1, 0)), (a, b) ->
        ratios[cast(pmod(a, {buckets}L) as int)] +
        if(b is null, 0D, ratios[cast(pmod(xxhash64(a, b), {buckets}L) as int)])), 0D, (s, x) -> s + x)""")
    return (d.withColumn("llr", F.when(F.size("h") > 0, total / (2 * F.size("h") - 1)).otherwise(F.lit(0.0)))
            .drop("h", "ratios"))


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS,
                  threshold: float = THRESHOLD) -> DataFrame:
    """Per input row: doc_id, base counts, ``llr`` and the verdict ``kept``."""
    ready(docs.sparkSession)
    model = ratio_model(docs, trusted_ids(labels), buckets)
    d = _with_ratio(with_base_counts(docs.select("doc_id", text_of().alias("text"))), model, buckets)
    return (d.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "llr", "kept"))


def keep_good(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS,
              threshold: float = THRESHOLD) -> DataFrame:
    """The input rows (all their columns) that the rules keep."""
    ready(docs.sparkSession)
    model = ratio_model(docs, trusted_ids(labels), buckets)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_of().alias("text"))
    d = _with_ratio(with_base_counts(packed), model, buckets)
    # a row number between the counts and the filter keeps the optimizer from
    # copying their nested expressions into the predicate, once for each use
    d = d.withColumn("nth", F.monotonically_increasing_id())
    good = ~F.col("base_failed") & (F.col("llr") >= threshold) & (F.col("nth") >= 0)
    return d.filter(good).select("row.*")
