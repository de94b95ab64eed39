"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. A source's size is its word count. Targets share ``BUDGET`` x all words by weight
   (sources in code-point order, null last, weighted 5, 2, 1, 5, 2, 1, ...);
   a target stops at ``MAX_PASSES`` x its source's size and the excess is
   reshared by weight among the others until no target is above.
2. Each source is cut into blocks by a hash of the document id. A target of p
   whole passes and a rest takes every block p times, and, in the last pass, blocks in a
   seeded permutation as long as they fit the rest; the first block that does not fit
   fills what is left with its documents in hash order.
3. The drawn blocks are dealt to output shards of equal block counts (64, more for a large corpus): a
   binary tree splits the sources' exact quotas, each node drawing its left
   half's composition from the multivariate hypergeometric distribution. A
   shard then gets its quota of each source's permuted blocks, disjoint from every
   other shard's, and is shuffled locally by hash.

The block table has at most ``MAX_BLOCKS`` + (number of sources) rows whatever the
corpus size (blocks grow instead), so it may be collected and broadcast; the number of
sources, the mixture's components, is checked against ``MAX_SOURCES``.

Edge cases: null or empty texts have size 0 and are never drawn; a null source is a
source of its own; documents sharing an id are drawn together or by hash of
their text; repeated rows are rows of their own; an empty table gives an empty mix; other columns are
carried by ``mix`` and ignored by ``taken_words``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready, spill, text_of, word_count

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MAX_PASSES = 2
MAX_BLOCKS = 1 << 14
MAX_SOURCES = 100_000
SHARDS = 64          # at least
SHARD_WORDS = 1 << 27
SEED = 20240


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, budget: float = BUDGET,
            most: float = MAX_PASSES) -> dict[str | None, float]:
    """Words wanted of each source (water-filling under the cap)."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, out, open_ = budget * sum(size.values()), {}, [s for s, _ in order]
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * size[s]]
        if not full:
            out.update({s: unit * weight[s] for s in open_})
            break
        for s in full:
            out[s] = float(most * size[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards x sources) block counts; columns sum to ``quotas``, rows differ by at most one."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def size(lo: int, hi: int, total: int) -> int:
        return total * hi // shards - total * lo // shards

    def split(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        left = _draw(have, size(lo, mid, int(quotas.sum())), rng)
        split(lo, mid, left)
        split(mid, hi, have - left)

    split(0, shards, quotas.astype(np.int64))
    return out


def _draw(have: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """A multivariate hypergeometric draw as a chain of univariate ones."""
    got, rest = np.zeros_like(have), int(have.sum())
    for i, h in enumerate(have):
        if n == 0:
            break
        rest -= int(h)
        got[i] = rng.hypergeometric(int(h), rest, n) if rest else min(int(h), n)
        n -= int(got[i])
    return got


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """Rows packed as ``row`` beside doc_id, source, size and a hash that orders them."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                    F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                    text_of().alias("text"))
    return d.select("row", "doc_id", "source", word_count(F.col("text")).alias("size"),
                    F.xxhash64(F.lit(seed), "doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))).alias("h"))


def _small_table(spark, rows: list[tuple], **kinds) -> DataFrame:
    """A bounded table from the driver, as Arrow: tuples would go through Python workers that stay on the executors."""
    columns = zip(*rows) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.table({name: pa.array(list(c), kind) for (name, kind), c in zip(kinds.items(), columns)}))


def _plan(sized: DataFrame, seed: int, shards: int | None) -> tuple[DataFrame, DataFrame, int]:
    """(sources, draws, shards): source, source_size, target; and per source, block and
    pass the shard, with ``room`` words for the block that crosses the target."""
    spark = sized.sparkSession
    per_source = (sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1)).collect()
    if len(per_source) > MAX_SOURCES:
        raise ValueError(f"a mixture has at most {MAX_SOURCES} sources")
    sizes = [(r.source, int(r.size or 0)) for r in per_source]
    goal = targets(sizes)
    sizes.sort(key=lambda x: (x[0] is None, x[0] or ""))
    unit = max(1, sum(n for _, n in sizes) // MAX_BLOCKS)
    # a shard holds about SHARD_WORDS words however large the corpus is, and a block at least
    shards = shards or min(MAX_BLOCKS, max(SHARDS, int(sum(goal.values())) // SHARD_WORDS))
    source_rows = [(i, s, n, float(goal[s]), max(1, n // unit)) for i, (s, n) in enumerate(sizes)]
    sources = _small_table(spark, source_rows, source_no=pa.int32(), s_source=pa.string(), source_size=pa.int64(), target=pa.float64(),
                           n_blocks=pa.int64())
    blocks = (_blocked(sized, sources).groupBy("source_no", "block").agg(F.sum("size").alias("words")).collect())
    by_source: dict[int, list[tuple[int, int]]] = {}
    for r in blocks:
        if r.words:
            by_source.setdefault(r.source_no, []).append((int(r.block), int(r.words)))
    drawn: list[list[tuple[int, int, int | None]]] = []
    for no, _, size, target, _ in source_rows:
        rng = np.random.default_rng([seed, no])
        mine = sorted(by_source.get(no, []))
        units: list[tuple[int, int, int | None]] = []
        rest = int(round(target))
        for turn in range(MAX_PASSES):
            words, crossing = 0, None
            for i in rng.permutation(len(mine)) if rest > 0 else ():
                block, n = mine[i]
                if words + n <= rest:
                    units.append((block, turn, None))
                    words += n
                elif crossing is None:
                    crossing = block
            if crossing is not None and words < rest:
                units.append((crossing, turn, rest - words))
            rest = max(0, rest - size)
        drawn.append([units[i] for i in rng.permutation(len(units))])
    quota = split_quotas(np.array([len(u) for u in drawn], np.int64), shards, np.random.default_rng(seed)) if drawn else None
    rows = []
    for no, units in enumerate(drawn):
        shard_of = np.repeat(np.arange(shards), quota[:, no])
        rows += [(no, b, t, room, int(s)) for (b, t, room), s in zip(units, shard_of)]
    plan = _small_table(spark, rows, source_no=pa.int32(), block=pa.int64(), turn=pa.int32(), room=pa.int64(), shard=pa.int32())
    return sources, plan, shards


def _blocked(sized: DataFrame, sources: DataFrame) -> DataFrame:
    joined = sized.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("s_source")))
    return joined.withColumn("block", F.pmod("h", "n_blocks"))


def _draws(sized: DataFrame, seed: int, shards: int | None) -> tuple[DataFrame, DataFrame, int]:
    """(all rows with block and target, one row per drawn copy, the number of shards)."""
    sources, plan, shards = _plan(sized, seed, shards)
    rows = _blocked(sized, sources)
    drawn = rows.filter("size > 0").join(F.broadcast(plan), ["source_no", "block"])
    whole = drawn.filter("room is null")
    # only the documents of one block a source and pass are ranked
    w = Window.partitionBy("source_no", "turn").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    part = (drawn.filter("room is not null").withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)))
            .filter("before + size / 2 <= room").drop("before"))
    return rows, whole.unionByName(part), shards


def _dealt_sized(sized: DataFrame, seed: int, shards: int | None) -> tuple[DataFrame, DataFrame]:
    """(all rows with their target, the drawn copies dealt to their shards and shuffled inside each)."""
    rows, drawn, shards = _draws(sized, seed, shards)
    placed = drawn.withColumn("place", F.xxhash64(F.lit(seed + 1), "h", "turn"))
    return rows, placed.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "place")


def taken_words(docs: DataFrame, seed: int = SEED, shards: int | None = None) -> DataFrame:
    """Per input row: doc_id, size, source_size, target, taken (words, repeats counted).

    The mix itself is dealt to its shards, with row numbers for documents, and its copies are counted by row.
    """
    ready(docs.sparkSession)
    numbered = _sized(docs.select("doc_id", "source", "text"), seed).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "source", "size", "h")
    rows, copies = _dealt_sized(spill(numbered, "sizes"), seed, shards)
    taken = copies.groupBy("row").agg(F.sum("size").alias("taken"))
    return rows.join(taken.withColumnRenamed("row", "t_row"), F.col("row") == F.col("t_row"), "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, seed: int = SEED, shards: int | None = None) -> DataFrame:
    """The mixed corpus: one row per drawn copy, all input columns, dealt to
    shards and shuffled inside each."""
    ready(docs.sparkSession)
    _, copies = _dealt_sized(_sized(docs, seed), seed, shards)
    return copies.select("row.*")
