"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A tree has regions, racks and shards; a node's weight is the sum of its shards' weights. A key
descends from the root: at every level each child draws ``-ln(u) / weight``, with u a uniform
number hashed from the key and the child's name, and the smallest draw wins. So a child is taken
in proportion to its weight, and changing a shard's weight moves rows only into or out of the
subtrees whose weights change: draws of other nodes stay as they are.

``grow`` appends a shard as a subtree of its own below the root (a region of one rack of one shard),
so no weight inside an older subtree changes and rows move only into the new shard. ``plan(n)``
lays out the first ``BASE`` shards in racks of ``RACK`` and regions of ``REGION`` and grows the rest,
so from ``BASE`` shards on the key and the number of shards decide (law ``key``): one more shard takes
rows only into itself.

Slots number the rows of a shard from 0 without gaps. No shard is sorted in one task: equal index
rows (id, size, checksum) are counted first, so a copy held by a third of all rows is one row per
task; groups are cut into chunks of ``CHUNK``, chunks are dealt by hash to buckets of about ``PER_BUCKET``
rows, each bucket is numbered by itself and starts where the shard's earlier buckets end.

Edge cases: a null text has no bytes (size 16, checksum 0); a null or empty key is one key, so its rows
share a shard; rows that repeat get slots of their own; an empty table gives an empty index; very long
texts cost their bytes only; a shard of weight 0 gets no rows; other columns are carried by ``place`` and
``write_shards`` (the new column takes the first free name of shard, shard_, shard__ ...) and ignored by ``index``.
Equal texts are not kept together: under this law the key alone decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, spill, text_of

SHARDS = 40
BASE = 40
RACK = 5
REGION = 10
ROW_BYTES = 16
LAW = "key"
CHUNK = 1 << 16
PER_BUCKET = 100_000


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    leaves: tuple[Leaf, ...]

    def grow(self, weight: float = 1.0) -> Tree:
        """One more shard, as a region of its own."""
        shard = max((leaf.shard for leaf in self.leaves), default=-1) + 1
        return Tree((*self.leaves, Leaf(f"+{shard}", f"+{shard}", shard, weight)))

    def reweigh(self, shard: int, weight: float) -> Tree:
        return Tree(tuple(Leaf(x.region, x.rack, x.shard, weight) if x.shard == shard else x for x in self.leaves))

    def children(self) -> tuple[dict, dict, dict]:
        """Weights by name: of the regions, of each region's racks, of each rack's shards."""
        regions: dict[str, float] = {}
        racks: dict[str, dict[str, float]] = {}
        shards: dict[str, dict[str, float]] = {}
        for x in self.leaves:
            if x.weight > 0:
                regions[x.region] = regions.get(x.region, 0.0) + x.weight
                racks.setdefault(x.region, {})[x.rack] = racks.get(x.region, {}).get(x.rack, 0.0) + x.weight
                shards.setdefault(x.rack, {})[str(x.shard)] = x.weight
        return regions, racks, shards


def plan(shards: int, base: int = BASE) -> Tree:
    """The tree of ``shards`` shards: ``base`` laid out, the others grown."""
    tree = Tree(tuple(Leaf(str(s // REGION), str(s // RACK), s) for s in range(min(shards, base))))
    for _ in range(base, shards):
        tree = tree.grow()
    return tree


def uniform(key: Column, level: str, name: Column) -> Column:
    """A number in (0, 1) from 52 bits of the digest of key, level and name."""
    digest = F.md5(F.concat(key, F.lit(f":{level}:"), name))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _nodes(weights: dict[str, float]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in sorted(weights.items())])


def _below(of: dict[str, dict[str, float]], parent: Column) -> Column:
    return F.element_at(F.create_map(*[x for p, weights in sorted(of.items()) for x in (F.lit(p), _nodes(weights))]), parent)


def _winner(key: Column, level: str, nodes: Column) -> Column:
    return F.array_min(F.transform(nodes, lambda c: F.struct(
        (-F.log(uniform(key, level, c["name"])) / c["weight"]).alias("draw"), c["name"].alias("name"))))["name"]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard (int) that ``key`` reaches in the tree."""
    regions, racks, shards = tree.children()
    if not regions:
        raise ValueError("a tree needs a shard of positive weight")
    key = F.coalesce(key.cast("string"), F.lit(""))
    region = _winner(key, "region", _nodes(regions))
    rack = _winner(key, "rack", _below(racks, region))
    return _winner(key, "shard", _below(shards, rack)).cast("int")


def place(docs: DataFrame, tree: Tree, key: str = "doc_id") -> DataFrame:
    """The input rows with their shard as the last column; row by row, nothing is moved."""
    name = "shard"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, shard_of(F.col(f"`{key}`"), tree))


def write_shards(docs: DataFrame, path: str, tree: Tree, files: int = 1, key: str = "doc_id") -> None:
    """Writes the rows as Parquet, one folder a shard and ``files`` tasks (by row hash) each."""
    ready(docs.sparkSession)
    placed = place(docs, tree, key)
    shard = placed.columns[-1]
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]), F.lit(files))
    placed.repartition(max(1, len(tree.leaves) * files), F.col(shard), part).write.partitionBy(shard).parquet(path)


def index(docs: DataFrame, shards: int = SHARDS, base: int = BASE) -> DataFrame:
    """Per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard)."""
    ready(docs.sparkSession)
    tree, text = plan(shards, base), F.encode(text_of(), "UTF-8")
    buckets = max(1, -(-docs.count() // (shards * PER_BUCKET)))
    groups = (docs.select("doc_id", (F.octet_length(text_of()) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
              .groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")))
    chunks = groups.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    bucket = F.floor(uniform(key, "bucket", F.concat_ws(":", "text_crc32", "first")) * buckets).cast("int")
    chunks = spill(chunks.select(
        "doc_id", "size", "text_crc32", "first", F.least(F.lit(CHUNK), F.col("n") - F.col("first")).alias("m"),
        shard_of(F.col("doc_id"), tree).alias("shard"), shard_of(F.col("doc_id"), tree.grow()).alias("grown_shard"),
        bucket.alias("bucket")), "chunks")
    # shards x buckets rows: what a shard's window holds grows as its rows / PER_BUCKET
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (chunks.groupBy("shard", "bucket").agg(F.sum("m").alias("held"))
              .select("shard", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start")))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32", "first").rowsBetween(Window.unboundedPreceding, -1)
    numbered = chunks.join(starts, ["shard", "bucket"]).withColumn("at", F.col("start") + F.coalesce(F.sum("m").over(within), F.lit(0)))
    return numbered.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
                           F.explode(F.sequence(F.col("at"), F.col("at") + F.col("m") - 1)).alias("slot"), "grown_shard")


def _leaf_rows(tree: Tree) -> str:
    return ", ".join(f"('{x.region}', '{x.rack}', '{x.shard}', {x.weight})" for x in tree.leaves if x.weight > 0)


def _sql_draw(level: str, weight: str) -> str:
    return f"-ln((('0x' || substr(md5(key || ':{level}:' || {level}), 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << 52}) / {weight}"


def _sql_descent(tag: str, tree: Tree) -> str:
    return f"""
leaves_{tag}(region, rack, shard, weight) AS (VALUES {_leaf_rows(tree)}),
region_{tag} AS (SELECT key, arg_min(region, {_sql_draw('region', 'w')}) AS region
    FROM keys, (SELECT region, sum(weight) AS w FROM leaves_{tag} GROUP BY region) GROUP BY key),
rack_{tag} AS (SELECT key, arg_min(rack, {_sql_draw('rack', 'w')}) AS rack
    FROM region_{tag} JOIN (SELECT region, rack, sum(weight) AS w FROM leaves_{tag} GROUP BY region, rack) USING (region) GROUP BY key),
shard_{tag} AS (SELECT key, arg_min(shard, {_sql_draw('shard', 'weight')})::INTEGER AS shard
    FROM rack_{tag} JOIN leaves_{tag} USING (rack) GROUP BY key),"""


# checksum: the reflected polynomial of CRC-32, a table of 256 steps, folded over the bytes
ORACLE = f"""
WITH crc_table AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
    FROM range(256) AS t(i)),
texts AS (SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS key, encode(coalesce(text, '')) AS bytes FROM documents),
sized AS (
    SELECT doc_id, key, octet_length(bytes) + {ROW_BYTES} AS size,
        xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(bytes), '..'), lambda x: ('0x' || x)::BIGINT)),
            lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
    FROM texts, crc_table),
keys AS (SELECT DISTINCT key FROM sized),{_sql_descent('now', plan(SHARDS))}{_sql_descent('grown', plan(SHARDS).grow())}
many AS (SELECT greatest(1, ceil(count(*) / {SHARDS * PER_BUCKET}))::BIGINT AS buckets FROM sized),
placed AS (
    SELECT s.*, n.shard, g.shard AS grown_shard, (row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1) // {CHUNK} * {CHUNK} AS first
    FROM sized s JOIN shard_now n USING (key) JOIN shard_grown g USING (key)),
dealt AS (
    SELECT *, floor((('0x' || substr(md5(key || ':bucket:' || text_crc32 || ':' || first), 1, 13))::BIGINT::DOUBLE + 0.5) / {1 << 52} * buckets) AS bucket
    FROM placed, many)
SELECT doc_id, size::BIGINT AS size, text_crc32, '{LAW}' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32, first) - 1 AS slot, grown_shard
FROM dealt"""
