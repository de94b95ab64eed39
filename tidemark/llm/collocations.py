"""Phrase collocations by SON partitioning.

Texts are lower-cased (A-Z), cut at punctuation and line breaks into pieces and those into words; a phrase is up to
``LONGEST`` words in a row inside a piece. Everything is counted per language.

1. Words are hashed once; the table of hashed pieces is written with a shard number (the writing task's, modulo ``SHARDS``).
   A shard holds a share of each language's words; its local support is that share of ``SUPPORT``, rounded up, so a phrase
   with ``SUPPORT`` occurrences reaches the local support of some shard.
2. Every shard is mined completely, level by level: phrases of k words whose two parts of k - 1 words are frequent
   in the shard are counted by Spark (a shard may span any number of tasks; tasks send counts, not occurrences).
3. The union of the shards' frequent phrases is the candidate set; one pass over all texts counts the
   candidates exactly, by their words. Then cuts are scored, phrases that a longer phrase explains are dropped and
   each language's best are ranked, in exact integers.

``SHARDS`` is fixed, so the local support stays at ``SUPPORT / SHARDS`` or above however large the corpus is; shards grow
instead. Sets pass from level to level as bit tables (16 bits a key, 128 MB at most): false positives only,
which cost counts and never change them; a fuller table passes more phrases to the exact counts.

Edge cases: null texts are empty, a null language is ``und``; texts without words add nothing; a text is cut
into segments of about ``SEGMENT`` bytes at piece ends, or inside a longer piece with its last words carried over,
so long texts cost memory only for a segment (or for one word longer than it); repeated rows count again;
ties rank by score, count, then phrase, which is unique; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bits
from .common import list_parts, mix64, ready, spill, text_of

SUPPORT = 100
LONGEST = 5
BEST = 2000
SHARDS = 8
SEGMENT = 1 << 18
HASH_BITS = 40  # of a phrase, in the shards' counts
DICTIONARY = 16 << 20  # bytes of the written words' dictionary: words repeat
UNIT = 1 << 19  # words counted at a time

# FIXED VALUES: bytes that end a piece, and bytes that part words
STOPS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(STOPS)] = 2
_STOP, _BLANK = re.compile(b"[" + re.escape(STOPS) + b"]"), re.compile(b"[" + BLANKS + b"]+")
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: int = _BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = self._row(self.base, n)
            self.down = self._row(self.inverse, n)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _row(base: int, n: int) -> np.ndarray:
        row = np.full(n, base, np.uint64)
        row[0] = 1
        return np.multiply.accumulate(row)


def tokens(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash, first of its piece) of each word of lower-cased bytes."""
    kind = _KIND[data]
    word = kind == 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    h = mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    h[h == 0] = 1
    piece = np.cumsum(kind == 2)[start] if len(data) else np.zeros(0, np.int64)
    first = np.ones(len(start), bool)
    first[1:] = piece[1:] != piece[:-1]
    return start, end, h, first


def segments(text: bytes, size: int = SEGMENT):
    """(bytes, carried words) that cover a text: cut at piece ends, else at blanks with the last words carried.

    A segment inside a piece holds more words than are carried on from it, however long they are.
    """
    at, carried = 0, 0
    while len(text) - at > size:
        cut = max(text.rfind(bytes([s]), at, at + size) for s in STOPS) + 1
        if cut > at:
            yield text[at:cut], carried
            at, carried = cut, 0
            continue
        stop = _STOP.search(text, at + size)
        last = stop.end() if stop else len(text)
        end = max(text.rfind(bytes([b]), at, at + size) for b in BLANKS)
        n = len(text[at:end].split()) if end > at else 0
        blank = _BLANK.search(text, max(at, end) if n else at + size, last)
        while n < LONGEST and blank:
            end = blank.start()
            n = len(text[at:end].split())
            blank = _BLANK.search(text, blank.end(), last)
        if n < LONGEST:  # the piece ends before
            yield text[at:last], carried
            at, carried = last, 0
            continue
        yield text[at:end], carried
        back, carried = end, LONGEST - 1
        for w in reversed(text[at:end].split()[-carried:]):
            back = text.rindex(w, at, back)
        at = back
    yield text[at:], carried


def _hashed(batches):
    """One row a segment: shard, language, hashes with a 0 at the end of each piece, carried and new words."""
    powers, shard = Powers(), TaskContext.get().partitionId() % SHARDS
    for batch in batches:
        lang, skip, n, values, sizes = [], [], [], [], []
        for code, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            for part, carried in segments(text.encode("utf-8", "surrogatepass").lower()):
                _, _, h, first = tokens(np.frombuffer(part, np.uint8), powers)
                if len(h) == 0:
                    continue
                values.append(np.append(np.insert(h, np.flatnonzero(first[1:]) + 1, np.uint64(0)), np.uint64(0)))
                lang.append(code)
                skip.append(carried)
                n.append(len(h) - carried)
                sizes.append(len(values[-1]))
        at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
        yield pa.record_batch([
            pa.array([shard] * len(lang), pa.int32()), pa.array(lang, pa.string()), pa.array(skip, pa.int32()),
            pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))],
            names=["shard", "lang", "skip", "n", "h"])


def salt(lang: str, shard: int = -1) -> np.uint64:
    d = int.from_bytes(hashlib.blake2b(f"{shard}:{lang}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return np.uint64(d)


def short(g: np.ndarray) -> np.ndarray:
    """The part of a phrase hash that the shards' counts go by; what it confuses is only counted once more."""
    return g & np.uint64((1 << HASH_BITS) - 1)


def keyed(g: np.ndarray, by: np.uint64) -> np.ndarray:
    return mix64(short(g) ^ by).view(np.int64)


def grams(w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of k words from each place on, of k - 1 words, whether the k words lie in one piece)."""
    g, ok, below = w, w != 0, w
    for j in range(1, k):
        below = g
        g = mix64(g[:-1] * _STEP + w[j:])
        ok = ok[:-1] & (w[j:] != 0)
    return g, below, ok


def _units(batches):
    """(shard, language, words, new ones) in units of about ``UNIT`` words."""
    held: dict[tuple[int, str], list] = {}
    total = 0
    for batch in batches:
        values, at = list_parts(batch.column("h"))
        values = values.view(np.uint64)
        for i, key in enumerate(zip(batch.column("shard").to_pylist(), batch.column("lang").to_pylist())):
            w = values[at[i]:at[i + 1]]
            new = np.ones(len(w), bool)
            new[:batch.column("skip")[i].as_py()] = False
            unit = held.setdefault(key, [0, [], []])
            unit[0] += len(w)
            unit[1].append(w.copy())
            unit[2].append(new)
            total += len(w)
            if total >= UNIT:  # what is held, of all shards and languages of the task
                key = max(held, key=lambda k: held[k][0])
                total -= held[key][0]
                yield *key, np.concatenate(held[key][1]), np.concatenate(held[key][2])
                del held[key]
    for key, unit in held.items():
        yield *key, np.concatenate(unit[1]), np.concatenate(unit[2])


def _count_level(k: int, table):
    def run(batches):
        for shard, lang, w, new in _units(batches):
            g, below, ok = grams(w, k)
            at = np.flatnonzero(ok & new[k - 1:])
            if k > 1 and len(at):
                by = salt(lang, shard)
                at = at[bits.contains(table.value, keyed(below[at], by))]
                at = at[bits.contains(table.value, keyed(below[at + 1], by))]
            got, n = np.unique(short(g[at]), return_counts=True)
            yield pa.record_batch([pa.array(np.full(len(got), shard, np.int32)), pa.array([lang] * len(got), pa.string()),
                                   pa.array(got.view(np.int64)), pa.array(n.astype(np.int64))], names=["shard", "lang", "g", "n"])

    return run


def _keys(with_shard: bool):
    def run(batches):
        for batch in batches:
            g, lang = batch.column("g").to_numpy().view(np.uint64), np.array(batch.column("lang").to_pylist(), object)
            shard = batch.column("shard").to_numpy() if with_shard else np.full(len(g), -1)
            out = np.zeros(len(g), np.int64)
            for pair in set(zip(lang.tolist(), shard.tolist())):
                at = (lang == pair[0]) & (shard == pair[1])
                out[at] = keyed(g[at], salt(*pair))
            yield pa.record_batch([pa.array(out)], names=["key"])

    return run


def _table(rows: DataFrame, with_shard: bool):
    return bits.bit_table(rows.mapInArrow(_keys(with_shard), "key long"), bits.words_for(rows.count()))


def _candidates(hashed: DataFrame, totals: DataFrame, support: int, longest: int) -> DataFrame:
    """(lang, g) of every phrase of up to ``longest`` words that is frequent in some shard."""
    whole = totals.groupBy("lang").agg(F.sum("n").alias("n_all"))
    need = spill(totals.join(whole, "lang").select(
        "shard", "lang", F.expr(f"(n * {support} + n_all - 1) div n_all").alias("need")), "need")
    found, table = None, None
    for k in range(1, longest + 1):
        counts = (hashed.mapInArrow(_count_level(k, table), "shard int, lang string, g long, n long")
                  .groupBy("shard", "lang", "g").agg(F.sum("n").alias("n")))
        frequent = spill(counts.join(need, ["shard", "lang"]).filter("n >= need").select("shard", "lang", "g"), f"level-{k}")
        found = frequent if found is None else found.unionByName(frequent)
        if table is not None:
            table.destroy()
        table = _table(frequent, True)
    table.destroy()
    return found.select("lang", "g").distinct()


def _count_candidates(longest: int, table):
    def run(batches):
        powers, held = Powers(), {}

        def counted(lang, unit):
            data = b"".join(unit[1])
            start, end, h, first = tokens(np.frombuffer(data, np.uint8), powers)
            _, _, other, _ = tokens(np.frombuffer(data, np.uint8), second)
            new = np.ones(len(h), bool)
            for byte, carried in unit[2]:
                i = np.searchsorted(start, byte)
                new[i:i + carried] = False
            cut = np.flatnonzero(first[1:]) + 1
            place = np.insert(np.arange(len(h)), cut, -1)
            w, v = np.insert(h, cut, np.uint64(0)), np.insert(other, cut, np.uint64(0))
            fresh, by = np.insert(new, cut, False), salt(lang)
            phrases, counts = [], []
            for k in range(1, longest + 1):
                g, _, ok = grams(w, k)
                at = np.flatnonzero(ok & fresh[k - 1:])
                at = at[bits.contains(table.value, keyed(g[at], by))]
                check = grams(v, k)[0][at]
                got, lead, back, n = np.unique(g[at], return_index=True, return_inverse=True, return_counts=True)
                odd = np.flatnonzero(check != check[lead][back])  # same hash, other words: counted by themselves
                n = n - np.bincount(back[odd], minlength=len(got))
                for i, c in zip([*at[lead].tolist(), *at[odd].tolist()], [*n.tolist(), *[1] * len(odd)]):
                    p = place[i]
                    phrases.append(b" ".join([data[start[j]:end[j]] for j in range(p, p + k)]))
                    counts.append(c)
            return pa.record_batch([pa.array([lang] * len(counts), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()),
                                    pa.array(counts, pa.int64())], names=["lang", "phrase", "f"])

        second = Powers(0xC2B2AE3D27D4EB4F)
        for batch in batches:
            for code, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                unit = held.setdefault(code, [0, [], []])
                for part, carried in segments(text.encode("utf-8", "surrogatepass").lower()):
                    if carried:
                        unit[2].append((unit[0], carried))
                    unit[1] += [part, b"\n"]
                    unit[0] += len(part) + 1
                    if unit[0] >= 2 * UNIT:
                        yield counted(code, unit)
                        unit = held[code] = [0, [], []]
        for code, unit in held.items():
            yield counted(code, unit)

    return run


def phrase_counts(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of 1 to ``longest`` words with f >= support, and (lang, n) word totals."""
    ready(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text")).filter("text <> ''")
    hashed = spill(texts.mapInArrow(_hashed, "shard int, lang string, skip int, n long, h array<long>"), "hashed",
                   **{"parquet.dictionary.page.size": str(DICTIONARY)})
    totals = spill(hashed.groupBy("shard", "lang").agg(F.sum("n").alias("n")), "totals")
    candidates = spill(_candidates(hashed, totals, support, longest), "candidates")
    table = _table(candidates, False)
    counted = texts.mapInArrow(_count_candidates(longest, table), "lang string, phrase string, f long")
    frequent = counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= support)
    frequent = spill(frequent.withColumn("k", F.length(F.regexp_replace("phrase", "[^ ]", "")) + 1), "phrases")
    return frequent, totals.groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, best: int = BEST) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    every, totals = phrase_counts(docs, support, longest)
    cands = every.filter("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    inner = cands.filter("k >= 3").select("lang", "a", F.explode(F.expr("""
        flatten(transform(sequence(2, k - 1), j -> transform(sequence(1, k - j + 1), i -> array_join(slice(w, i, j), ' '))))""")).alias("phrase"))
    inside = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = cands.join(inside, ["lang", "phrase"], "left").filter("longer is null or 100 * longer < 100 * a").drop("longer")
    cuts = kept.withColumn("cut", F.explode(F.expr("sequence(1, k - 1)"))).select(
        "lang", "phrase", "a", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("head"),
        F.expr("array_join(slice(w, cut + 1, k), ' ')").alias("tail"))
    parts = every.select("lang", F.col("phrase").alias("part"), "f")
    cuts = cuts.join(parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(totals, "lang")
    # counts below 10^18, products in 38 digits
    exact = F.expr("(cast(a as decimal(18, 0)) * cast(n as decimal(18, 0)) * 1000BD) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    scored = (cuts.withColumn("score", exact.cast("long")).groupBy("lang", "phrase")
              .agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.*"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= best)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


_GRAMS = "\nUNION ALL ".join(
    f"SELECT lang, {k} AS k, array_to_string(w[i : i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM pieces)"
    for k in range(1, LONGEST + 1))

ORACLE = rf"""
WITH lowered AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS MATERIALIZED (
    SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w
    FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM lowered)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM ({_GRAMS}) GROUP BY lang, k, phrase HAVING count(*) >= {SUPPORT}),
cands AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
inside AS (
    SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, a, array_to_string(w[i : i + j - 1], ' ') AS phrase
        FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM cands))) GROUP BY lang, phrase),
kept AS (SELECT c.* FROM cands c LEFT JOIN inside i USING (lang, phrase) WHERE i.longer IS NULL OR 100 * i.longer < 100 * c.a),
cuts AS (
    SELECT lang, phrase, a, j, array_to_string(w[1 : j], ' ') AS head, array_to_string(w[j + 1 : k], ' ') AS tail
    FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
scored AS (
    SELECT c.lang, c.phrase, c.a, c.j, h.f AS l, t.f AS r, n, ((1000::HUGEINT * a * n) // (h.f::HUGEINT * t.f))::BIGINT AS score
    FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.tail JOIN totals ON totals.lang = c.lang),
least_cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM least_cut QUALIFY rank <= {BEST}"""
