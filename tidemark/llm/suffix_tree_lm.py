"""Word language model: a probabilistic suffix tree over words, as Spark tables.

Tokens are words (A-Z lower-cased) and one end mark a text. The contexts are the runs of
preceding tokens of any length, the start of the text included:

* the root adds one to every word's count (the base score);
* a context's next tokens of at least ``LEAST`` occurrences are listed, at any size of the corpus;
* it is retained if they diverge from what its suffix gives by more than a chi-square test allows;
* a retained context gives its listed tokens their counts with absolute discounting and
  the rest of the mass to its suffix; others give what their suffix gives;
* a context is tried if its suffix, or the suffix of that, is retained (a branch ends after two
  lengths in a row without divergence), so the texts bound the length, no setting.

``grow`` counts level by level: tasks count the grams whose parts are frequent (bit tables
pass some more, the counts decide) and send them by ranges of their hash, packed, to tasks that add them up; joins with the level below give the test. In the first
three levels most grams are rare: 32 bits of each and its part are counted first, and whole hashes only of what is
frequent by them. Beyond four levels few places are left (eight, where more than 1/16 are): rounds of 4, 16, 64 ...
levels count at once all that continues an active context, and what grows from one such context is tested in one
task, one length after the other. ``score``
adds up, for every token, the gains log10(lam) of its retained contexts and log10(p / (lam q)) of their
listed edges over the base score: each is one looked-up value. The most frequent ones (``HOT``, of those above a part of
``WORD_SHARE``) are broadcast; the others are asked for in blocks of texts, packed by ranges of the hash, and the sums go back to the texts. All
counts cover every training document.

``fit`` makes a small ``Tree`` for one process, of frequent symbols and two of them as
context, bounded by shares of the corpus; ``score`` does not use it.

Edge cases: null and empty texts are one end mark; without training tokens all counts
are 0 and every token has probability 1 / (V + 1) = 1; rows with a null id are
scored but not learnt from (held_out null); repeated rows are learnt and
scored once each; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import default_buckets, release

from .bits import bit_table, contains, words_for
from .common import list_parts, mix64, ready, shuffles_go, spill, text_of, words_of

FOLDS, HELD = 7, 2
SYMBOL_SHARE = 2.0 ** -16
WORD_SHARE = 2.0 ** -20
PAIR_SHARE = 2.0 ** -15
EDGE_SHARE = 2.0 ** -18
LEAST = 5           # occurrences of an edge or pair context in small corpora
DISCOUNT = 0.75
STEP = 200_000      # tokens handled at a time
FLUSH = 3_000_000   # distinct n-grams a task holds before it sends them on
WIDE = np.int64(1 << 17)
RARE = 0
START = np.int64(0x53A9F1D27C0B6E15)  # stands for the start of a text
EDGE = np.int64(0x2545F4914F6CDD1D)   # tells a context from the same tokens as context and next token
BASE = np.uint64(0x9E3779B97F4A7C15)
SPREAD, MASK = np.uint64(0xD6E8FEB86659FD93), (1 << 64) - 1
SENT = 1 << 16      # rows of an Arrow batch that a task sends on
HOT = 1 << 20       # looked-up values that are broadcast, at most
TOKENS = {"compression": "zstd", "parquet.dictionary.page.size": str(1 << 22)}  # of the tables of hashes: a task's words fit the dictionary

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """Hashes of the lower-cased words and, last, of the end mark."""
    # all ASCII: lower() is the same, and faster
    ascii_only = F.octet_length(text) == F.char_length(text)
    words = words_of(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)))
    return F.concat(F.transform(words, lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(""))))


def _written(df: DataFrame, tag: str, **options) -> DataFrame:
    """``spill`` whose shuffle files go once the table is written, not when the driver happens to collect its garbage."""
    with shuffles_go(df.sparkSession):
        return spill(df, tag, **options)


def _parts(total: int) -> int:
    return max(16, total >> 21)


def held_out(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == HELD


def _slices(at: np.ndarray):
    """Ranges of documents of about ``STEP`` tokens together."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + STEP, side="right")) - 1)
        yield lo, hi
        lo = hi


class Symbols:
    """Symbol numbers of word hashes: 0 rare, 1.. frequent, last + 1 the start."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, end: int):
        order = np.argsort(hashes)
        self.words, self.counts = hashes[order], counts[order]
        big = (self.counts >= max(2, total * SYMBOL_SHARE)) | (self.words == end)
        self.symbol = np.where(big, np.cumsum(big), RARE)
        self.size = int(big.sum())
        self.start = self.size + 1
        self.of_symbol = self.counts[big]

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, count or -1 where the table does not hold the word)."""
        if len(self.words) == 0:
            return np.zeros(len(h), np.int64), np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = self.words[at] == h
        return np.where(known, self.symbol[at], RARE), np.where(known, self.counts[at], -1)

    def history(self, s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols one and two before each token; 0 where there is no such context."""
        one, two = np.roll(s, 1), np.roll(s, 2)
        one[first] = self.start
        second = first[np.append(np.diff(first) > 1, first[-1] + 1 < len(s))] + 1
        two[first] = RARE
        two[second] = self.start
        return one, two


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key in sorted ``keys``, -1 where absent."""
    if len(keys) == 0:
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _count_grams(grams_of):
    """Task-wise counts of the keys that ``grams_of(hashes, first places)`` gives."""
    def run(batches):
        held, size = [], 0

        def pack():
            keys = np.concatenate([k for k, _ in held])
            counts = np.concatenate([c for _, c in held])
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[new], np.add.reduceat(counts, new)

        for batch in batches:
            values, at = list_parts(batch.column(0))
            for lo, hi in _slices(at):
                keys, counts = np.unique(grams_of(values[at[lo]:at[hi]], at[lo:hi] - at[lo]), return_counts=True)
                if len(keys):
                    held.append((keys, counts))
                    size += len(keys)
            if size > FLUSH:
                held = [pack()]
                size = len(held[0][0])
                if size > FLUSH // 2:
                    yield pa.record_batch([pa.array(x) for x in held[0]], names=["gram", "n"])
                    held, size = [], 0
        if held:
            yield pa.record_batch([pa.array(x) for x in pack()], names=["gram", "n"])

    return run


def _edges(train: DataFrame, grams_of, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-gram keys of at least ``least`` occurrences, with counts."""
    rows = (train.select("t").mapInArrow(_count_grams(grams_of), "gram long, n long")
            .groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow())
    keys, counts = (rows.column(c).to_numpy().astype(np.int64) for c in ("gram", "n"))
    order = np.argsort(keys)
    return keys[order], counts[order]


class Tree:
    """Root distribution and retained contexts of one and two symbols."""

    def __init__(self, symbols: Symbols, total: int, words: int, n_docs: int, pairs, triples, contexts):
        self.symbols, self.total, self.n_words = symbols, total, words
        n = symbols.size
        rare = total - int(symbols.of_symbol.sum())
        counts = np.concatenate([[rare], symbols.of_symbol, [0]])
        self.root = (counts + 1.0) / (total + n + 1)
        self.root[symbols.start] = 0  # never a next symbol
        self.rare_base = rare + (words - n) + 1  # rare tokens + rare words + the unseen one
        held = np.concatenate([[0], symbols.of_symbol, [n_docs]]).astype(float)
        keys, c = pairs
        a, b = keys // WIDE, keys % WIDE
        use1 = self._diverges(a, c, held[a], self.root[b], n + 2)
        pair_keys, pair_counts = contexts
        j, x = triples[0] // WIDE, triples[0] % WIDE
        one = pair_keys % WIDE
        lam1, val1 = self._discounted(a, c, held, np.ones(n + 2, bool))
        suffix = self._prob1(one[j], x, keys, lam1, val1) if len(j) else np.zeros(0)
        use2 = self._diverges(j, triples[1], pair_counts[j].astype(float), suffix, len(pair_keys))
        use1[one[use2]] = True  # a retained context's suffix is retained
        self.lam1, val1 = self._discounted(a, c, held, use1)
        keep = use1[a]
        self.keys1, self.val1 = keys[keep], val1[keep]
        self.pair_keys = pair_keys
        self.lam2, val2 = self._discounted(j, triples[1], pair_counts.astype(float), use2)
        keep = use2[j]
        self.keys2, self.val2 = triples[0][keep], val2[keep]
        self.retained = int(use1.sum()), int(use2.sum())

    @staticmethod
    def _diverges(context, c, n, other, size) -> np.ndarray:
        """G-test of each context's next symbols against its suffix's distribution."""
        p = c / np.maximum(n, 1)
        listed = np.bincount(context, p, size)
        below = np.bincount(context, other, size)
        g = np.bincount(context, c * np.log(np.maximum(p, 1e-300) / np.maximum(other, 1e-300)), size)
        total = np.zeros(size)
        np.maximum.at(total, context, n)
        rest, rest_other = np.maximum(1 - listed, 0), np.maximum(1 - below, 1e-12)
        g = g + np.where(rest > 0, total * rest * np.log(np.maximum(rest, 1e-300) / rest_other), 0)
        df = np.bincount(context, minlength=size).astype(float)
        return (df > 0) & (2 * g > df + 4 * np.sqrt(2 * df) + 10)

    @staticmethod
    def _discounted(context, c, held, use) -> tuple[np.ndarray, np.ndarray]:
        """(weight of the suffix's distribution by context, own share by edge)."""
        value = (c - DISCOUNT) / np.maximum(held[context], 1) if len(c) else np.zeros(0)
        own = np.bincount(context, value, len(held))
        return np.where(use, np.maximum(1 - own, 0), 1.0), value

    def _prob1(self, a, b, keys, lam, val) -> np.ndarray:
        at = _find(keys, a * WIDE + b)
        return lam[a] * self.root[b] + (np.where(at >= 0, val[at], 0) if len(val) else 0)

    def log10(self, s: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 of each token's symbol in its longest retained suffix state."""
        one, two = self.symbols.history(s, first)
        p = self._prob1(one, s, self.keys1, self.lam1, self.val1)
        if len(self.keys2):
            j = _find(self.pair_keys, two * WIDE + one)
            own = _find(self.keys2, j * WIDE + s)
            own = np.where((j >= 0) & (own >= 0), self.val2[own], 0)
            p = np.where(j >= 0, self.lam2[j] * p + own, p)
        return np.log10(p)


def fit(train: DataFrame) -> tuple[Tree, DataFrame]:
    """``train``: token arrays ``t``. The bounded tree and the (hash, c) table of all words; see ``grow``."""
    counts = spill(train.select(F.explode("t").alias("hash")).groupBy("hash").agg(F.count("*").alias("c")), "word-counts")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, words, n_docs = int(sums.n), int(sums.v), train.count()
    end = train.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("h")).first().h
    top = counts.filter((F.col("c") >= total * WORD_SHARE) | (F.col("hash") == end)).toArrow()
    symbols = Symbols(top.column("hash").to_numpy(), top.column("c").to_numpy(), total, end)
    edge, pair = max(LEAST, math.ceil(total * EDGE_SHARE)), max(LEAST, math.ceil(total * PAIR_SHARE))
    held = train.sparkSession.sparkContext.broadcast(symbols)

    def pair_grams(h, first):
        s = held.value.look_up(h)[0]
        one, _ = held.value.history(s, first)
        return (one * WIDE + s)[one > 0]

    keys, c = _edges(train, pair_grams, edge)
    # contexts of two symbols: frequent pairs that end in a symbol (not rare, not the end)
    end_symbol = int(symbols.look_up(np.array([end]))[0][0]) if len(symbols.words) else -1
    b = keys % WIDE
    is_context = (c >= pair) & (b != RARE) & (b != end_symbol)
    contexts = keys[is_context], c[is_context]
    context_keys = train.sparkSession.sparkContext.broadcast(contexts[0])

    def triple_grams(h, first):
        s = held.value.look_up(h)[0]
        one, two = held.value.history(s, first)
        j = _find(context_keys.value, two * WIDE + one)
        return (j * WIDE + s)[(j >= 0) & (two > 0)]

    triples = _edges(train, triple_grams, edge)
    return Tree(symbols, total, words, n_docs, (keys, c), triples, contexts), counts


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """The first ``n`` powers, or more, of an odd number and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, x, np.uint64))])
                      for x in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64)))]
    return _POWERS


class Runs:
    """Hashes of the runs of tokens of some texts, each text begun by ``START``."""

    def __init__(self, values: np.ndarray, at: np.ndarray):
        size = np.diff(at) + 1
        self.x = np.insert(values, at[:-1], START)
        first = np.cumsum(size) - size
        self.owner = np.repeat(np.arange(len(size)), size)
        self.within = np.arange(len(self.x)) - first[self.owner]
        up, self.down = _powers(len(self.x))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.x.view(np.uint64) * up[:len(self.x)], dtype=np.uint64)])

    def of(self, end: np.ndarray, k: int) -> np.ndarray:
        """Of the ``k`` tokens before each place; one token is its own hash."""
        if k == 1:
            return self.x[end - 1]
        whole = (self.sums[end] - self.sums[end - k]) * self.down[end - k]
        return mix64(whole + np.uint64(k * int(SPREAD) & MASK)).view(np.int64)

    def context(self, at: np.ndarray, k: int) -> np.ndarray:
        return self.of(at, k) ^ EDGE

    def gram(self, at: np.ndarray, k: int) -> np.ndarray:
        return self.of(at + 1, k + 1)

    def places(self, kept: list[np.ndarray], k: int) -> np.ndarray:
        """Tokens whose context of ``k`` tokens may be tried: that of k - 1 or of k - 2 may be retained."""
        at = np.flatnonzero(self.within > 0)
        was = np.ones(len(at), bool)
        for j in range(1, k):
            now = contains(kept[j - 1], self.context(at, j))
            go = (now | was) & (self.within[at] > j)
            at, was = at[go], now[go]
        return at


def _runs(batches):
    for batch in batches:
        values, at = list_parts(batch.column(0))
        for lo, hi in _slices(at):
            yield Runs(values[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])


def _able(runs: Runs, kept: list, listed: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose context of ``k`` tokens may be frequent and tried, and whether the token may be listed there."""
    at = runs.places(kept, k)
    # fewer than LEAST occurrences of a part are no more of the whole; up to three tokens all are listed
    part = min(k, 3)
    begin = contains(listed[part - 1], runs.of(at - k + part, part))
    at = at[begin | (runs.within[at] == 1) if k == 1 else begin]
    return at, contains(listed[k - 1], runs.gram(at, k - 1))


def _slot(gram: np.ndarray, parts: int) -> np.ndarray:
    """32 bits of a gram and its part."""
    g = gram.view(np.uint64)
    return g >> np.uint64(32) << np.uint64(32) | (g & np.uint64(0xFFFFFFFF)) % np.uint64(parts)


def _count_slots(k: int, kept: list, listed: list, parts: int):
    """Task-wise counts of the slots of a level's grams, packed by part."""
    def pack(held):
        slots, counts = np.unique(np.concatenate(held), return_counts=True)
        part = (slots & np.uint64(0xFFFFFFFF)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        high, counts = (slots[order] >> np.uint64(32)).astype(np.uint32), np.minimum(counts[order], 255).astype(np.uint8)
        ends = np.cumsum(np.bincount(part, minlength=parts))
        some = np.flatnonzero(np.diff(ends, prepend=0))
        cut = [(ends[p - 1] if p else 0, ends[p]) for p in some]
        return pa.record_batch([pa.array(some, pa.int64()), pa.array([high[a:b].tobytes() for a, b in cut], pa.binary()),
                                pa.array([counts[a:b].tobytes() for a, b in cut], pa.binary())], names=["part", "slots", "counts"])

    def run(batches):
        held, size = [], 0
        tables = [x.value for x in kept], [x.value for x in listed]
        for runs in _runs(batches):
            at, edge = _able(runs, *tables, k)
            held.append(_slot(runs.gram(at[edge], k), parts))
            size += len(held[-1])
            if size > FLUSH // 2:
                yield pack(held)
                held, size = [], 0
        if size:
            yield pack(held)

    return run


def _frequent_slots(batches):
    """Slots of a part with ``LEAST`` occurrences or more."""
    held: dict[int, list] = {}
    for batch in batches:
        for part, slots, counts in zip(*(batch.column(c).to_pylist() for c in range(3))):
            held.setdefault(part, []).append((np.frombuffer(slots, np.uint32), np.frombuffer(counts, np.uint8)))
    for part, some in held.items():
        slots, n = (np.concatenate(x) for x in zip(*some))
        order = np.argsort(slots, kind="stable")
        slots, n = slots[order], n[order].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
        found = slots[new][np.add.reduceat(n, new) >= LEAST].astype(np.uint64)
        yield pa.record_batch([pa.array((found << np.uint64(32) | np.uint64(part)).view(np.int64))], names=["slot"])


def _sums(cols: list[np.ndarray]) -> list[np.ndarray]:
    """Columns, first the key, last the count, summed by key and in the unsigned order of the keys."""
    order = np.argsort(cols[0].view(np.uint64))
    keys = cols[0][order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return [keys[new], *(c[order[new]] for c in cols[1:-1]), np.add.reduceat(cols[-1][order], new)]


def _packed(rows_of, names: list[str], parts: int, most: int, read):
    """Task-wise sums of the rows that ``rows_of`` gives of what ``read`` makes of the batches: tuples of columns, first
    the key, last the count. Each part of the keys (a range of their upper bits) goes out as one row of packed columns."""
    def sent(cols):
        part = ((cols[0].view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        ends = np.searchsorted(part, np.arange(parts + 1))
        some = np.flatnonzero(np.diff(ends))
        step = max(1, len(some) * SENT // len(part))
        for at in (some[lo:lo + step] for lo in range(0, len(some), step)):
            yield pa.record_batch([pa.array(at, pa.int64()), *(pa.array([c[ends[p]:ends[p + 1]].tobytes() for p in at], pa.binary()) for c in cols)],
                                  names=["part", *names])

    def run(batches):
        held, size = [], 0
        for some in read(batches):
            for got in rows_of(some):
                if len(got[0]):
                    held.append(got)
                    size += len(got[0])
                if size > most:
                    held = [_sums([np.concatenate(x) for x in zip(*held)])]
                    size = len(held[0][0])
                    if size > most // 2:
                        yield from sent(held[0])
                        held, size = [], 0
        if held:
            yield from sent(_sums([np.concatenate(x) for x in zip(*held)]))

    return run


def _gathered(names: list[str], least: int):
    """The sums of ``least`` or more of each part."""
    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for part, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(part, []).append([np.frombuffer(x, np.int64) for x in packed])
        while held:
            cols = _sums([np.concatenate(x) for x in zip(*held.popitem()[1])])
            some = cols[-1] >= least
            cols = [c[some] for c in cols]
            for lo in range(0, len(cols[0]), SENT):
                yield pa.record_batch([pa.array(c[lo:lo + SENT]) for c in cols], names=names)

    return run


def _summed(train: DataFrame, rows_of, names: list[str], parts: int, least: int, most: int = FLUSH // 8, read=_runs) -> DataFrame:
    """Sums by key over all texts. Tasks send packed columns, so the rows that are shuffled are few and not built one by one."""
    return (train.mapInArrow(_packed(rows_of, names, 4 * parts, most, read), ", ".join(["part long", *(f"{x} binary" for x in names)]))
            .repartition(parts, "part").mapInArrow(_gathered(names, least), ", ".join(f"{x} long" for x in names)))


def _words(batches):
    for batch in batches:
        values, at = list_parts(batch.column(0))
        for lo, hi in _slices(at):
            yield np.unique(values[at[lo]:at[hi]], return_counts=True)


def _once(key: np.ndarray, *others: np.ndarray) -> tuple:
    return (key, *others, np.ones(len(key), np.int64))


def _level_grams(k: int, kept: list, listed: list, slots, parts: int):
    """Places of a level's listed grams (parent: the gram of the suffix); beyond three tokens also of
    its contexts (gram and context equal, parent the suffix)."""
    def rows(runs):
        at, edge = _able(runs, [x.value for x in kept], [x.value for x in listed], k)
        if slots is None:
            context = runs.context(at, k)
            yield _once(context, context, runs.context(at, k - 1))
        at = at[edge]
        gram = runs.gram(at, k)
        if slots is not None:
            some = contains(slots.value, _slot(gram, parts).view(np.int64))
            at, gram = at[some], gram[some]
        yield _once(gram, runs.context(at, k), runs.gram(at, k - 1))

    return rows


def _deep_grams(k: int, more: int, active, triples):
    """Places of the contexts and grams of the ``more`` levels above ``k``, of the places whose context of
    ``k`` tokens (the root) may be active."""
    def rows(runs):
        at = np.flatnonzero(runs.within >= k)
        root = runs.context(at, k)
        some = contains(active.value, root)
        at, root = at[some], root[some]
        for j in range(k + 1, k + more + 1):
            go = runs.within[at] >= j
            at, root = at[go], root[go]
            go = contains(triples.value, runs.of(at - j + 3, 3))
            at, root = at[go], root[go]
            if not len(at):
                return
            context, level = runs.context(at, j), np.full(len(at), j)
            yield _once(context, context, runs.context(at, j - 1), root, level)
            yield _once(runs.gram(at, j), context, runs.gram(at, j - 1), root, level)

    return rows


def _with_active(k: int, active):
    """Texts with a place whose context of ``k`` tokens may be active."""
    def run(batches):
        for batch in batches:
            values, at = list_parts(batch.column(0))
            some = [np.zeros(0, np.int64)]
            for lo, hi in _slices(at):
                runs = Runs(values[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                places = np.flatnonzero(runs.within >= k)
                places = places[contains(active.value, runs.context(places, k))]
                some.append(lo + np.unique(runs.owner[places]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(some)))], names=["t"])

    return run


LEVEL = ("level long, gram long, context long, parent long, c long, q double, p double, held long, lam double, "
         "retained boolean, suffix_retained boolean")


def _settle(k: int, more: int):
    """Tests the ``more`` levels above ``k``, one after the other, for the roots of a partition. Rows of level ``k`` have p."""
    def run(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        all_rows = pa.Table.from_batches(held)
        gram, context, parent, level, n = (all_rows.column(c).to_numpy() for c in ("gram", "context", "parent", "level", "n"))
        order = np.argsort(level, kind="stable")
        ends = np.searchsorted(level[order], np.arange(k, k + more + 2))
        own = order[ends[0]:ends[1]]
        p, kept = all_rows.column("p").to_numpy()[own], all_rows.column("retained").to_numpy(zero_copy_only=False)[own].astype(bool)
        active, place = np.unique(context[own], return_index=True)
        kept = kept[place]
        by = np.argsort(gram[own])
        below, below_p = gram[own][by], p[by]
        for j in range(1, more + 1):
            own = order[ends[j]:ends[j + 1]]
            heads = own[gram[own] == context[own]]
            suffix = _find(active, parent[heads])
            heads, suffix = heads[suffix >= 0], suffix[suffix >= 0]
            by = np.argsort(context[heads])
            heads, suffix_kept = heads[by], kept[suffix[by]] if len(heads) else np.zeros(0, bool)
            tails = own[gram[own] != context[own]]
            of, under = _find(context[heads], context[tails]), _find(below, parent[tails])
            some = (of >= 0) & (under >= 0)
            tails, of, q = tails[some], of[some], below_p[under[some]] if some.any() else np.zeros(0)
            if not len(tails):
                return
            c, total, size = n[tails].astype(float), n[heads].astype(float), len(heads)
            listed, df = np.bincount(of, c, size), np.bincount(of, minlength=size).astype(float)
            rest = np.maximum(total - listed, 0)
            g = np.bincount(of, c * np.log(c / total[of] / q), size) + rest * np.log(
                np.where(rest > 0, rest / total, 1) / np.where(rest > 0, np.maximum(1 - np.bincount(of, q, size), 1e-12), 1))
            keep = (df > 0) & (2 * g > df + 4 * np.sqrt(2 * df) + 10)
            lam = 1 - (listed - DISCOUNT * df) / total
            p = np.where(keep[of], lam[of] * q + (c - DISCOUNT) / total[of], q)
            yield pa.record_batch([pa.array(x) for x in (
                np.full(len(tails), k + j), gram[tails], context[tails], parent[tails], n[tails], q, p, n[heads][of], lam[of],
                keep[of], suffix_kept[of])], names=[x.split()[0] for x in LEVEL.split(", ")])
            go = (df > 0) & (keep | suffix_kept)
            active, kept = context[heads][go], keep[go]
            tails, p = tails[go[of]], p[go[of]]
            by = np.argsort(gram[tails])
            below, below_p = gram[tails][by], p[by]

    return run


def _next_level(train: DataFrame, k: int, below: DataFrame, held: DataFrame | None, kept: list, listed: list, total: int) -> DataFrame:
    """The level's rows; ``held``: its contexts where they are known (up to three tokens), else they are counted."""
    slots, parts = None, max(12, total >> 21)
    if held is not None:  # most grams are rare: what is frequent by 32 bits and its part is counted by its whole hash
        found = _written(train.mapInArrow(_count_slots(k, kept, listed, parts), "part long, slots binary, counts binary")
                      .repartition(parts, "part").mapInArrow(_frequent_slots, "slot long"), "lm-slots")
        slots = bit_table(found, words_for(found.count()))
        release(found)
    rows = _summed(train, _level_grams(k, kept, listed, slots, parts), ["gram", "context", "parent", "n"], _parts(total), LEAST)
    if held is None:
        rows = _written(rows, "lm-grams")
        held = rows.filter("gram = context").select("context", F.col("parent").alias("suffix"), F.col("n").alias("held"))
    if k == 1:
        held = held.select("context", "held", F.lit(True).alias("suffix_retained"))
    else:  # the bit tables passed some more
        tried = below.filter("retained or suffix_retained").select(F.col("context").alias("suffix"), F.col("retained").alias("suffix_retained"))
        held = held.join(tried.distinct(), "suffix").drop("suffix")
    edges = _written(rows.filter("gram <> context").select("gram", "context", "parent", F.col("n").alias("c"))
                  .join(below.select(F.col("gram").alias("parent"), F.col("p").alias("q")), "parent").join(held, "context"), "lm-edges")
    release(rows)
    if slots is not None:
        slots.unpersist()
    rest = F.col("held") - F.col("listed")
    g = F.col("g") + F.when(rest > 0, rest * F.log(rest / F.col("held") / F.greatest(1 - F.col("under"), F.lit(1e-12)))).otherwise(0.0)
    tests = edges.groupBy("context").agg(
        F.first("held").alias("held"), F.sum("c").alias("listed"), F.sum("q").alias("under"), F.count("*").alias("df"),
        F.sum(F.col("c") * F.log(F.col("c") / F.col("held") / F.col("q"))).alias("g")).select(
        "context", (2 * g > F.col("df") + 4 * F.sqrt(2.0 * F.col("df")) + 10).alias("retained"),
        (1 - (F.col("listed") - DISCOUNT * F.col("df")) / F.col("held")).alias("lam"))
    here = F.col("lam") * F.col("q") + (F.col("c") - DISCOUNT) / F.col("held")
    level = _written(edges.join(tests, "context").withColumn("p", F.when(F.col("retained"), here).otherwise(F.col("q")))
                     .withColumn("level", F.lit(k).cast("long")).select(*(x.split()[0] for x in LEVEL.split(", "))), "lm-level")
    release(edges)
    return level


def _next_levels(train: DataFrame, k: int, more: int, below: DataFrame, active, triples, total: int) -> DataFrame:
    """The rows of the ``more`` levels above ``k``; what grows from one context of ``k`` tokens is settled in one task."""
    rows = _summed(train, _deep_grams(k, more, active, triples), ["gram", "context", "parent", "root", "level", "n"], _parts(total), LEAST).select(
        "*", F.lit(None).cast("double").alias("p"), F.lit(None).cast("boolean").alias("retained"))
    last = below.filter("retained or suffix_retained").select(
        "gram", "context", "parent", F.col("context").alias("root"), "level", F.col("c").alias("n"), "p", "retained")
    return _written(rows.union(last).repartition("root").mapInArrow(_settle(k, more), LEVEL), "lm-level")


def grow(train: DataFrame) -> tuple[DataFrame, int, int, list[DataFrame], list[int], list, list]:
    """The model as tables: word counts (hash, c), their sum and number, and the listed next tokens of all
    contexts, in tables of one context length or several; then the greatest length of each table and
    bit tables of its retained contexts and of its grams.

    Rows: level (the context's length), gram (hash of context and token), context, parent (gram of the suffix), c, q and p (the
    token's probability in the suffix and here), held (occurrences of the context), lam (weight of the suffix), retained,
    suffix_retained. Every context and token of ``LEAST`` occurrences is listed, at any size of the corpus. A context is tried if its
    suffix is retained or its suffix's suffix is, so there are as many levels as the texts bear.
    """
    spark, texts = train.sparkSession, train
    counts = _written(_summed(train, lambda words: [words], ["hash", "c"], default_buckets(spark), 1, FLUSH // 2, _words), "word-counts")
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"),
                      F.coalesce(F.max(F.when(F.col("hash") == F.xxhash64(F.lit("")), F.col("c"))), F.lit(0)).alias("texts")).first()
    total, words = int(sums.n), int(sums.v)
    frequent = counts.filter(F.col("c") >= LEAST)
    below = frequent.select(F.col("hash").alias("gram"), ((F.col("c") + 1.0) / (total + words + 1)).alias("p"))
    size = below.count()
    levels, tops, kept, listed = [], [], [], [bit_table(below.select("gram"), words_for(size))]
    as_context = F.col("hash").bitwiseXOR(F.lit(int(EDGE)))
    held = frequent.select(as_context.alias("context"), F.col("c").alias("held")).union(
        spark.range(1).select(F.lit(int(START ^ EDGE)).alias("context"), F.lit(int(sums.texts)).alias("held")))
    k, more, places = 0, 1, total if size else 0
    while places:
        if k < 4 or (places > total // 16 and k < 8):
            level, more = _next_level(train, k + 1, below, held, kept, listed, total), 1
        else:
            roots = below.filter("retained or suffix_retained").select("context").distinct()
            active = bit_table(roots, words_for(roots.count()))
            if more > 1:
                some = _written(train.mapInArrow(_with_active(k, active), "t array<long>"), "lm-active", **TOKENS)
                if train is not texts:
                    release(train)
                train = some
            more *= 4
            level = _next_levels(train, k, more, below, active, listed[2], total)
        k += more
        ended = F.col("level") == k
        found = level.groupBy("level", "context").agg(
            F.first("held").alias("held"), F.first("retained").alias("r"), F.first("suffix_retained").alias("s"), F.count("*").alias("n")).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("r"), 1)).alias("r"),
            F.coalesce(F.sum(F.when(ended & (F.col("r") | F.col("s")), F.col("held"))), F.lit(0)).alias("places")).first()
        places = int(found.places)
        levels.append(level)
        tops.append(k)
        kept.append(bit_table(level.filter("retained").select("context").distinct(), words_for(int(found.r))))
        listed.append(bit_table(level.select("gram"), words_for(int(found.n))))
        below = level.filter(ended)
        held = None
        if k < 3:  # every run of k + 1 tokens that is frequent is listed
            held = level.select(F.col("gram").bitwiseXOR(F.lit(int(EDGE))).alias("context"),
                                F.col("parent").bitwiseXOR(F.lit(int(EDGE))).alias("suffix"), F.col("c").alias("held"))
    if train is not texts:
        release(train)
    return counts, total, words, levels, tops, kept, listed[1:]


def _hot(values: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent rows of ``values`` (hash, n, value), at most ``HOT``, by hash."""
    size = F.floor(8 * F.log2(F.col("n"))).cast("long")
    some = values.filter(F.col("n") >= F.greatest(F.lit(1.0), F.lit(total * WORD_SHARE / 8)))
    left, least = HOT, None
    for r in sorted(some.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"]):
        left -= r["count"]
        if left < 0:
            break
        least = r["size"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0)
    top = some.filter(size >= least).select("hash", "value").toArrow()
    hashes, gains = top.column("hash").to_numpy().astype(np.int64), top.column("value").to_numpy().astype(float)
    order = np.argsort(hashes)
    return hashes[order], gains[order]


class _Places:
    """Places of hashes in a sorted table, met by the leading bits of the hash."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(1, min(24, len(keys).bit_length()))
        self.shift = np.int64(64 - bits)
        self.half = np.int64(1 << (bits - 1))
        self.start = np.searchsorted(keys >> self.shift, np.arange(-self.half, self.half + 1))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Place of each, -1 where absent."""
        found = np.full(len(wanted), -1, np.int64)
        bucket = (wanted >> self.shift) + self.half
        at, end = self.start[bucket], self.start[bucket + 1]
        left = np.flatnonzero(at < end)
        at, end, wanted = at[left], end[left], wanted[left]
        while len(left):
            hit = self.keys[at] == wanted
            found[left[hit]] = at[hit]
            at = at + 1
            go = ~hit & (at < end)
            left, at, end, wanted = left[go], at[go], end[go], wanted[go]
        return found


def _by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unsigned order of the keys, the parts (ranges of their upper bits) that hold some, and where each part ends in it."""
    order = np.argsort(keys.view(np.uint64))
    part = ((keys[order].view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    ends = np.searchsorted(part, np.arange(parts + 1))
    return order, np.flatnonzero(np.diff(ends)), ends


ASKED = "part long, kind int, block long, docs int, ids binary, keys binary, owners binary, known binary, base binary, tree binary"
VALUES, WANTED, HEADS = 0, 1, 2


def _asked(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
    return pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=[x.split()[0] for x in ASKED.split(", ")])


def _rows_by_part(kind: int, block: int, docs: int, keys: np.ndarray, owners: np.ndarray, values, parts: int):
    """Packed rows, one for each part that holds some of the keys; ``SENT`` keys or one row a batch."""
    order, some, ends = _by_part(keys, parts)
    keys, owners = keys[order], owners[order]
    values = None if values is None else values[order]
    step = max(1, len(some) * SENT // max(1, len(keys)))
    for at in (some[lo:lo + step] for lo in range(0, len(some), step)):
        cut = [(int(p), int(ends[p]), int(ends[p + 1])) for p in at]
        yield _asked([(p, kind, block, docs, None, keys[a:b].tobytes(), owners[a:b].tobytes(), None, None,
                       None if values is None else values[a:b].tobytes()) for p, a, b in cut])


def _packed_values(parts: int):
    """The values of a task by parts: keys, whether each is a word, amounts."""
    def run(batches):
        held, size = [], 0

        def packed():
            keys, level, value = (np.concatenate(x) for x in zip(*held))
            return _rows_by_part(VALUES, 0, 0, keys, (level == 0).astype(np.uint8), value, parts)

        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("hash", "level", "value")])
            size += batch.num_rows
            if size > FLUSH // 8:
                yield from packed()
                held, size = [], 0
        if size:
            yield from packed()

    return run


def _answered(batches):
    """Rows come by part, its values first: what the values add to the texts of each block; heads are passed on."""
    part, held, keys = None, [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != part:
                part, held, keys = row[0], [], None
            if row[1] == VALUES:
                held.append([np.frombuffer(x, kind) for x, kind in zip((row[5], row[6], row[9]), (np.int64, np.uint8, np.float64))])
                continue
            if row[1] == HEADS:
                yield _asked([row])
                continue
            if keys is None:
                keys, word, value = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, t) for t in (np.int64, np.uint8, float))
                order = np.argsort(keys)
                keys, word, value = keys[order], word[order].astype(bool), value[order]
            wanted, owner, docs = np.frombuffer(row[5], np.int64), np.frombuffer(row[6], np.uint32), row[3]
            found = _find(keys, wanted)
            owner, found = owner[found >= 0], found[found >= 0]
            some = np.unique(owner)
            at, known = np.searchsorted(some, owner), word[found]
            amount = value[found]
            sums = [np.bincount(at[which], w[which], len(some)).astype(kind).tobytes() if which.any() else b""
                    for which, w, kind in ((known, np.ones(len(found)), np.int64), (known, amount, np.float64), (~known, amount, np.float64))]
            if len(some):
                yield _asked([(row[0], WANTED, row[2], docs, None, None, some.astype(np.uint32).tobytes(), *sums)])


SCORED = "doc_id long, n_tokens long, n_known long, base double, tree double"


def _added(batches):
    """Rows of whole blocks: heads and what is added to them, by text."""
    heads, sums = {}, {}
    for batch in batches:
        for _, kind, block, docs, ids, n, owners, *packed in zip(*(c.to_pylist() for c in batch.columns)):
            total = sums.setdefault(block, [np.zeros(docs, np.int64), np.zeros(docs), np.zeros(docs)])
            at = slice(None)
            if kind == HEADS:
                heads[block] = ids, n, owners
            else:
                at = np.frombuffer(owners, np.uint32)
            for t, x in zip(total, packed):
                if x:
                    t[at] += np.frombuffer(x, t.dtype)
    for block, (ids, n, missing) in heads.items():
        out = [pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(missing, np.uint8).astype(bool)), np.frombuffer(n, np.int64), *sums.pop(block)]
        for lo in range(0, len(out[0]), SENT):
            yield pa.record_batch([pa.array(x[lo:lo + SENT]) if isinstance(x, np.ndarray) else x[lo:lo + SENT] for x in out],
                                  names=[x.split()[0] for x in SCORED.split(", ")])


def score(docs: DataFrame) -> DataFrame:
    """Per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    ready(spark)
    numbered = _written(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"),
                                 tokens(text_of()).alias("t")), "lm-tokens", **TOKENS)
    counts, total, words, levels, tops, kept, listed = grow(numbered.filter(~held_out()).select("t"))
    # what a token gains: words over the root, contexts and edges over their suffix
    values = counts.select("hash", F.lit(0).cast("long").alias("level"), F.col("c").alias("n"), F.log10(F.col("c") + 1.0).alias("value"))
    for level in levels:
        mine = level.filter("retained")
        values = values.union(mine.groupBy(F.col("context").alias("hash")).agg(
            F.first("level").alias("level"), F.first("held").alias("n"), F.log10(F.first("lam")).alias("value"))).union(
            mine.select(F.col("gram").alias("hash"), "level", F.col("c").alias("n"), F.log10(F.col("p") / F.col("lam") / F.col("q")).alias("value")))
    if levels:
        values = _written(values, "lm-values")
        release(counts, *levels)
    # the frequent ones are broadcast; all others are met by a join
    hot = spark.sparkContext.broadcast(_hot(values, total))

    parts = 4 * _parts(total)

    def run(batches):
        keys, gain = _Places(hot.value[0]), hot.value[1]
        contexts, grams = [x.value for x in kept], [x.value for x in listed]
        away: list[tuple[np.ndarray, np.ndarray]] = []
        heads: list[tuple] = []
        n_docs = n_away = block = 0

        def sent():
            ids, missing, *numbers = (np.concatenate(x) for x in zip(*heads))
            yield _asked([(block % parts, HEADS, block, n_docs, ids.tobytes(), numbers[0].tobytes(), missing.tobytes(), *(x.tobytes() for x in numbers[1:]))])
            owner, wanted = (np.concatenate(x) for x in zip(*away))
            if len(wanted):
                yield from _rows_by_part(WANTED, block, n_docs, wanted, owner, None, parts)

        for batch in batches:
            values, at = list_parts(batch.column("t"))
            rid, doc_id = batch.column("rid").to_numpy(), batch.column("doc_id")
            ids, missing = doc_id.fill_null(0).to_numpy(), doc_id.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            for lo, hi in _slices(at):
                runs, n = Runs(values[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]), np.diff(at[lo:hi + 1])
                if not n_docs:
                    block = int(rid[lo])

                def gained(places, wanted):
                    nonlocal n_away
                    found = keys.find(wanted)
                    owner, left = runs.owner[places], found < 0
                    away.append(((owner[left] + n_docs).astype(np.uint32), wanted[left]))
                    n_away += len(away[-1][0])
                    owner, found = owner[~left], found[~left]
                    return np.bincount(owner, gain[found], hi - lo).astype(float), np.bincount(owner, minlength=hi - lo)

                places = np.flatnonzero(runs.within > 0)
                base, known = gained(places, runs.x[places])
                tree, was, k = np.zeros(hi - lo), np.ones(len(places), bool), 1
                for top, context_table, gram_table in zip(tops, contexts, grams):
                    while k <= top and len(places):
                        context = runs.context(places, k)
                        now = contains(context_table, context)
                        gram = runs.gram(places[now], k)
                        edge = contains(gram_table, gram)
                        tree += gained(places[now], context[now])[0] + gained(places[now][edge], gram[edge])[0]
                        go = (now | was) & (runs.within[places] > k)  # the start of the text is the earliest token of all
                        places, was = places[go], now[go]
                        k += 1
                heads.append((ids[lo:hi], missing[lo:hi], n.astype(np.int64), known.astype(np.int64), base, tree))
                n_docs += hi - lo
                if n_away + n_docs > FLUSH // 4:
                    yield from sent()
                    away, heads, n_docs, n_away = [], [], 0, 0
        if n_docs:
            yield from sent()

    # the others look their values up in the task of their part, packed; a block of texts is one row a part
    asked = numbered.mapInArrow(run, ASKED).unionByName(values.select("hash", "level", "value").mapInArrow(_packed_values(parts), ASKED))
    out = (asked.repartition(max(1, parts // 4), "part").sortWithinPartitions("part", "kind").mapInArrow(_answered, ASKED)
           .repartition("block").mapInArrow(_added, SCORED))
    base = F.col("base") - F.col("n_tokens") * math.log10(total + words + 1)
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                      base.alias("base_score"), (base + F.col("tree")).alias("score"))
