"""Exact percentile ranks and quantiles without a global window.

A global ``Window.orderBy`` or ``percentile`` funnels every value through one
task. Ranks split the work instead, for all columns at once:

1. one sketch pass gives every column's approximate quantiles. They cut its values into cells:
   one for each sketch value (its copies) and one for the values strictly between two neighbours.
   A value held by many rows is always a sketch value, so open cells hold no hot value;
2. one counting pass gives the rows of each cell (columns x cells numbers, bounded by ``n_buckets``), hence
   how many rows lie before it. Rows on a sketch value have their rank from that alone and are not moved;
3. the other values move as narrow rows (row number, column, value), once by cell to be ranked there
   and once by row number, all columns of a row together; then they meet their row again.

Average-tie percentile rank is ``(rank_min + rank_max) / 2 / n``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import boundary, default_buckets

ROW = "__row_no"
MOST_BUCKETS = 4096


def _numbers(values: list, kind: str) -> Column:
    """A literal array as one string, which keeps plans of thousands of bounds short."""
    return F.from_json(F.lit("[" + ",".join(repr(v) for v in values) + "]"), T.ArrayType(T.DoubleType() if kind == "double" else T.LongType()))


class _Cells:
    """The cells of one column: sketch values ``edges``, and per cell the rows before it and in it.

    Cell 2i is what lies below ``edges[i]`` (and above the one before), cell 2i + 1 is ``edges[i]``.
    """

    def __init__(self, edges: list[float]):
        self.edges = edges
        self.before = self.held = [0] * (2 * len(edges) + 1)
        self.n = 0

    def cell(self, bucket: Column, v: Column) -> Column:
        i = bucket.cast("int")
        on = (i > 0) & (F.get(_numbers(self.edges, "double"), i - 1) == v)
        return F.when(on, 2 * i - 1).otherwise(2 * i)

    def count(self, held: dict[int, int]) -> None:
        self.held = [held.get(i, 0) for i in range(2 * len(self.edges) + 1)]
        self.before = [0]
        for x in self.held[:-1]:
            self.before.append(self.before[-1] + x)
        self.n = sum(self.held)


def _cut(df: DataFrame, cols: Sequence[str], buckets: int) -> tuple[DataFrame, list[_Cells]]:
    """``df`` with ``__v{i}`` (the value as double, null if missing) and ``__c{i}`` (its cell) of each column."""
    from pyspark.ml.feature import Bucketizer

    probs = [i / buckets for i in range(1, buckets)]
    sketch = df.agg(*[F.percentile_approx(_valid(c), probs, 10000).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    cells = [_Cells(sorted({float(x) + 0.0 for x in (sketch[f"b{i}"] or []) if abs(x) != float("inf")})) for i in range(len(cols))]
    df = df.withColumns({f"__v{i}": _valid(c) for i, c in enumerate(cols)})
    for i, c in enumerate(cells):
        if c.edges:
            df = Bucketizer(splits=[float("-inf"), *c.edges, float("inf")], inputCol=f"__v{i}", outputCol=f"__b{i}",
                            handleInvalid="keep").transform(df)
        else:
            df = df.withColumn(f"__b{i}", F.lit(0.0))
        v = F.col(f"__v{i}")
        df = df.withColumn(f"__c{i}", F.when(v.isNotNull(), c.cell(F.col(f"__b{i}"), v))).drop(f"__b{i}")
    return df, cells


def numbered_boundary(df: DataFrame) -> DataFrame:
    """``df`` written once with a number for each row (column ``ROW``)."""
    return boundary(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def with_pct_ranks(df: DataFrame, cols: Sequence[str], out: Sequence[str] | None = None,
                   n_buckets: int | None = None) -> DataFrame:
    """Add ``pandas``-style ``rank(pct=True)`` columns (average ties, nulls stay null).

    The rows are written once (a stage boundary that numbers them, unless ``df`` is one); the exchanges after it carry
    (row number, column, value) whatever the number of columns, and the final meeting of rows and
    ranks is by row number, which no value can make hot. AQE broadcasts the ranks when they are few.
    """
    out = list(out or [f"{c}_pct" for c in cols])
    names = [c for c in df.columns if c != ROW]
    numbered = df if ROW in df.columns else numbered_boundary(df)
    buckets = min(n_buckets or default_buckets(df.sparkSession), MOST_BUCKETS)
    rows, cells = _cut(numbered, cols, buckets)
    held: list[dict[int, int]] = [{} for _ in cols]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(f"__c{i}").alias("cell")) for i in range(len(cols))]))
    for r in (rows.select(each.alias("s")).select("s.*").filter("cell is not null")
              .groupBy("k", "cell").agg(F.count("*").alias("n")).collect()):  # columns x cells numbers
        held[r.k][r.cell] = r.n
    for c, h in zip(cells, held):
        c.count(h)

    def is_open(i: int) -> Column:
        return F.col(f"__c{i}") % 2 == 0

    parts = F.array(*[F.when(is_open(i), F.struct(F.lit(i).alias("k"), F.col(f"__c{i}").alias("cell"), F.col(f"__v{i}").alias("v")))
                      for i in range(len(cols))])
    narrow = rows.select(ROW, F.explode(F.filter(parts, lambda p: p.isNotNull())).alias("s")).select(ROW, "s.*")
    inside = Window.partitionBy("k", "cell").orderBy("v")
    upto = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    twice = narrow.withColumn("twice", F.rank().over(inside) + F.count("*").over(upto))
    ranks = twice.groupBy(ROW).agg(*[F.max(F.when(F.col("k") == i, F.col("twice"))).alias(f"__t{i}") for i in range(len(cols))])
    met = rows.join(ranks, ROW, "left")
    ranked = {}
    for i, (c, o) in enumerate(zip(cells, out)):
        before, own = F.get(_numbers(c.before, "long"), F.col(f"__c{i}")), F.get(_numbers(c.held, "long"), F.col(f"__c{i}"))
        double = F.when(is_open(i), F.col(f"__t{i}")).otherwise(own + 1)
        ranked[o] = F.when(F.col(f"__c{i}").isNotNull(), (before + double / F.lit(2)) / F.lit(max(c.n, 1)))
    return met.select(*[F.col(f"`{c}`") for c in names if c not in ranked], *[e.alias(o) for o, e in ranked.items()])


def _lerp(a: float, b: float, t: float) -> float:
    # numpy's linear interpolation, including its two-sided form
    diff = b - a
    if t >= 0.5:
        return b - diff * (1 - t)
    return a + diff * t


def _virtual_index(n: int, q: float) -> float:
    # numpy's "linear" method places quantile q at (n - 1) * q; pandas hands it a
    # percentage, which can change the last bit of q
    return (n - 1) * ((q * 100) / 100)


def _valid(c: str) -> F.Column:
    x = F.col(c).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), x)


def _brackets(df: DataFrame, cols, spec, eps_of, accuracy: int = 10000,
              extra: dict | None = None, extra_out: dict | None = None) -> dict:
    """Job 1: counts, extremes and sketch values around every wanted q (plus
    any caller aggregates that want to ride on the same scan)."""
    aggs = [e.alias(f"__x_{k}") for k, e in (extra or {}).items()]
    for i, c in enumerate(cols):
        probs = []
        for q in spec[c]:
            e = eps_of(c)
            probs += [max(0.0, float(q) - e), min(1.0, float(q) + e)]
        aggs += [F.count(_valid(c)).alias(f"n{i}"), F.min(_valid(c)).alias(f"mn{i}"),
                 F.max(_valid(c)).alias(f"mx{i}"),
                 F.percentile_approx(_valid(c), probs, accuracy).alias(f"p{i}")]
    r = df.agg(*aggs).first()
    if extra_out is not None:
        extra_out.update({k: r[f"__x_{k}"] for k in (extra or {})})
    return {c: (r[f"n{i}"], r[f"mn{i}"], r[f"mx{i}"], r[f"p{i}"]) for i, c in enumerate(cols)}


def _bracket_agg(df: DataFrame, pairs: list) -> dict:
    """One global aggregate (no shuffle) for brackets whose size is bounded:
    rows below, rows equal to each end (duplicates of the ends are counted,
    never listed) and the list of values strictly inside, which the sketch's
    rank error bounds by about 6 eps n."""
    aggs = []
    for k, p in enumerate(pairs):
        c, q, n, lo_idx, hi_idx, lo, hi, g = p
        x = _valid(c)
        aggs += [F.count_if(x < F.lit(lo)).alias(f"b{k}"), F.count_if(x == F.lit(lo)).alias(f"l{k}"),
                 F.count_if(x == F.lit(hi)).alias(f"h{k}"),
                 F.collect_list(F.when((x > F.lit(lo)) & (x < F.lit(hi)), x)).alias(f"v{k}")]
    r = df.agg(*aggs).first()
    out = {}
    for k, p in enumerate(pairs):
        lo, hi = p[5], p[6]
        counts: dict[float, int] = {}
        for v in r[f"v{k}"]:
            counts[v] = counts.get(v, 0) + 1
        if r[f"l{k}"]:
            counts[lo] = r[f"l{k}"]
        if r[f"h{k}"] and hi != lo:
            counts[hi] = r[f"h{k}"]
        out[k] = {"below": r[f"b{k}"], "values": list(counts.items())}
    return out


def _pick(inside: list, below: int, lo_idx: int, hi_idx: int, g: float) -> float | None:
    a = b = None
    cum = below
    for v, cnt in sorted(inside):
        if a is None and cum + cnt > lo_idx:
            a = v
        if cum + cnt > hi_idx:
            b = v
            break
        cum += cnt
    if a is None or b is None:
        return None
    return a if a == b else _lerp(a, b, g)


class _Wanted:
    """One order-statistic request: ranks ``lo_idx``, ``hi_idx`` (from 0) of ``n`` and the
    value bracket that is being narrowed; ``outer`` certainly holds both ranks."""

    def __init__(self, c, q, n, mn, mx, bracket):
        virt = _virtual_index(n, q)
        self.c, self.q, self.n = c, q, n
        self.lo_idx = math.floor(virt)
        self.hi_idx = min(self.lo_idx + 1, n - 1)
        self.g = virt - self.lo_idx
        self.outer = (float(mn), float(mx))
        self.lo, self.hi = bracket
        self.missed = False

    def as_pair(self) -> tuple:
        return (self.c, self.q, self.n, self.lo_idx, self.hi_idx, self.lo, self.hi, self.g)

    def counted(self, below: int, upto: int) -> str:
        """Takes the rows below ``lo`` and up to ``hi``. "in": both ranks lie in the
        bracket. "miss": they lie outside, the bracket is what is left. "low", "high": the
        two ranks part at that end of the bracket."""
        if below == self.hi_idx and below > self.lo_idx:
            return "low"
        if upto == self.hi_idx and upto > self.lo_idx:
            return "high"
        if below > self.lo_idx:
            self.outer = (self.outer[0], self.lo)
        elif upto <= self.hi_idx:
            self.outer = (self.hi, self.outer[1])
        else:
            self.outer = (self.lo, self.hi)
            return "in"
        self.lo, self.hi = self.outer
        self.missed = True
        return "miss"

    def parted(self, df: DataFrame, end: str) -> float:
        """The value between the ranks when they part at an end of the bracket."""
        x = _valid(self.c)
        left = x < F.lit(self.lo) if end == "low" else x <= F.lit(self.hi)
        r = df.agg(F.max(F.when(left, x)), F.min(F.when(~left, x))).first()
        return r[0] if r[0] == r[1] else _lerp(r[0], r[1], self.g)


def quantiles(df: DataFrame, spec: dict[str, Sequence[float]], accuracy: int = 10000, max_bracket: int = 200000,
              extra: dict | None = None, extra_out: dict | None = None) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles (numpy/pandas ``quantile``).

    No job moves a column. The first one takes counts, extremes and sketch
    values just below and above each wanted rank (``percentile_approx``,
    mergeable). Then each pass counts, for every open request, the rows below its
    bracket, up to its upper end and strictly inside; ranks that fell outside
    move the bracket to the part known to hold them. As long as more
    than ``max_bracket`` rows lie inside, a sketch of just these rows narrows the
    bracket (about ``accuracy`` / 4 times a pass, whatever the size); then they are listed.
    A value held by any number of rows becomes a bracket end, which is only counted.
    Returns ``{column: [value per q]}``.
    """
    cols = list(spec)
    values: dict[tuple, float | None] = {}
    eps = 2.0 / accuracy
    stats = _brackets(df, cols, spec, lambda c: eps, accuracy, extra, extra_out)
    open_: list[_Wanted] = []
    for c in cols:
        n, mn, mx, pv = stats[c]
        for j, q in enumerate(spec[c]):
            q = float(q)
            if n == 0:
                values[(c, q)] = None
            elif q <= 0.0 or n == 1:
                values[(c, q)] = float(mn)
            elif q >= 1.0:
                values[(c, q)] = float(mx)
            elif (c, q) not in values:
                values[(c, q)] = None
                open_.append(_Wanted(c, q, n, mn, mx, (pv[2 * j], pv[2 * j + 1])))
    # the first sketch's rank error bounds what lies inside: list it at once if that is enough
    listed = [w for w in open_ if 6 * eps * w.n + 2 <= max_bracket]
    while open_:
        counted = [w for w in open_ if w not in listed]
        got = _bracket_agg(df, [w.as_pair() for w in listed]) if listed else {}
        for k, w in enumerate(listed):
            below, inside = got[k]["below"], got[k]["values"]
            where = w.counted(below, below + sum(cnt for _, cnt in inside))
            if where != "miss":
                values[(w.c, w.q)] = (_pick(inside, below, w.lo_idx, w.hi_idx, w.g) if where == "in"
                                      else w.parted(df, where))
                open_.remove(w)
        listed, wide = [], []
        if counted:
            aggs = []
            for k, w in enumerate(counted):
                x = _valid(w.c)
                aggs += [F.count_if(x < F.lit(w.lo)).alias(f"b{k}"), F.count_if(x <= F.lit(w.hi)).alias(f"u{k}"),
                         F.count_if((x > F.lit(w.lo)) & (x < F.lit(w.hi))).alias(f"i{k}")]
            r = df.agg(*aggs).first()
            for k, w in enumerate(counted):
                where = w.counted(r[f"b{k}"], r[f"u{k}"])
                if where in ("low", "high"):
                    values[(w.c, w.q)] = w.parted(df, where)
                    open_.remove(w)
                elif where == "in":
                    if r[f"i{k}"] <= max_bracket:
                        listed.append(w)
                    else:
                        wide.append((w, r[f"u{k}"] - r[f"b{k}"], r[f"b{k}"], r[f"i{k}"]))
        if wide:
            aggs = []
            for k, (w, held, below, inside) in enumerate(wide):
                x = _valid(w.c)
                # ranks counted from the bracket's first row; its ends' copies are a part of ``held``
                at = [(i - below) / held for i in (w.lo_idx, w.hi_idx)]
                probs = [max(0.0, at[0] - eps), min(1.0, at[1] + eps)]
                aggs.append(F.percentile_approx(F.when((x >= F.lit(w.lo)) & (x <= F.lit(w.hi)), x), probs, accuracy).alias(f"p{k}"))
            r = df.agg(*aggs).first()
            for k, (w, _, _, _) in enumerate(wide):
                new = (r[f"p{k}"][0], r[f"p{k}"][1])
                # after a miss, or if the sketch cannot part the ends, halve what lies inside
                w.lo, w.hi = _halved(df, w, accuracy) if w.missed or new == (w.lo, w.hi) else new
    return {c: [values[(c, float(q))] for q in spec[c]] for c in cols}


def _halved(df: DataFrame, w: _Wanted, accuracy: int) -> tuple[float, float]:
    """A bracket end moved strictly inside, at the middle of what lies inside."""
    x = _valid(w.c)
    mid = df.agg(F.percentile_approx(F.when((x > F.lit(w.lo)) & (x < F.lit(w.hi)), x), 0.5, accuracy)).first()[0]
    return (w.lo, float(mid))


def median(df: DataFrame, col: str) -> float | None:
    return quantiles(df, {col: [0.5]})[col][0]
