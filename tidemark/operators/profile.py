"""Distinct counts that are only ever compared with small limits.

An exact ``count_distinct`` shuffles every distinct value; the rules here
only ask whether a column has at most a handful of values. An HLL sketch
(mergeable partials, no shuffle of values) screens all columns in one pass
and the exact count runs only for the columns whose estimate is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small_distinct_counts(df: DataFrame, cols: list[str], limit: int) -> dict[str, int]:
    """Exact distinct counts (nulls excluded) for columns with at most about
    ``limit`` values; larger columns get their estimate, which is certainly
    above ``limit`` (the sketch's error at these sizes is a few percent)."""
    if not cols:
        return {}
    q = [F.col(f"`{c}`") for c in cols]
    est = df.agg(*[F.approx_count_distinct(x, 0.01).alias(f"e{i}") for i, x in enumerate(q)]).first()
    screen = max(2 * limit, limit + 16)
    small = [i for i in range(len(cols)) if est[f"e{i}"] <= screen]
    out = {c: int(est[f"e{i}"]) for i, c in enumerate(cols)}
    if small:
        exact = df.agg(*[F.count_distinct(q[i]).alias(f"d{i}") for i in small]).first()
        for i in small:
            out[cols[i]] = int(exact[f"d{i}"])
    return out
