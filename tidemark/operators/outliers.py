"""Unrealistic tenure and charge values.

Every decision needs a few scalars (counts, medians, quartiles); they come
from one aggregate plus one exact-quantile call each, then the fix is a
column expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators.rank import quantiles


def tenure_outliers(df: DataFrame, report: dict) -> DataFrame:
    """Q1 + P15: abs of negatives; above 600 -> median of the rest (else 24);
    then a median above 365 means days (/30), a median above 50 with a
    maximum of at most 80 means years (x12)."""
    if "tenure" not in df.columns:
        return df
    t = F.col("tenure")
    hi = C.MOST_TENURE
    # one pass: negatives, and values above the limit once negatives are made positive
    r = df.agg(F.count_if(t < 0).alias("neg"), F.count_if(F.abs(t) > hi).alias("high")).first()
    count = r["neg"]
    df = df.withColumn("tenure", F.when(t < 0, F.abs(t)).otherwise(t))
    if r["high"] > 0:
        count += r["high"]
        rest = df.where(~(t > hi)).select(t.alias("x"))
        med = quantiles(rest, {"x": [0.5]})["x"][0]
        df = df.withColumn("tenure", F.when(t > hi, F.lit(float(med) if med is not None else 24.0))
                           .otherwise(t))
    med_all, mx = quantiles(df, {"tenure": [0.5, 1.0]})["tenure"]
    if med_all is not None and med_all > 365:
        df = df.withColumn("tenure", t / 30)
        report["tenure_conversion"] = "days_to_months"
    elif med_all is not None and med_all > 50 and mx is not None and mx < 100 and mx <= 80:
        df = df.withColumn("tenure", t * 12)
        report["tenure_conversion"] = "years_to_months"
    report["tenure_outliers"] = count
    return df


def charge_outliers(df: DataFrame, report: dict) -> DataFrame:
    """Q2: abs of negatives; clip to [max(0, Q1 - 3 IQR), Q3 + 3 IQR] only when
    the upper bound is over 100x the lower and fewer than 10% of rows fall
    outside. The charge columns are independent, so their counts and
    quartiles are taken together (one aggregate, one exact-quantile call,
    one aggregate)."""
    cols = [c for c in ("MonthlyCharges", "TotalCharges", "AnnualCharges") if c in df.columns]
    if not cols:
        return df
    r = df.agg(F.count(F.lit(1)).alias("n"),
               *[F.count_if(F.col(c) < 0).alias(f"neg{i}") for i, c in enumerate(cols)]).first()
    n = r["n"]
    counts = {c: r[f"neg{i}"] for i, c in enumerate(cols)}
    df = df.withColumns({c: F.when(F.col(c) < 0, F.abs(F.col(c))).otherwise(F.col(c)) for c in cols})
    qs = quantiles(df, {c: [0.25, 0.75] for c in cols})
    bounds = {}
    for c in cols:
        q1, q3 = qs[c]
        if q1 is None:
            continue
        iqr = q3 - q1
        lower, upper = max(0, q1 - 3 * iqr), q3 + 3 * iqr
        if upper > lower * 100:
            bounds[c] = (lower, upper)
    if bounds:
        ext = df.agg(*[F.count_if((F.col(c) > F.lit(hi)) | (F.col(c) < F.lit(lo))).alias(f"e{i}")
                       for i, (c, (lo, hi)) in enumerate(bounds.items())]).first()
        clip = {}
        for i, (c, (lo, hi)) in enumerate(bounds.items()):
            m = ext[f"e{i}"]
            if 0 < m < n * 0.1:
                counts[c] += m
                x = F.col(c)
                clip[c] = (F.when(x > F.lit(hi), F.lit(float(hi))).when(x < F.lit(lo), F.lit(float(lo)))
                           .otherwise(x))
        if clip:
            df = df.withColumns(clip)
    for c in cols:
        report[f"{c}_outliers"] = counts[c]
    return df
