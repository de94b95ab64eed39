"""Per-row feature and score expressions.

Every function returns Column expressions or adds columns with
``withColumns``; scalars (medians, means, percentiles) come in as Python
floats that were computed once by a distributed aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config as C


def clip(c: Column, lower: float | None = None, upper: float | None = None) -> Column:
    """pandas ``clip``: nulls stay null."""
    out = c
    if lower is not None:
        out = F.when(out < F.lit(lower), F.lit(float(lower))).otherwise(out)
    if upper is not None:
        out = F.when(out > F.lit(upper), F.lit(float(upper))).otherwise(out)
    return out


def fill0(c: Column) -> Column:
    return F.coalesce(F.when(F.isnan(c), None).otherwise(c), F.lit(0.0))


# ---------------------------------------------------------------- core (main)

def core_features(df: DataFrame, lineage: str = "main") -> DataFrame:
    """F1-F4 of the core lineage (``v1`` keeps the first release's formulas)."""
    t, m, tot = F.col("tenure"), F.col("MonthlyCharges"), F.col("TotalCharges")
    avg = fill0(clip(tot / (t + 1), 0))
    df = df.withColumn("AvgMonthlySpend", avg)
    avg = F.col("AvgMonthlySpend")
    if lineage == "v1":
        return df.withColumns({
            "ValueScore": fill0(clip(m * F.log1p(t), 0)),
            "LoyaltyScore": fill0(clip(t / (m + 1), 0)),
            "SpendVariance": fill0(clip(F.abs(m - avg), 0)),
        })
    return df.withColumns({
        "ValueScore": fill0(clip(F.log1p(tot), 0)),
        "LoyaltyScore": fill0(clip(t * (tot / (m + 1)), 0)),
        "SpendVariance": fill0(clip(F.abs((m - avg) / (avg + 1)), 0)),
    })


def synthetic_variance() -> Column:
    """The spend-variance term used by the synthetic label."""
    t, m, tot = F.col("tenure"), F.col("MonthlyCharges"), F.col("TotalCharges")
    base = tot / (t + 1)
    return fill0(clip(F.abs((m - base) / (base + 1)), 0))


def repair_total(df: DataFrame) -> DataFrame:
    """A total below the monthly charge becomes tenure x monthly."""
    t, m, tot = F.col("tenure"), F.col("MonthlyCharges"), F.col("TotalCharges")
    fixed = F.when(tot < m, t * m).otherwise(tot)
    return df.withColumn("TotalCharges", clip(F.coalesce(fixed, t * m), 0))


def np_round(c: Column, digits: int) -> Column:
    """numpy/``Series.round``: ``rint(x * 10**d) / 10**d`` on the binary value.

    ``F.bround`` rounds the decimal text instead and disagrees at the many
    exact ties that rank fractions produce (0.28305 -> 0.2831 here).
    """
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def round_prob(c: Column, lo: float = 0.0, hi: float = 1.0, digits: int = 4) -> Column:
    """clip then round half-to-even (numpy)."""
    return np_round(clip(c, lo, hi), digits)


def core_clv(df: DataFrame) -> DataFrame:
    """retention-weighted historical value."""
    tc = fill0(clip(F.when(F.abs(F.col("TotalCharges")) == float("inf"), None)
                    .otherwise(F.col("TotalCharges")), 0))
    return df.withColumn("Predicted_CLV", clip(tc * (F.lit(1.0) - F.col("Churn_Prob")), 0))


def core_segment(clv_median: float | None) -> Column:
    """2x2 of prob >= 0.60 and CLV >= median (ties count as high)."""
    hi_risk = F.col("Churn_Prob") >= C.HIGH_RISK
    hi_clv = (F.col("Predicted_CLV") >= F.lit(clv_median)) if clv_median is not None else F.lit(False)
    s = C.SEGMENTS_CORE
    return (F.when(hi_risk & hi_clv, s[0]).when(hi_risk & ~hi_clv, s[1])
            .when(~hi_risk & hi_clv, s[2]).otherwise(s[3]))


def risk_tier(c: str = "Churn_Prob") -> Column:
    """right-closed bins [0, .30], (.30, .60], (.60, 1.001]."""
    p = F.col(c)
    e, lab = C.RISK_TIER_EDGES, C.RISK_TIERS
    return (F.when((p >= e[0]) & (p <= e[1]), lab[0])
            .when((p > e[1]) & (p <= e[2]), lab[1])
            .when((p > e[2]) & (p <= e[3]), lab[2])
            .otherwise(lab[0]))


def traffic_light(c: Column) -> Column:
    """A2: churn-rate colour."""
    return F.when(c > 0.6, "RED").when(c > 0.3, "AMBER").otherwise("GREEN")


# ------------------------------------------------------------------ adaptive

def tenure_labels(max_tenure: float) -> tuple[list, list]:
    """the (edges, labels) set chosen by the largest tenure."""
    for limit, edges, labels in C.TENURE_GROUPS:
        if limit is None or max_tenure <= limit:
            return edges, labels
    return C.TENURE_GROUPS[-1][1], C.TENURE_GROUPS[-1][2]


def tenure_group(max_tenure: float) -> Column:
    """label set chosen by the largest tenure; right-closed, lowest included."""
    edges, labels = tenure_labels(max_tenure)
    t = F.col("tenure")
    expr = F.when((t >= edges[0]) & (t <= edges[1]), labels[0])
    for i in range(1, len(edges) - 1):
        expr = expr.when((t > edges[i]) & (t <= edges[i + 1]), labels[i])
    return expr.when(t > edges[-1], labels[-1])


def adaptive_features(df: DataFrame, stats: dict) -> DataFrame:
    """F1 (v6), F7 and F5 given ``max_tenure`` and ``mean_monthly`` (one
    distributed aggregate)."""
    t, m, tot = F.col("tenure"), F.col("MonthlyCharges"), F.col("TotalCharges")
    df = df.withColumn("AvgMonthlySpend", clip(tot / F.greatest(t, F.lit(1.0)), 0))
    df = df.withColumn("TenureGroup", tenure_group(stats["max_tenure"]))
    mean_m = stats["mean_monthly"]
    df = df.withColumn("ChargeRatio", m / F.lit(mean_m) if mean_m and mean_m > 0 else F.lit(1.0))
    return df


def adaptive_consistency(df: DataFrame, p99_variance: float | None) -> DataFrame:
    if p99_variance is not None and p99_variance > 0:
        return df.withColumn("SpendingConsistency",
                             F.lit(1.0) - clip(F.col("SpendingVariance") / F.lit(p99_variance), 0, 1))
    return df.withColumn("SpendingConsistency", F.lit(1.0))


def adaptive_value_score(p99_total: float | None) -> Column:
    if p99_total is not None and p99_total > 0:
        return clip(F.col("TotalCharges") / F.lit(p99_total) * 100, 0, 100)
    return F.lit(50.0)


def adaptive_segment(prob_cut: float, clv_cut: float) -> Column:
    """F16: strict comparisons against p70 of prob and median CLV."""
    hr = F.col("Churn_Prob") > F.lit(prob_cut)
    hv = F.col("Predicted_CLV") > F.lit(clv_cut)
    s = C.SEGMENTS_ADAPTIVE
    return F.when(hr & hv, s[0]).when(hr, s[1]).when(hv, s[2]).otherwise(s[3])


def recommendation() -> Column:
    """action text by segment and prob > 0.8."""
    s, r = C.SEGMENTS_ADAPTIVE, C.RECOMMENDATIONS
    seg, p = F.col("Segment"), F.col("Churn_Prob")
    return (F.when((seg == s[0]) & (p > 0.8), r["hh_urgent"]).when(seg == s[0], r["hh"])
            .when((seg == s[1]) & (p > 0.8), r["hl_urgent"]).when(seg == s[1], r["hl"])
            .when(seg == s[2], r["lh"]).otherwise(r["ll"]))
