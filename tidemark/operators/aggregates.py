"""Report tables (summaries, counts, bins, top-k).

All grouping is ``groupBy`` with partial aggregation; bin edges are a handful
of scalars computed by one distributed aggregate and broadcast as literals;
label tables joined back have at most a few rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.numeric import safe_float
from tidemark.operators.features import np_round, traffic_light
from tidemark.operators.rank import quantiles


def segment_summary(df: DataFrame) -> DataFrame:
    """A1 + A2: one row per segment, highest churn rate first."""
    out = df.groupBy("Segment").agg(
        F.count("Churn").alias("Customers"),
        F.sum("Churn").alias("Churned"),
        F.avg("Churn").alias("Churn_Rate"),
        F.avg("Predicted_CLV").alias("Avg_CLV"),
        F.sum("Predicted_CLV").alias("Total_CLV"),
        F.avg("tenure").alias("Avg_Tenure"),
        F.avg("MonthlyCharges").alias("Avg_Monthly"),
        F.avg("Churn_Prob").alias("Avg_Risk_Prob"),
    )
    return out.withColumn("Churn_Rate_Flag", traffic_light(F.col("Churn_Rate"))) \
              .orderBy(F.desc("Churn_Rate"), "Segment")


def core_kpis(df: DataFrame, lineage: str = "main") -> DataFrame:
    """A3 + A4: the core key figures as one row (one aggregate pass).

    Revenue at risk is monthly x 12 of high-risk customers; the first release
    summed their CLV, the second and third their total charges."""
    p = F.col("Churn_Prob")
    hr = p >= C.HIGH_RISK
    raw = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("Churn").alias("churn_mean"),
        F.avg("Predicted_CLV").alias("clv_mean"),
        F.avg("tenure").alias("tenure_mean"),
        F.avg("MonthlyCharges").alias("monthly_mean"),
        F.count_if(hr).alias("high_risk_n"),
        F.count_if((p >= C.MEDIUM_RISK) & (p < C.HIGH_RISK)).alias("med_risk_n"),
        F.count_if(p < C.MEDIUM_RISK).alias("low_risk_n"),
        F.sum("Predicted_CLV").alias("clv_sum"),
        F.sum(F.when(hr, F.col("Predicted_CLV") if lineage == "v1" else
                     F.col("TotalCharges") if lineage in ("v2", "v3") else
                     F.col("MonthlyCharges") * 12)).alias("rev_risk"),
        F.sum(F.when(hr, F.col("TotalCharges"))).alias("tc_risk"),
    )
    total = F.greatest(F.col("n"), F.lit(1))
    churn_rate = np_round(safe_float("churn_mean") * 100, 2)
    return raw.select(
        total.alias("total_customers"),
        churn_rate.alias("churn_rate"),
        np_round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - churn_rate)), 2).alias("retention_rate"),
        np_round(safe_float("clv_mean"), 0).alias("avg_clv"),
        np_round(safe_float("tenure_mean"), 1).alias("avg_tenure"),
        np_round(safe_float("monthly_mean"), 0).alias("avg_monthly"),
        F.col("high_risk_n"),
        np_round(F.col("high_risk_n") / total * 100, 1).alias("high_risk_pct"),
        F.col("med_risk_n"),
        F.col("low_risk_n"),
        np_round(safe_float("clv_sum"), 0).alias("total_clv"),
        np_round(safe_float("rev_risk"), 0).alias("revenue_at_risk"),
        np_round(safe_float("tc_risk"), 0).alias("tc_at_risk_hist"),
    )


def value_counts(df: DataFrame, col: str, name: str | None = None,
                 order: list[str] | None = None, percentage: bool = False,
                 keep_empty: bool = False) -> DataFrame:
    """``value_counts``; ``order`` sorts by a category list and
    ``keep_empty`` keeps zero-count categories (categorical columns)."""
    name = name or col
    counts = df.groupBy(F.col(col).alias(name)).agg(F.count(F.lit(1)).alias("Count"))
    if keep_empty and order:
        cats = df.sparkSession.createDataFrame([(c,) for c in order], f"`{name}` string")
        counts = cats.join(counts, name, "left").withColumn("Count", F.coalesce("Count", F.lit(0)))
    if percentage:
        total = float(df.count())
        counts = counts.withColumn("Percentage", np_round(F.col("Count") / F.lit(total) * 100, 1))
    if order:
        key = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(name))
        return counts.orderBy(key, F.desc("Count"))
    return counts.orderBy(F.desc("Count"), name)


# ---------------------------------------------------------------- bins

def _round_frac(x: float, precision: int) -> float:
    if not math.isfinite(x) or x == 0:
        return x
    frac, whole = math.modf(x)
    digits = (-int(math.floor(math.log10(abs(frac)))) - 1 + precision) if whole == 0 else precision
    return float(np.around(x, digits))


def interval_labels(edges: list[float], precision: int = 3) -> list[str]:
    """Display labels of right-closed intervals the way pandas prints them."""
    for p in range(precision, 20):
        levels = [_round_frac(b, p) for b in edges]
        if len(set(levels)) == len(edges):
            precision = p
            break
    br = [_round_frac(b, precision) for b in edges]
    return [f"({br[i]!r}, {br[i + 1]!r}]" for i in range(len(br) - 1)]


def equal_width_edges(mn: float, mx: float, k: int) -> list[float]:
    edges = np.linspace(mn, mx, k + 1, endpoint=True)
    edges[0] -= (mx - mn) * 0.001
    return [float(e) for e in edges]


def bin_index(c: Column, edges: list[float]) -> Column:
    """1-based right-closed bin of ``c`` for sorted ``edges`` (searchsorted left)."""
    expr = None
    for i, e in enumerate(edges[1:-1], start=1):
        expr = F.when(c <= F.lit(e), i) if expr is None else expr.when(c <= F.lit(e), i)
    last = len(edges) - 1
    return F.lit(last) if expr is None else expr.otherwise(last)


def safe_cut_stats(df: DataFrame, col: str) -> dict:
    v = F.col(col).cast("double")
    v = F.when(F.isnan(v), None).otherwise(v)
    r = df.agg(F.min(v).alias("mn"), F.max(v).alias("mx"), F.count(v).alias("cnt"),
               F.approx_count_distinct(v, 0.01).alias("nu_est")).first().asDict()
    # the bin count is min(6, distinct): only small distinct counts need to be exact
    if r["nu_est"] <= 64:
        r["nu"] = df.agg(F.count_distinct(v)).first()[0]
    else:
        r["nu"] = int(r["nu_est"])
    return r


def safe_cut(df: DataFrame, col: str, bins: int = C.SAFE_CUT_BINS,
             with_edges: bool = False) -> DataFrame:
    """Equal-width, right-closed bins (at most ``bins``, at most the number
    of distinct values), left edge widened by 0.1% of the range, empty bins
    dropped; a constant or empty column gives one ``All Values`` row."""
    spark = df.sparkSession
    st = safe_cut_stats(df, col)
    if st["cnt"] == 0 or st["nu"] < 2:
        n = df.where(F.col(col).isNotNull()).count()
        return spark.createDataFrame([(C.ALL_VALUES_LABEL, n, 0, None, None)],
                                     "Range string, Count long, bin int, bin_left double, bin_right double") \
            .select(*(["Range", "Count"] + (["bin", "bin_left", "bin_right"] if with_edges else [])))
    k = min(bins, st["nu"])
    edges = equal_width_edges(float(st["mn"]), float(st["mx"]), k)
    labels = interval_labels(edges)
    lab = spark.createDataFrame(
        [(i + 1, labels[i], edges[i], edges[i + 1]) for i in range(k)],
        "bin int, Range string, bin_left double, bin_right double")
    v = F.col(col).cast("double")
    counts = (df.where(v.isNotNull() & ~F.isnan(v))
              .groupBy(bin_index(v, edges).alias("bin")).agg(F.count(F.lit(1)).alias("Count")))
    out = F.broadcast(lab).join(counts, "bin", "inner").where(F.col("Count") > 0).orderBy("bin")
    cols = ["Range", "Count"] + (["bin", "bin_left", "bin_right"] if with_edges else [])
    return out.select(*cols)


def distributions(df: DataFrame, categories: dict[str, tuple], cuts: dict[str, str], bins: int = C.SAFE_CUT_BINS) -> dict[str, DataFrame]:
    """K4: all chart tables by one statistics pass and one counting pass.

    ``categories``: table -> (column, shown name, category order or None); ``cuts``: table -> column of ``safe_cut``.
    The counting pass stacks one (table, key) pair a table and groups once; a few dozen counts reach the driver.
    """
    spark = df.sparkSession
    value = {t: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for t, c in cuts.items()}
    aggs = []
    for i, v in enumerate(value.values()):
        aggs += [F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}"), F.approx_count_distinct(v, 0.01).alias(f"nu{i}")]
    stats = df.agg(*aggs).first() if aggs else None
    # the number of bins is min(bins, distinct): only small distinct counts need to be exact
    few = [i for i in range(len(cuts)) if stats[f"nu{i}"] <= 64]
    exact = df.agg(*[F.count_distinct(list(value.values())[i]).alias(f"nu{i}") for i in few]).first().asDict() if few else {}
    edges, keys = {}, []
    for i, (t, v) in enumerate(value.items()):
        distinct = exact.get(f"nu{i}", stats[f"nu{i}"])
        edges[t] = equal_width_edges(float(stats[f"mn{i}"]), float(stats[f"mx{i}"]), min(bins, distinct)) if distinct >= 2 else None
        key = F.lit(0) if edges[t] is None else bin_index(v, edges[t])
        present = F.col(cuts[t]).isNotNull() if edges[t] is None else v.isNotNull()
        keys.append(F.when(present, F.struct(F.lit(t).alias("table"), key.cast("string").alias("key"))))
    keys += [F.struct(F.lit(t).alias("table"), F.col(c).cast("string").alias("key")) for t, (c, _, _) in categories.items()]
    counted: dict[str, dict] = {t: {} for t in (*cuts, *categories)}
    for r in (df.select(F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())).alias("k")).select("k.*")
              .groupBy("table", "key").agg(F.count("*").alias("n")).collect()):
        counted[r.table][r.key] = r.n
    out = {}
    for t in cuts:
        if edges[t] is None:
            rows = [(C.ALL_VALUES_LABEL, counted[t].get("0", 0))]
        else:
            rows = [(label, counted[t][str(i)]) for i, label in enumerate(interval_labels(edges[t]), 1) if str(i) in counted[t]]
        out[t] = spark.createDataFrame(rows, "Range string, Count long")
    for t, (_, shown, order) in categories.items():
        rank = {c: i for i, c in enumerate(order or ())}
        rows = sorted(counted[t].items(), key=lambda x: (rank.get(x[0], -1), -x[1], x[0] or ""))
        out[t] = spark.createDataFrame(rows, f"`{shown}` string, Count long")
    return out


def fixed_bins(df: DataFrame, col: str, edges: list[float], labels: list[str],
               name: str, include_lowest: bool = True) -> DataFrame:
    """Fixed right-closed bins, zero-count bins kept, in bin order."""
    spark = df.sparkSession
    v = F.col(col).cast("double")
    expr = None
    for i in range(len(labels)):
        lo, hi = edges[i], edges[i + 1]
        cond = ((v >= lo) if (i == 0 and include_lowest) else (v > lo)) & (v <= hi)
        expr = F.when(cond, i + 1) if expr is None else expr.when(cond, i + 1)
    counts = df.groupBy(expr.alias("bin")).agg(F.count(F.lit(1)).alias("Count")).where(
        F.col("bin").isNotNull())
    lab = spark.createDataFrame([(i + 1, labels[i]) for i in range(len(labels))],
                                f"bin int, `{name}` string")
    return (F.broadcast(lab).join(counts, "bin", "left")
            .select(name, F.coalesce("Count", F.lit(0)).alias("Count"), "bin")
            .orderBy("bin").drop("bin"))


def qcut_counts(df: DataFrame, col: str, name: str, q: int = 5,
                labels: list[str] | None = None, on_duplicate: str = "vanish") -> DataFrame | None:
    """Quantile bins with labels; duplicate edges drop edges, which leaves
    too few bins for the labels: the table vanishes (``None``, adaptive v3.0)
    or collapses to one ``All`` row (``on_duplicate='all'``, v2.0)."""
    labels = labels or list(C.QUINTILE_LABELS)
    probs = [i / q for i in range(q + 1)]
    edges = quantiles(df, {col: probs})[col]
    if any(e is None for e in edges):
        return None
    uniq = sorted(set(edges))
    if len(uniq) - 1 != len(labels):
        if on_duplicate == "all":
            n = df.where(F.col(col).isNotNull()).count()
            return df.sparkSession.createDataFrame([("All", n)], f"`{name}` string, Count long")
        return None
    return fixed_bins(df, col, uniq, labels, name, include_lowest=True)


def adaptive_kpis(df: DataFrame) -> DataFrame:
    """A5: the adaptive summary figures (one aggregate plus an exact median)."""
    med = quantiles(df, {"Predicted_CLV": [0.5]})["Predicted_CLV"][0]
    hr = F.col("Churn_Prob") > C.ADAPTIVE_HIGH_RISK
    return df.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.avg("Predicted_CLV").alias("avg_clv"),
        F.lit(med).cast("double").alias("median_clv"),
        F.sum("Predicted_CLV").alias("total_portfolio"),
        F.avg("Churn").alias("churn_rate"),
        F.count_if(hr).alias("high_risk"),
        F.avg("tenure").alias("avg_tenure"),
        F.avg("MonthlyCharges").alias("avg_monthly"),
        F.sum("TotalCharges").alias("total_revenue"),
        F.coalesce(F.sum(F.when(hr, F.col("Predicted_CLV"))), F.lit(0.0)).alias("at_risk_revenue"),
    )


def tenure_group_counts(df: DataFrame, labels: list[str], name: str = "Tenure Group") -> DataFrame:
    """A10: ``TenureGroup`` is categorical, so every label of its set is
    counted, zero-count groups included."""
    return value_counts(df, "TenureGroup", name, order=labels, keep_empty=True)


def top_risk(df: DataFrame, id_col: str | None, n: int = C.TOP_RISK_ROWS,
             threshold: float = C.HIGH_RISK) -> DataFrame:
    """The high-risk action list, highest probability first.

    ``filter -> orderBy -> limit`` plans as ``TakeOrderedAndProject``: each
    task keeps its own top ``n`` and only those reach the final merge. Ties are
    broken by id so the list is deterministic.
    """
    base = ["tenure", "MonthlyCharges", "TotalCharges", "Predicted_CLV", "Churn_Prob",
            "Segment", "Risk_Tier"]
    cols = ([id_col] if id_col else []) + base
    order = [F.desc("Churn_Prob")] + ([F.asc(id_col)] if id_col else [F.asc("TotalCharges")])
    return (df.where(F.col("Churn_Prob") >= threshold).select(*cols)
            .orderBy(*order).limit(n)
            .withColumn("Prob_Flag", F.when(F.col("Churn_Prob") >= C.RED_ROW, "RED").otherwise("AMBER")))
