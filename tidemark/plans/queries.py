"""Registered queries: name -> (spark builder, DuckDB oracle SQL or None).

Every builder takes ``(spark, sf_dir)``, reads the driver tables (or frames
Spark derives from them) in full and returns a DataFrame. Doubles are
rounded to 6 decimals on both sides so float summation order cannot decide a
comparison.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tidemark import config as C
from tidemark.functions.numeric import adaptive_num, clean_num
from tidemark.operators import aggregates as A
from tidemark.operators.features import np_round
from tidemark.operators.rank import quantiles, with_pct_ranks
from tidemark.plans import oracle as O
from tidemark.plans.adaptive import run_adaptive
from tidemark.plans.core import run_core
from tidemark.session import bounded_batches, ensure_checkpoint_dir, removed_at_end
from tidemark.sources import fixtures as FXT
from tidemark.sources.files import read_table


def round_doubles(df: DataFrame, digits: int = 6, money: tuple = ()) -> DataFrame:
    """Binary (numpy-style) rounding of every double column; ``money``
    columns (large sums whose float summation order differs between engines)
    go to cents."""
    return df.select(*[
        np_round(F.col(f"`{f.name}`"), 2 if f.name in money else digits).alias(f.name)
        if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


_core_cache: dict = {}


def _session_key(spark: SparkSession) -> tuple:
    # a new SparkContext (even at a reused object address) never hits an old entry
    return (spark.sparkContext.applicationId, id(spark))


def core_result(spark: SparkSession, sf_dir: str, labelled: bool = True):
    """The core pipeline on the churn fixture (heuristic scorer), shared by the
    report queries of one session."""
    key = (_session_key(spark), sf_dir, labelled)
    if key not in _core_cache:
        raw = (FXT.churn_input if labelled else FXT.churn_unlabelled)(spark, sf_dir)
        _core_cache[key] = run_core(raw, model="heuristic")
    return _core_cache[key]


_adaptive_cache: dict = {}


def adaptive_result(spark: SparkSession, sf_dir: str):
    key = (_session_key(spark), sf_dir)
    if key not in _adaptive_cache:
        _adaptive_cache[key] = run_adaptive(FXT.adaptive_input(spark, sf_dir), model="heuristic", clv="heuristic")
    return _adaptive_cache[key]


ADAPTIVE_COLUMNS = ["customer_id", "tenure", "MonthlyCharges", "TotalCharges", "Churn", "AvgMonthlySpend",
                    "TenureGroup", "ChargeRatio", "SpendingConsistency", "ValueScore", "Churn_Prob",
                    "Predicted_CLV", "Future_CLV", "Segment", "Priority", "Recommendation"]


# ------------------------------------------------------------------ builders

def q_churn_input(spark, sf):
    return FXT.churn_input(spark, sf)


def q_core_processed(spark, sf):
    return round_doubles(core_result(spark, sf).processed())


def q_core_segment_summary(spark, sf):
    return round_doubles(A.segment_summary(core_result(spark, sf).df), money=("Total_CLV",))


def q_core_kpis(spark, sf):
    return round_doubles(A.core_kpis(core_result(spark, sf).df))


def q_core_segment_counts(spark, sf):
    return A.value_counts(core_result(spark, sf).df, "Segment")


def q_core_risk_tier_counts(spark, sf):
    return A.value_counts(core_result(spark, sf).df, "Risk_Tier", "Risk Tier", order=C.RISK_TIERS)


def q_core_top_risk(spark, sf):
    r = core_result(spark, sf)
    return round_doubles(A.top_risk(r.df, r.id_col))


def q_core_synthetic_labels(spark, sf):
    r = core_result(spark, sf, labelled=False)
    return round_doubles(r.df.select("customerID", "tenure", "MonthlyCharges", "TotalCharges",
                                     "Churn", "Churn_Prob", "Segment"))


def _bins(col):
    def build(spark, sf):
        return round_doubles(A.safe_cut(core_result(spark, sf).df, col, with_edges=True)
                             .select("bin", "bin_left", "bin_right", "Count"))
    return build


def q_lineitem_pct_rank(spark, sf):
    li = FXT.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                                 "l_extendedprice")
    out = with_pct_ranks(li, ["l_quantity", "l_extendedprice"], ["qty_pct", "price_pct"])
    return round_doubles(out.select("l_orderkey", "l_linenumber", "qty_pct", "price_pct"), 9)


def q_dirty_numbers(spark, sf):
    d = FXT.dirty_numbers(spark, sf)
    return d.select("c_custkey", "balance", clean_num(F.col("balance")).alias("core_value"),
                    adaptive_num(F.col("balance")).alias("adaptive_value"))


def q_adaptive_processed(spark, sf):
    return round_doubles(adaptive_result(spark, sf).df.select(*ADAPTIVE_COLUMNS))


def q_adaptive_segments(spark, sf):
    return A.value_counts(adaptive_result(spark, sf).df, "Segment", percentage=True)


def q_adaptive_churn_dist(spark, sf):
    return A.fixed_bins(adaptive_result(spark, sf).df, "Churn_Prob", C.PROB_BINS, C.PROB_BIN_LABELS,
                        "Risk Level")


def _qcut(col, name):
    def build(spark, sf):
        out = A.qcut_counts(adaptive_result(spark, sf).df, col, name)
        if out is None:
            return spark.createDataFrame([], f"`{name}` string, Count long")
        return out
    return build


def q_adaptive_tenure_dist(spark, sf):
    from tidemark.operators.features import tenure_labels
    df = adaptive_result(spark, sf).df
    _, labels = tenure_labels(df.agg(F.max("tenure")).first()[0])
    return A.tenure_group_counts(df, labels)


def q_adaptive_kpis(spark, sf):
    return round_doubles(A.adaptive_kpis(adaptive_result(spark, sf).df),
                         money=("total_portfolio", "total_revenue", "at_risk_revenue"))


def q_adaptive_quality(spark, sf):
    from tidemark.operators.quality import quality_frame
    return round_doubles(quality_frame(FXT.adaptive_input(spark, sf)))


_v2_cache: dict = {}


def v2_result(spark, sf):
    from tidemark.plans.adaptive_v2 import run_adaptive_v2
    key = (_session_key(spark), sf)
    if key not in _v2_cache:
        _v2_cache[key] = run_adaptive_v2(FXT.adaptive_input(spark, sf), model="heuristic", clv="heuristic")
    return _v2_cache[key]


V2_COLUMNS = ["customer_id", "tenure", "MonthlyCharges", "TotalCharges", "Churn", "AvgMonthlySpend",
              "TenureGroup", "ChargeRatio", "SpendingVariance", "ValueScore", "Churn_Prob",
              "Predicted_CLV", "Segment", "Priority"]


def q_v2_processed(spark, sf):
    return round_doubles(v2_result(spark, sf).df.select(*V2_COLUMNS))


def q_v2_churn_dist(spark, sf):
    """A8 (2.0): fixed bins without the lowest edge."""
    return A.fixed_bins(v2_result(spark, sf).df, "Churn_Prob", C.PROB_BINS, C.PROB_BIN_LABELS,
                        "Risk Level", include_lowest=False)


def q_v2_clv_dist(spark, sf):
    """A9 (2.0): duplicate quintile edges collapse the table to one ``All`` row."""
    return A.qcut_counts(v2_result(spark, sf).df, "Predicted_CLV", "CLV Tier", on_duplicate="all")


def q_v2_spend_dist(spark, sf):
    return A.qcut_counts(v2_result(spark, sf).df, "AvgMonthlySpend", "Spend Tier", on_duplicate="all")


def q_v2_kpis(spark, sf):
    df = v2_result(spark, sf).df
    med = quantiles(df, {"Predicted_CLV": [0.5]})["Predicted_CLV"][0]
    out = df.agg(F.count(F.lit(1)).alias("total_customers"), F.avg("Predicted_CLV").alias("avg_clv"),
                 F.lit(med).cast("double").alias("median_clv"), F.sum("Predicted_CLV").alias("total_clv"),
                 F.avg("Churn").alias("churn_rate"), F.avg("tenure").alias("avg_tenure"),
                 F.avg("MonthlyCharges").alias("avg_monthly"),
                 F.count_if(F.col("Churn_Prob") > C.ADAPTIVE_HIGH_RISK).alias("high_risk"),
                 F.count_if(F.col("Predicted_CLV") > F.lit(med)).alias("high_value"))
    return round_doubles(out, money=("total_clv",))


_events_cache: dict = {}

EVENTS_COLUMNS = ["user_id", "tenure", "MonthlyCharges", "TotalCharges", "Churn", "AvgMonthlySpend",
                  "TenureGroup", "ChargeRatio", "SpendingConsistency", "ValueScore", "Churn_Prob",
                  "Predicted_CLV", "Future_CLV", "Segment", "Priority", "Recommendation"]


def q_events_adaptive(spark, sf):
    """E3 on a per-user file from ``events``: tenure inferred from values (D4),
    inverted ``Active`` churn (D9), isolation flag in the pipeline (M11)."""
    key = (_session_key(spark), sf)
    if key not in _events_cache:
        _events_cache[key] = run_adaptive(FXT.events_input(spark, sf), model="heuristic", clv="heuristic")
    return round_doubles(_events_cache[key].df.select(*EVENTS_COLUMNS))


def q_core_v1_processed(spark, sf):
    """The first release's formulas (F1-F4 v1, no total repair, OLS value F14)."""
    r = run_core(FXT.churn_input(spark, sf), model="heuristic", lineage="v1")
    return round_doubles(r.processed(), money=("Predicted_CLV",))


def q_core_ml_checks(spark, sf):
    """M2, M3, M9: rows and positives, exact stratified split, area under the curve against the evaluator's."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from tidemark.operators import ml

    data = core_result(spark, sf).df.select("customerID", *C.CORE_FEATURES, F.col("Churn").cast("double").alias("Churn"))
    train, test = ml.hash_split(data, 0.2)
    train, test = ml.assembled(train, C.CORE_FEATURES), ml.assembled(test, C.CORE_FEATURES)
    fitted = LogisticRegression(labelCol="Churn", maxIter=20).fit(train)
    _, area = ml.candidate_metrics(test, {"LR": fitted})["LR"]
    want = BinaryClassificationEvaluator(labelCol="Churn", numBins=0).evaluate(fitted.transform(test))
    sizes = test.agg(F.count("*").alias("n_test"), F.sum("Churn").cast("long").alias("n_test_churned"))
    return data.agg(F.count("*").alias("n"), F.sum("Churn").cast("long").alias("n_churned")).crossJoin(F.broadcast(sizes)).withColumn(
        "same_area", F.lit(abs(area - want) < 1e-9))


def q_core_ml_scores(spark, sf):
    """M1-M10 (core): random forest, then boosting; no SQL oracle (trees)."""
    r = run_core(FXT.churn_input(spark, sf), model="auto")
    return round_doubles(r.processed())


def q_adaptive_ml_scores(spark, sf):
    """M1-M10 (adaptive): best of RF/GBT/LR on robust-scaled features."""
    r = run_adaptive(FXT.adaptive_input(spark, sf), model="auto", clv="heuristic")
    return round_doubles(r.df.select("customer_id", "Churn", "Churn_Prob", "Segment", "Priority"))


def q_adaptive_ridge_clv(spark, sf):
    """exact ridge CLV (normal equations from one aggregate)."""
    r = run_adaptive(FXT.adaptive_input(spark, sf), model="heuristic", clv="ridge")
    return round_doubles(r.df.select("customer_id", "Churn_Prob", "Predicted_CLV", "Future_CLV", "Segment"))


def q_isolation_outliers(spark, sf):
    """Isolation-forest flags on per-customer numeric features."""
    from tidemark.operators.isolation import isolation_scores
    h = FXT.customer_history(spark, sf).select(
        "c_custkey", "c_acctbal", F.col("n_orders").cast("double").alias("n_orders"),
        (F.col("cents") / 100).alias("spend"), F.col("tenure_m").cast("double").alias("tenure_m"))
    s = isolation_scores(h, ["c_acctbal", "n_orders", "spend", "tenure_m"])
    return round_doubles(s.select("c_custkey", "__iso_score").withColumnRenamed("__iso_score", "iso_score"))


# ------------------------------------------------------------------- oracles

def _core_select(cols: str, tail: str = "") -> str:
    return O.core_final() + f"\nSELECT {cols} FROM final {tail}"


_D = ["AvgMonthlySpend", "ValueScore", "LoyaltyScore", "SpendVariance", "Predicted_CLV",
      "tenure", "MonthlyCharges", "TotalCharges", "Churn_Prob"]


def _r(cols):
    return ", ".join(O.r6(c) if c in _D else c for c in cols)


SQL_CORE_PROCESSED = _core_select(_r(["customerID"] + C.PROCESSED_COLUMNS))

SQL_CORE_V1 = "WITH" + O.churn_input_cte() + O.core_ctes(first_release=True) + "\nSELECT " + ", ".join(
    ["customerID"] + [f"{O.np_round_sql(c, 2)} AS {c}" if c == "Predicted_CLV" else c if c in ("Churn", "Segment", "Risk_Tier") else O.r6(c)
                      for c in C.PROCESSED_COLUMNS]) + " FROM final"

SQL_ML_CHECKS = O.core_final() + """
, c AS (SELECT count(*) AS n, CAST(sum(Churn) AS BIGINT) AS n_churned FROM final)
SELECT n, n_churned, CAST(round_even(n_churned * 0.2, 0) + round_even((n - n_churned) * 0.2, 0) AS BIGINT) AS n_test,
       CAST(round_even(n_churned * 0.2, 0) AS BIGINT) AS n_test_churned, TRUE AS same_area FROM c"""

SQL_SEGMENT_SUMMARY = O.core_final() + f"""
, s AS (
  SELECT Segment, count(Churn) AS Customers, CAST(sum(Churn) AS BIGINT) AS Churned, avg(Churn) AS Churn_Rate,
         avg(Predicted_CLV) AS Avg_CLV, sum(Predicted_CLV) AS Total_CLV, avg(tenure) AS Avg_Tenure,
         avg(MonthlyCharges) AS Avg_Monthly, avg(Churn_Prob) AS Avg_Risk_Prob
  FROM final GROUP BY Segment)
SELECT Segment, Customers, Churned, round_even((Churn_Rate) * 1000000.0, 0) / 1000000.0 AS Churn_Rate, round_even((Avg_CLV) * 1000000.0, 0) / 1000000.0 AS Avg_CLV,
       {O.np_round_sql("Total_CLV", 2)} AS Total_CLV, round_even((Avg_Tenure) * 1000000.0, 0) / 1000000.0 AS Avg_Tenure,
       round_even((Avg_Monthly) * 1000000.0, 0) / 1000000.0 AS Avg_Monthly, round_even((Avg_Risk_Prob) * 1000000.0, 0) / 1000000.0 AS Avg_Risk_Prob,
       CASE WHEN Churn_Rate > 0.6 THEN 'RED' WHEN Churn_Rate > 0.3 THEN 'AMBER' ELSE 'GREEN' END AS Churn_Rate_Flag
FROM s ORDER BY Churn_Rate DESC, Segment"""

SQL_KPIS = O.core_final() + f"""
, k AS (
  SELECT count(*) AS n, avg(Churn) AS churn_mean, avg(Predicted_CLV) AS clv_mean, avg(tenure) AS tenure_mean,
         avg(MonthlyCharges) AS monthly_mean,
         count(*) FILTER (WHERE Churn_Prob >= 0.6) AS high_risk_n,
         count(*) FILTER (WHERE Churn_Prob >= 0.3 AND Churn_Prob < 0.6) AS med_risk_n,
         count(*) FILTER (WHERE Churn_Prob < 0.3) AS low_risk_n,
         sum(Predicted_CLV) AS clv_sum,
         sum(CASE WHEN Churn_Prob >= 0.6 THEN MonthlyCharges * 12 END) AS rev_risk,
         sum(CASE WHEN Churn_Prob >= 0.6 THEN TotalCharges END) AS tc_risk
  FROM final)
SELECT greatest(n, 1) AS total_customers,
       round_even(({O.np_round_sql("coalesce(churn_mean, 0) * 100", 2)}) * 1000000.0, 0) / 1000000.0 AS churn_rate,
       {O.np_round_sql(O.np_round_sql("greatest(0.0, least(100.0, 100.0 - " + O.np_round_sql("coalesce(churn_mean, 0) * 100", 2) + "))", 2), 6)} AS retention_rate,
       round_even(({O.np_round_sql("coalesce(clv_mean, 0)", 0)}) * 1000000.0, 0) / 1000000.0 AS avg_clv,
       round_even(({O.np_round_sql("coalesce(tenure_mean, 0)", 1)}) * 1000000.0, 0) / 1000000.0 AS avg_tenure,
       round_even(({O.np_round_sql("coalesce(monthly_mean, 0)", 0)}) * 1000000.0, 0) / 1000000.0 AS avg_monthly,
       high_risk_n,
       round_even(({O.np_round_sql("high_risk_n / greatest(n, 1) * 100", 1)}) * 1000000.0, 0) / 1000000.0 AS high_risk_pct,
       med_risk_n, low_risk_n,
       round_even(({O.np_round_sql("coalesce(clv_sum, 0)", 0)}) * 1000000.0, 0) / 1000000.0 AS total_clv,
       round_even(({O.np_round_sql("coalesce(rev_risk, 0)", 0)}) * 1000000.0, 0) / 1000000.0 AS revenue_at_risk,
       round_even(({O.np_round_sql("coalesce(tc_risk, 0)", 0)}) * 1000000.0, 0) / 1000000.0 AS tc_at_risk_hist
FROM k"""

SQL_SEGMENT_COUNTS = _core_select("Segment, count(*) AS Count", "GROUP BY Segment ORDER BY Count DESC, Segment")
SQL_RISK_TIER_COUNTS = _core_select('Risk_Tier AS "Risk Tier", count(*) AS Count', "GROUP BY Risk_Tier")

SQL_TOP_RISK = _core_select(
    _r(["customerID", "tenure", "MonthlyCharges", "TotalCharges", "Predicted_CLV", "Churn_Prob",
        "Segment", "Risk_Tier"]) + ", CASE WHEN Churn_Prob >= 0.8 THEN 'RED' ELSE 'AMBER' END AS Prob_Flag",
    f"WHERE Churn_Prob >= 0.6 ORDER BY Churn_Prob DESC, customerID LIMIT {C.TOP_RISK_ROWS}")

SQL_SYNTHETIC = ("WITH" + O.churn_input_cte(with_churn=False) + O.core_ctes(labelled=False)
                 + "\nSELECT " + _r(["customerID", "tenure", "MonthlyCharges", "TotalCharges", "Churn",
                                     "Churn_Prob", "Segment"]) + " FROM final")


def sql_bins(col: str) -> str:
    """A7 equal-width bins: k = min(6, distinct), numpy linspace edges."""
    edge = "(({i} * ((mx - mn) / k)) + mn)"
    bin_expr = " + ".join(
        f"CASE WHEN {i} < k AND v > {edge.format(i=i)} THEN 1 ELSE 0 END" for i in range(1, 6))
    return O.core_final() + f"""
, vals AS (SELECT CAST({col} AS DOUBLE) AS v FROM final WHERE {col} IS NOT NULL AND NOT isnan({col})),
st AS (SELECT min(v) AS mn, max(v) AS mx, least(6, count(DISTINCT v)) AS k FROM vals),
b AS (SELECT 1 + {bin_expr} AS bin, mn, mx, k FROM vals, st),
c AS (SELECT bin, any_value(mn) AS mn, any_value(mx) AS mx, any_value(k) AS k, count(*) AS Count FROM b GROUP BY bin)
SELECT CAST(bin AS INTEGER) AS bin,
       {O.np_round_sql("CASE WHEN bin = 1 THEN mn - (mx - mn) * 0.001 ELSE ((bin - 1) * ((mx - mn) / k)) + mn END", 6)} AS bin_left,
       {O.np_round_sql("CASE WHEN bin = k THEN mx ELSE (bin * ((mx - mn) / k)) + mn END", 6)} AS bin_right,
       Count
FROM c WHERE Count > 0 ORDER BY bin"""


SQL_LINEITEM_PCT = f"""
SELECT l_orderkey, l_linenumber, {O.np_round_sql(O.pct_rank_sql('l_quantity'), 9)} AS qty_pct,
       {O.np_round_sql(O.pct_rank_sql('l_extendedprice'), 9)} AS price_pct
FROM lineitem"""


def _dirty_sql() -> str:
    cents = "abs(CAST(round(c_acctbal * 100) AS BIGINT))"
    ip = f"({cents} // 100)"
    frac = f"lpad(CAST({cents} % 100 AS VARCHAR), 2, '0')"
    sign = "(CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END)"

    def grouped(sep):
        return (f"(CASE WHEN {ip} >= 1000 THEN CAST({ip} // 1000 AS VARCHAR) || '{sep}' || "
                f"lpad(CAST({ip} % 1000 AS VARCHAR), 3, '0') ELSE CAST({ip} AS VARCHAR) END)")
    text = (f"CASE c_custkey % 5 WHEN 0 THEN {sign} || CAST({ip} AS VARCHAR) || '.' || {frac} "
            f"WHEN 1 THEN {sign} || '$' || {grouped(',')} || '.' || {frac} "
            f"WHEN 2 THEN {sign} || {grouped('.')} || ',' || {frac} "
            f"WHEN 3 THEN '₹ ' || {sign} || {grouped(',')} || '.' || {frac} ELSE 'N/A' END")
    return (f"WITH d AS (SELECT c_custkey, {text} AS balance FROM customer)\n"
            f"SELECT c_custkey, balance, {O.clean_num_sql('balance')} AS core_value, "
            f"{O.adaptive_num_sql('balance')} AS adaptive_value FROM d")


SQL_ADAPTIVE = O.adaptive_final() + "\nSELECT " + ", ".join(
    O.r6(c) if c in ("tenure", "MonthlyCharges", "TotalCharges", "AvgMonthlySpend", "ChargeRatio",
                     "SpendingConsistency", "ValueScore", "Churn_Prob", "Predicted_CLV", "Future_CLV",
                     "Priority") else c
    for c in ADAPTIVE_COLUMNS) + " FROM final"

SQL_ADAPTIVE_SEGMENTS = O.adaptive_final() + f"""
, c AS (SELECT Segment, count(*) AS Count FROM final GROUP BY Segment)
SELECT Segment, Count, {O.np_round_sql("Count / (SELECT sum(Count) FROM c) * 100", 1)} AS Percentage FROM c"""

SQL_ADAPTIVE_CHURN_DIST = O.adaptive_final() + f"""
, labs AS (SELECT * FROM (VALUES {", ".join(f"({i + 1}, '{lab}')" for i, lab in enumerate(C.PROB_BIN_LABELS))}) t(bin, lab)),
b AS (SELECT CASE {" ".join(f"WHEN Churn_Prob {'>=' if i == 0 else '>'} {C.PROB_BINS[i]} AND Churn_Prob <= {C.PROB_BINS[i + 1]} THEN {i + 1}" for i in range(5))} END AS bin FROM final)
SELECT lab AS "Risk Level", count(b.bin) AS Count FROM labs LEFT JOIN b ON labs.bin = b.bin GROUP BY labs.bin, lab"""


def sql_qcut(col: str, name: str) -> str:
    labs = C.QUINTILE_LABELS
    qs = ", ".join(f"quantile_cont({col}, {i / 5}) AS e{i}" for i in range(6))
    case = " ".join(
        f"WHEN {col} {'>=' if i == 0 else '>'} e{i} AND {col} <= e{i + 1} THEN {i + 1}" for i in range(5))
    return O.adaptive_final() + f"""
, e AS (SELECT {qs} FROM final),
ok AS (SELECT * FROM e WHERE e0 < e1 AND e1 < e2 AND e2 < e3 AND e3 < e4 AND e4 < e5),
labs AS (SELECT * FROM (VALUES {", ".join(f"({i + 1}, '{lab}')" for i, lab in enumerate(labs))}) t(bin, lab)),
b AS (SELECT CASE {case} END AS bin FROM final, ok)
SELECT lab AS "{name}", count(b.bin) AS Count FROM labs LEFT JOIN b ON labs.bin = b.bin, ok
GROUP BY labs.bin, lab"""


def _sql_adaptive_tenure() -> str:
    sets = []
    for limit, _, labels in C.TENURE_GROUPS:
        vals = ", ".join(f"('{lab}')" for lab in labels)
        cond = "TRUE" if limit is None else f"mxt <= {limit}"
        sets.append((cond, vals))
    union = " UNION ALL ".join(
        f"SELECT lab FROM (VALUES {vals}) t(lab), (SELECT max(tenure) AS mxt FROM final) m "
        f"WHERE {cond}" + ("" if i == 0 else " AND NOT (" + " OR ".join(c for c, _ in sets[:i]) + ")")
        for i, (cond, vals) in enumerate(sets))
    return O.adaptive_final() + f"""
, labs AS ({union}),
c AS (SELECT TenureGroup, count(*) AS n FROM final GROUP BY TenureGroup)
SELECT lab AS "Tenure Group", coalesce(n, 0) AS Count FROM labs LEFT JOIN c ON labs.lab = c.TenureGroup"""


SQL_ADAPTIVE_TENURE = _sql_adaptive_tenure()

SQL_ADAPTIVE_KPIS = O.adaptive_final() + f"""
SELECT count(*) AS total_customers, round_even((avg(Predicted_CLV)) * 1000000.0, 0) / 1000000.0 AS avg_clv,
       round_even((quantile_cont(Predicted_CLV, 0.5)) * 1000000.0, 0) / 1000000.0 AS median_clv, {O.np_round_sql("sum(Predicted_CLV)", 2)} AS total_portfolio,
       round_even((avg(Churn)) * 1000000.0, 0) / 1000000.0 AS churn_rate, count(*) FILTER (WHERE Churn_Prob > 0.7) AS high_risk,
       round_even((avg(tenure)) * 1000000.0, 0) / 1000000.0 AS avg_tenure, round_even((avg(MonthlyCharges)) * 1000000.0, 0) / 1000000.0 AS avg_monthly,
       {O.np_round_sql("sum(TotalCharges)", 2)} AS total_revenue,
       {O.np_round_sql("coalesce(sum(Predicted_CLV) FILTER (WHERE Churn_Prob > 0.7), 0)", 2)} AS at_risk_revenue
FROM final"""


def sql_quality() -> str:
    """Q3-Q8 on the adaptive fixture; names and values are judged by the SQL."""
    cols = ["customer_id", "account_length", "mrr", "total_spend", "customer_status", "plan", "balance"]
    words = ", ".join(f"({i}, '{d}', '{w}')" for i, (d, ws) in enumerate(C.DOMAIN_PATTERNS.items()) for w in ws)
    roles = ", ".join(f"({p}, '{w}')" for p, ws in enumerate((C.RELEVANCE_VALUE, C.RELEVANCE_ID, C.RELEVANCE_TIME, C.RELEVANCE_CHURN)) for w in ws)
    nulls = " + ".join(f"count(*) - count({c})" for c in cols)
    pot = " + ".join(
        f"CASE WHEN count(TRY_CAST(regexp_replace({c}, '[$,€£%]', '', 'g') AS DOUBLE)) > count(*) * 0.3 THEN 1 ELSE 0 END"
        for c in cols)
    empty = " + ".join(f"CASE WHEN count({c}) = 0 THEN 1 ELSE 0 END" for c in cols)
    return "WITH" + O.adaptive_input_cte() + f""",
names AS (SELECT '{" ".join(cols)}' AS text),
hits AS (SELECT no, domain, count(*) FILTER (WHERE contains(text, word)) AS n FROM (VALUES {words}) v(no, domain, word), names GROUP BY no, domain),
dom AS (SELECT CASE WHEN n = 0 THEN 'unknown' ELSE domain END AS domain, CASE WHEN n >= 3 THEN 0 WHEN n >= 1 THEN 15 ELSE 20 END AS dom_pen,
               CAST(n < 3 AS INTEGER) + CAST(n > 0 AND domain IN ('hr_payroll', 'sales') AS INTEGER) AS dom_issue FROM hits ORDER BY n DESC, no LIMIT 1),
found AS (SELECT role, bool_or(contains(text, word)) AS yes FROM (VALUES {roles}) v(role, word), names GROUP BY role),
rel AS (SELECT CAST(count(*) FILTER (WHERE NOT yes AND role = 0) * 10 AS INTEGER) AS rel_pen, count(*) FILTER (WHERE NOT yes) AS rel_issues FROM found),
a AS (SELECT count(*) AS n, ({nulls}) AS nulls, ({pot}) AS pot, ({empty}) AS empty_cols FROM adaptive_input),
d AS (SELECT count(*) AS nd FROM (SELECT DISTINCT * FROM adaptive_input)),
m AS (SELECT n, pot, empty_cols, nulls / (n * {len(cols)}.0) * 100 AS missing_pct,
             (n - nd) / n * 100.0 AS dup_pct, domain, dom_pen, dom_issue, rel_pen, rel_issues FROM a, d, dom, rel),
s AS (
  SELECT *,
    (CASE WHEN pot = 0 THEN 30 ELSE 0 END) + dom_pen
    + (CASE WHEN missing_pct > 50 THEN 40 WHEN missing_pct > 20 THEN 20 WHEN missing_pct > 5 THEN 5 ELSE 0 END)
    + (CASE WHEN dup_pct > 30 THEN 15 WHEN dup_pct > 10 THEN 5 ELSE 0 END)
    + (CASE WHEN empty_cols > 0 THEN 10 ELSE 0 END) + rel_pen AS pen,
    (CASE WHEN pot = 0 THEN 1 ELSE 0 END) + dom_issue + (CASE WHEN missing_pct > 5 THEN 1 ELSE 0 END)
    + (CASE WHEN dup_pct > 10 THEN 1 ELSE 0 END) + (CASE WHEN empty_cols > 0 THEN 1 ELSE 0 END)
    + rel_issues AS iss
  FROM m)
SELECT CAST(n AS BIGINT) AS n_rows, {len(cols)} AS n_cols,
       {O.np_round_sql("missing_pct", 6)} AS missing_pct, {O.np_round_sql("dup_pct", 6)} AS dup_pct,
       CAST(pot AS INTEGER) AS potentially_numeric,
       CAST(greatest(0, least(100, 100 - pen)) AS INTEGER) AS quality_score, domain,
       (greatest(0, least(100, 100 - pen)) >= 30 AND n >= {C.ADAPTIVE_MIN_ROWS}) AS is_valid,
       CAST(iss + CASE WHEN greatest(0, least(100, 100 - pen)) < 30 THEN 1 ELSE 0 END AS INTEGER) AS n_issues
FROM s"""


SQL_V2 = O.v2_final() + "\nSELECT " + ", ".join(
    O.r6(c) if c in ("tenure", "MonthlyCharges", "TotalCharges", "AvgMonthlySpend", "ChargeRatio",
                     "SpendingVariance", "ValueScore", "Churn_Prob", "Predicted_CLV", "Priority") else c
    for c in V2_COLUMNS) + " FROM final"

SQL_V2_CHURN_DIST = O.v2_final() + f"""
, labs AS (SELECT * FROM (VALUES {", ".join(f"({i + 1}, '{lab}')" for i, lab in enumerate(C.PROB_BIN_LABELS))}) t(bin, lab)),
b AS (SELECT CASE {" ".join(f"WHEN Churn_Prob > {C.PROB_BINS[i]} AND Churn_Prob <= {C.PROB_BINS[i + 1]} THEN {i + 1}" for i in range(5))} END AS bin FROM final)
SELECT lab AS "Risk Level", count(b.bin) AS Count FROM labs LEFT JOIN b ON labs.bin = b.bin GROUP BY labs.bin, lab"""


def sql_v2_qcut(col: str, name: str) -> str:
    labs = C.QUINTILE_LABELS
    qs = ", ".join(f"quantile_cont({col}, {i / 5}) AS e{i}" for i in range(6))
    case = " ".join(
        f"WHEN {col} {'>=' if i == 0 else '>'} e{i} AND {col} <= e{i + 1} THEN {i + 1}" for i in range(5))
    ok = "e0 < e1 AND e1 < e2 AND e2 < e3 AND e3 < e4 AND e4 < e5"
    return O.v2_final() + f"""
, e AS (SELECT {qs} FROM final),
labs AS (SELECT * FROM (VALUES {", ".join(f"({i + 1}, '{lab}')" for i, lab in enumerate(labs))}) t(bin, lab)),
b AS (SELECT CASE {case} END AS bin FROM final, e WHERE {ok}),
binned AS (SELECT lab AS "{name}", count(b.bin) AS Count FROM labs LEFT JOIN b ON labs.bin = b.bin, e
           WHERE {ok} GROUP BY labs.bin, lab),
collapsed AS (SELECT 'All' AS "{name}", count({col}) AS Count FROM final, e WHERE NOT ({ok}) GROUP BY ALL HAVING count(*) > 0)
SELECT * FROM binned UNION ALL SELECT * FROM collapsed"""


SQL_V2_KPIS = O.v2_final() + f"""
, m AS (SELECT quantile_cont(Predicted_CLV, 0.5) AS med FROM final)
SELECT count(*) AS total_customers, {O.np_round_sql("avg(Predicted_CLV)", 6)} AS avg_clv,
       {O.np_round_sql("any_value(med)", 6)} AS median_clv, {O.np_round_sql("sum(Predicted_CLV)", 2)} AS total_clv,
       {O.np_round_sql("avg(Churn)", 6)} AS churn_rate, {O.np_round_sql("avg(tenure)", 6)} AS avg_tenure,
       {O.np_round_sql("avg(MonthlyCharges)", 6)} AS avg_monthly,
       count(*) FILTER (WHERE Churn_Prob > 0.7) AS high_risk,
       count(*) FILTER (WHERE Predicted_CLV > med) AS high_value
FROM final, m"""


def sql_events_adaptive() -> str:
    cands = ["tenure_days", "event_count", "error_count", "active_hours"]
    nums = ["tenure_days", "MonthlyCharges", "TotalCharges", "event_count", "error_count", "active_hours"]
    typed_cols = {"tenure_days": "days_as_customer", "MonthlyCharges": "monthly_spend",
                  "TotalCharges": "lifetime_value", "event_count": "event_count",
                  "error_count": "error_count", "active_hours": "active_hours"}
    source = O.events_input_cte() + ",\ntyped0 AS (SELECT user_id, is_active AS Active, " + ", ".join(
        f"{O.adaptive_num_sql(v)} AS {k}" for k, v in typed_cols.items()) + " FROM events_input)," + \
        O.tenure_inference_sql("typed0", cands).lstrip("\n")
    pick = "CASE best " + " ".join(f"WHEN '{c}' THEN {c}" for c in cands) + " END"
    typed = f"SELECT typed0.*, {pick} AS tenure FROM typed0, d4"
    churn = (f"(CASE WHEN lower(trim(coalesce(CAST(Active AS VARCHAR), 'nan'))) IN "
             f"({O._list(C.ACTIVE_TRUE_TOKENS)}) THEN 0 ELSE 1 END)")
    return O.adaptive_final(source=source, typed=typed, churn=churn, id_col="user_id",
                            passthrough=("Active",) + tuple(c for c in nums if c not in
                                                           ("MonthlyCharges", "TotalCharges"))) + \
        "\nSELECT " + ", ".join(
            O.r6(c) if c not in ("user_id", "Churn", "TenureGroup", "Segment", "Recommendation") else c
            for c in EVENTS_COLUMNS) + " FROM final"


def _written(spark: SparkSession, df: DataFrame, kind: str, ending: str | None = None, **options) -> str:
    """``df`` written in the shared folder in the given format; its path."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/source-{uuid.uuid4().hex}.{ending or kind}"
    df.write.format(kind).options(**options).save(path)
    removed_at_end(spark, path)
    return path


def q_src_csv_quotes(spark, sf):
    """Quoted separators, doubled quotes and line feeds survive a CSV round trip."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    path = _written(spark, docs, "csv", header=True, quoteAll=True, escape='"')
    return read_table(spark, path, lineage="core")


def _with_header(batches):
    """The lines of one file: a header, then the rows."""
    import pyarrow as pa

    yield pa.record_batch([pa.array(["key,customer,status"])], names=["value"])
    yield from batches


def q_src_csv_overlong(spark, sf):
    """Rows with surplus fields go, also empty ones; short rows are padded; NA texts are null."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    k = F.col("o_orderkey").cast("string")
    line = F.concat_ws(",", k, F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 7 == 1, "NA").otherwise(F.col("o_orderstatus")))
    line = (F.when(F.col("o_orderkey") % 5 == 0, F.concat(line, F.lit(",")))
            .when(F.col("o_orderkey") % 5 == 1, F.concat(k, F.lit(","), F.col("o_custkey").cast("string"))).otherwise(line))
    text = o.select(line.alias("value"))
    whole = text.mapInArrow(_with_header, "value string")
    return read_table(spark, _written(spark, whole, "text"), lineage="core")


def q_src_json_lines(spark, sf):
    """One object a line, of any length."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    return read_table(spark, _written(spark, docs, "json")).select("doc_id", "text", "lang")


def _as_list(batches):
    """One file's objects as a JSON list, an element's text broken over two lines."""
    import pyarrow as pa

    lead = "["
    for batch in batches:
        rows = batch.column(0).to_pylist()
        yield pa.record_batch([pa.array([f"{lead if i == 0 else ','}{r[:-1]}\n }}" for i, r in enumerate(rows)], pa.string())], names=["value"])
        lead = "," if rows else lead
    yield pa.record_batch([pa.array(["]" if lead == "," else "[]"])], names=["value"])


def q_src_json_records(spark, sf):
    """A list of objects per file, cut at its elements in parallel."""
    bounded_batches(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    lists = docs.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(_as_list, "value string")
    return read_table(spark, _written(spark, lists, "text", "json")).select("doc_id", "text", "lang")


def q_src_encoding_late(spark, sf):
    """The only bytes that are no UTF-8 stand far down in a Latin-1 file."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    late = F.col("o_orderkey") % 9973 == 9972
    d = o.select(F.col("o_orderkey").cast("string").alias("order key"), F.when(late, "déjà vu").otherwise(F.col("o_orderstatus")).alias("status"))
    return read_table(spark, _written(spark, d, "csv", header=True, encoding="ISO-8859-1"), lineage="core")


def q_src_parquet_text(spark, sf):
    """Every column as text, doubles in plain notation."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * 1000).alias("price"), "l_returnflag")
    return read_table(spark, _written(spark, li, "parquet"))


def q_isolation_flags(spark, sf):
    """Rows far from all others (one in a hundred) are the ones that are flagged."""
    from tidemark.operators.isolation import flag_outliers
    k = F.col("c_custkey")
    far = k % 100 == 0
    x = (k * 37 % 101 + F.when(far, 10000 + k * 7 % 5000).otherwise(0)).cast("double")
    y = (k * 53 % 97 + F.when(far, 20000 + k * 11 % 7000).otherwise(0)).cast("double")
    cust = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", x.alias("x"), y.alias("y"))
    flagged, _ = flag_outliers(cust, key_cols=["c_custkey"], contamination=0.01)
    return flagged.select("c_custkey", F.col("_is_outlier").alias("is_outlier"))


EDGE_COLUMNS = ["customerID", "tenure", "MonthlyCharges", "TotalCharges", "AvgMonthlySpend", "SpendVariance", "Churn",
                "Churn_Prob", "Predicted_CLV", "Segment", "Risk_Tier"]


def q_core_edges(spark, sf):
    """Dirty file, a few unknown labels."""
    r = run_core(FXT.churn_edges(spark, sf), model="heuristic")
    return round_doubles(r.df.select(*EDGE_COLUMNS, "plan"))


def q_core_unmapped(spark, sf):
    """Most labels unknown, so short tenure is the label."""
    r = run_core(FXT.churn_edges(spark, sf, mapped=False), model="heuristic")
    return round_doubles(r.df.select(*EDGE_COLUMNS, "plan"))


def _core_edges_sql(mapped: bool) -> str:
    out = [c if c in ("customerID", "Churn", "Segment", "Risk_Tier") else O.r6(c) for c in EDGE_COLUMNS]
    return O.core_edges(mapped) + "\nSELECT " + ", ".join(out) + ", plan FROM final JOIN plans USING (customerID)"


def q_adaptive_edges(spark, sf):
    """Dirty file, churn inferred from a yes/no column."""
    r = run_adaptive(FXT.adaptive_edges(spark, sf), model="heuristic", clv="heuristic")
    return round_doubles(r.df.select(*ADAPTIVE_COLUMNS))


SQL_ADAPTIVE_EDGES = O.adaptive_edges() + "\nSELECT " + ", ".join(
    c if c in ("customer_id", "Churn", "TenureGroup", "Segment", "Recommendation") else O.r6(c) for c in ADAPTIVE_COLUMNS) + " FROM final"

SQL_SRC_OVERLONG = """
SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS customer,
       CASE WHEN o_orderkey % 5 = 1 OR o_orderkey % 7 = 1 THEN NULL ELSE o_orderstatus END AS status
FROM orders WHERE o_orderkey % 5 <> 0"""

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "churn_input": (q_churn_input, "WITH" + O.churn_input_cte() + "\nSELECT * FROM churn_input"),
    "core_processed": (q_core_processed, SQL_CORE_PROCESSED),
    "core_segment_summary": (q_core_segment_summary, SQL_SEGMENT_SUMMARY),
    "core_kpis": (q_core_kpis, SQL_KPIS),
    "core_segment_counts": (q_core_segment_counts, SQL_SEGMENT_COUNTS),
    "core_risk_tier_counts": (q_core_risk_tier_counts, SQL_RISK_TIER_COUNTS),
    "core_top_risk": (q_core_top_risk, SQL_TOP_RISK),
    "core_synthetic_labels": (q_core_synthetic_labels, SQL_SYNTHETIC),
    "core_prob_bins": (_bins("Churn_Prob"), sql_bins("Churn_Prob")),
    "core_clv_bins": (_bins("Predicted_CLV"), sql_bins("Predicted_CLV")),
    "core_tenure_bins": (_bins("tenure"), sql_bins("tenure")),
    "core_monthly_bins": (_bins("MonthlyCharges"), sql_bins("MonthlyCharges")),
    "lineitem_pct_rank": (q_lineitem_pct_rank, SQL_LINEITEM_PCT),
    "dirty_numbers": (q_dirty_numbers, _dirty_sql()),
    "adaptive_processed": (q_adaptive_processed, SQL_ADAPTIVE),
    "adaptive_segments": (q_adaptive_segments, SQL_ADAPTIVE_SEGMENTS),
    "adaptive_churn_dist": (q_adaptive_churn_dist, SQL_ADAPTIVE_CHURN_DIST),
    "adaptive_clv_dist": (_qcut("Predicted_CLV", "CLV Tier"), sql_qcut("Predicted_CLV", "CLV Tier")),
    "adaptive_spend_dist": (_qcut("AvgMonthlySpend", "Spend Tier"), sql_qcut("AvgMonthlySpend", "Spend Tier")),
    "adaptive_tenure_dist": (q_adaptive_tenure_dist, SQL_ADAPTIVE_TENURE),
    "adaptive_kpis": (q_adaptive_kpis, SQL_ADAPTIVE_KPIS),
    "adaptive_quality": (q_adaptive_quality, sql_quality()),
    "v2_processed": (q_v2_processed, SQL_V2),
    "v2_churn_dist": (q_v2_churn_dist, SQL_V2_CHURN_DIST),
    "v2_clv_dist": (q_v2_clv_dist, sql_v2_qcut("Predicted_CLV", "CLV Tier")),
    "v2_spend_dist": (q_v2_spend_dist, sql_v2_qcut("AvgMonthlySpend", "Spend Tier")),
    "v2_kpis": (q_v2_kpis, SQL_V2_KPIS),
    "events_adaptive": (q_events_adaptive, sql_events_adaptive()),
    "src_csv_quotes": (q_src_csv_quotes, "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents"),
    "src_csv_overlong": (q_src_csv_overlong, SQL_SRC_OVERLONG),
    "src_json_lines": (q_src_json_lines, "SELECT doc_id, text, lang FROM documents"),
    "src_json_records": (q_src_json_records, "SELECT doc_id, text, lang FROM documents"),
    "src_encoding_late": (q_src_encoding_late, "SELECT CAST(o_orderkey AS VARCHAR) AS \"order key\", "
                          "CASE WHEN o_orderkey % 9973 = 9972 THEN 'déjà vu' ELSE o_orderstatus END AS status FROM orders"),
    "isolation_flags": (q_isolation_flags, "SELECT c_custkey, CAST(c_custkey % 100 = 0 AS INTEGER) AS is_outlier FROM customer"),
    "core_edges": (q_core_edges, _core_edges_sql(True)),
    "core_unmapped": (q_core_unmapped, _core_edges_sql(False)),
    "adaptive_edges": (q_adaptive_edges, SQL_ADAPTIVE_EDGES),
    "src_parquet_text": (q_src_parquet_text, "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, "
                         "CAST(CAST(l_extendedprice AS DOUBLE) * 1000 AS VARCHAR) AS price, l_returnflag FROM lineitem"),
    "core_v1_processed": (q_core_v1_processed, SQL_CORE_V1),
    "core_ml_checks": (q_core_ml_checks, SQL_ML_CHECKS),
    "core_ml_scores": (q_core_ml_scores, None),
    "adaptive_ml_scores": (q_adaptive_ml_scores, None),
    "adaptive_ridge_clv": (q_adaptive_ridge_clv, None),
    "isolation_outliers": (q_isolation_outliers, None),
}
