"""E1 on rows worked out by hand, plus the documented traps."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators import features as FX
from tidemark.operators.detection import detect_roles, find_col
from tidemark.plans.core import run_core
from tidemark.sources.fixtures import churn_input

from conftest import SF_SMALL

EDGE = pd.DataFrame({
    "Customer ID": ["a1", "a2", "a3", "a4", "a5", "a6", "a7", "a7", None, "a9", "a10", "a11"],
    "Tenure (months)": ["0", "12", "24", "36", "$48", "60", "72", "72", None, "29.1250", "5", "-3"],
    "Monthly Charge": ["50", "1.234,56", "70.5", "80", "90", "", "110", "110", None, "40", "55", "65"],
    "Total Spend": ["100", "20", "1,680.00", "2880", "N/A", "3600", "7920", "7920", None, "400", "300", "90"],
    "Plan": ["gold", "silver", "gold", None, "bronze", "silver", "gold", "gold", None, "gold", "silver", "gold"],
    "Status": ["Yes", "no", "churned", "active", "maybe", "No", "YES", "YES", None, "no", "left", "stay"],
    "Empty": [None] * 12,
    "Unnamed: 9": ["x"] * 12,
})


def test_roles_and_traps():
    assert find_col(["usage_level", "tenure_age"], "age") == "usage_level"   # substring trap
    roles = detect_roles(list(EDGE.columns))
    assert roles == {"churn": "Status", "tenure": "Tenure (months)", "monthly": "Monthly Charge",
                     "total": "Total Spend", "id": "Customer ID"}


def test_rows_worked_out_by_hand(spark):
    raw = spark.createDataFrame([
        ("a", "10", "50", "500", "Yes"), ("b", "20", "1.000,50", "20", "no"), ("c", "40", "$80", "3,200", "No"),
        ("d", None, "60", "600", "maybe"), ("d", None, "60", "600", "maybe"), (None, None, None, None, None),
    ], "`Customer ID` string, `Tenure (months)` string, `Monthly Charge` string, `Total Spend` string, Status string")
    rows = {r["Customer ID"]: r for r in run_core(raw, model="heuristic").processed().collect()}
    s = C.SEGMENTS_CORE  # high risk and value, high risk, high value, neither
    # tenure (median fills d), monthly (European text), total (b: below monthly, so 20 x 1000.5), churn (d: mode),
    # probability .55 (1 - rank tenure) + .25 rank monthly + .2 rank |monthly - avg| / (avg + 1), segment
    want = {"a": (10.0, 50.0, 500.0, 1, 0.625, s[1]), "b": (20.0, 1000.5, 20010.0, 0, 0.55625, s[2]),
            "c": (40.0, 80.0, 3200.0, 0, 0.2375, s[2]), "d": (20.0, 60.0, 600.0, 0, 0.53125, s[3])}
    assert set(rows) == set(want)
    for k, (tenure, monthly, total, churn, prob, segment) in want.items():
        r = rows[k]
        assert (r["tenure"], r["MonthlyCharges"], r["TotalCharges"], r["Churn"], r["Segment"]) == (tenure, monthly, total, churn, segment)
        assert r["Churn_Prob"] == pytest.approx(prob, abs=6e-5)
        assert r["AvgMonthlySpend"] == pytest.approx(total / (tenure + 1))
        assert r["Predicted_CLV"] == pytest.approx(total * (1 - r["Churn_Prob"]))


def test_unmapped_churn_falls_back_to_tenure_median(spark):
    pdf = EDGE.copy()
    pdf["Status"] = ["p", "q", "r", "s", "t", "u", "v", "v", None, "w", "no", "yes"]
    res = run_core(spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None)))
    out = res.processed().toPandas()
    assert (out["Churn"] == (out["tenure"] < out["tenure"].median()).astype(int)).all() and set(out["Churn"]) == {0, 1}
    assert res.synthetic and res.churn_source.startswith("Synthetic ('Status'")


def test_reparse_trap_strict_switch(spark):
    raw = spark.createDataFrame(EDGE.astype(object).where(EDGE.notna(), None))
    t = {r[0]: r[1] for r in run_core(raw, model="heuristic").processed().select("Customer ID", "tenure").collect()}
    ts = {r[0]: r[1] for r in run_core(raw, strict=True, model="heuristic").processed().select("Customer ID", "tenure").collect()}
    assert t["a9"] == 29125.0 and ts["a9"] == 29.125


@pytest.mark.parametrize("p,tier", [(0.0, "Low Risk (0-30%)"), (0.3, "Low Risk (0-30%)"),
                                    (0.3001, "Medium Risk (30-60%)"), (0.6, "Medium Risk (30-60%)"),
                                    (0.6001, "High Risk (60-100%)"), (1.0, "High Risk (60-100%)")])
def test_risk_tier_edges(spark, p, tier):
    got = spark.createDataFrame([(p,)], "Churn_Prob double").select(FX.risk_tier()).first()[0]
    assert got == tier


def test_segment_at_exact_thresholds(spark):
    df = spark.createDataFrame([(0.6, 10.0), (0.5999, 10.0)], "Churn_Prob double, Predicted_CLV double")
    got = [r[0] for r in df.select(FX.core_segment(10.0)).collect()]
    assert got == ["High Risk – High Value", "Low Risk – High Value"]


def test_synthetic_labels_share(spark):
    res = run_core(churn_input(spark, SF_SMALL).drop("Churn"), model="heuristic")
    share = res.df.agg(F.avg("Churn")).first()[0]
    assert res.synthetic and 0.3 <= share <= 0.4


def test_v1_lineage_formulas(spark):
    pdf = churn_input(spark, SF_SMALL).toPandas()
    res = run_core(spark.createDataFrame(pdf), lineage="v1", model="heuristic")
    got = res.processed().toPandas()
    t, m = got["tenure"], got["MonthlyCharges"]
    assert np.allclose(got["ValueScore"], (m * np.log1p(t)).clip(lower=0))
    assert np.allclose(got["LoyaltyScore"], (t / (m + 1)).clip(lower=0))
    # total is its own predictor in the OLS value model: the fit is exact
    assert np.allclose(got["Predicted_CLV"], got["TotalCharges"].clip(lower=0), rtol=1e-6)
    nolabel = run_core(spark.createDataFrame(pdf.drop(columns=["Churn"])), lineage="v1", model="heuristic")
    assert nolabel.churn_source == "Synthetic (tenure below median)"


def test_v1_v3_total_defaults_to_tenure_times_monthly(spark):
    pdf = pd.DataFrame({"customerID": [f"c{i}" for i in range(25)],
                        "tenure": [str(i + 1) for i in range(25)],
                        "MonthlyCharges": [str(10 + i) for i in range(25)],
                        "Churn": ["Yes" if i % 2 else "No" for i in range(25)]})
    for lineage in ("v1", "v3"):
        got = run_core(spark.createDataFrame(pdf), lineage=lineage, model="heuristic").processed().toPandas()
        assert np.allclose(got["TotalCharges"], got["tenure"] * got["MonthlyCharges"])
    main = run_core(spark.createDataFrame(pdf), model="heuristic").processed().toPandas()
    # the current release falls back to the third numeric column (none here): the 6000 default
    assert (main["TotalCharges"] == 6000.0).all()
