"""Adaptive mapping, status, quality and outliers."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import mapping as M
from tidemark.operators.features import tenure_group
from tidemark.operators.outliers import charge_outliers, tenure_outliers
from tidemark.operators.quality import quality_report
from tidemark.plans.adaptive import run_adaptive
from tidemark.sources.fixtures import adaptive_input

from conftest import SF_SMALL


def test_name_mapping_exact_partial_and_refusal():
    mapped, conf = M.name_mapping(["Account Length", "mrr", "tenure", "payment_status", "ltv_total"])
    assert mapped["mrr"] == "MonthlyCharges" and conf["MonthlyCharges"] == 0.9
    assert "Account Length" not in mapped            # tenure already present: refused
    assert mapped["payment_status"] == "PaymentStatus"
    assert mapped["ltv_total"] == "TotalCharges" and conf["TotalCharges"] == 0.7


@pytest.mark.parametrize("text,want", [("Active", 0), ("cancelled", 1), ("inactive", 1),
                                       ("inactive account", 0), ("Terminated early", 1),
                                       ("whatever", 0), (None, 0), ("Lapsed", 1)])
def test_status_mapping(spark, text, want):
    df = spark.createDataFrame([(text,)], "CustomerStatus string")
    assert df.select(M.status_map_expr("CustomerStatus")).first()[0] == want


def test_active_inverted(spark):
    df = spark.createDataFrame([("yes",), ("no",), ("TRUE",)], "Active string")
    assert [r[0] for r in df.select(M.active_map_expr("Active")).collect()] == [0, 1, 0]


def test_binary_inference(spark):
    df = spark.createDataFrame([("Y", 1.0), ("N", 2.0), ("Y", 3.0)], "flag string, x double")
    out, how = M.infer_churn_from_binary(df)
    assert how.startswith("flag") and [r[0] for r in out.select("Churn").collect()] == [1, 0, 1]


@pytest.mark.parametrize("mx,labels", [(10.0, "0-3mo"), (50.0, "0-6mo"), (900.0, "0-1yr")])
def test_tenure_group_sets(spark, mx, labels):
    df = spark.createDataFrame([(1.0,)], "tenure double")
    assert df.select(tenure_group(mx)).first()[0] == labels


def test_tenure_outliers_and_year_conversion(spark):
    rows = [(-5.0,), (70.0,), (60.0,), (75.0,), (99999.0,)]
    df = spark.createDataFrame(rows, "tenure double")
    rep = {}
    got = [r[0] for r in tenure_outliers(df, rep).collect()]
    # abs, 99999 -> median of the rest (65), median 65 > 50 and max 75 <= 80 -> years
    assert got == [60.0, 840.0, 720.0, 900.0, 780.0]
    assert rep["tenure_conversion"] == "years_to_months" and rep["tenure_outliers"] == 2


def test_charge_clipping(spark):
    vals = [float(v) for v in range(1, 101)] + [1e7]
    df = spark.createDataFrame([(v,) for v in vals], "MonthlyCharges double")
    rep = {}
    got = sorted(r[0] for r in charge_outliers(df, rep).collect())
    s = pd.Series(vals)
    q1, q3 = s.quantile(0.25), s.quantile(0.75)
    assert got[-1] == q3 + 3 * (q3 - q1) and rep["MonthlyCharges_outliers"] == 1


def test_quality_report_penalties(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", None), ("c", "2")], "employee string, salary string")
    rep = quality_report(df)
    assert rep["domain"] == "hr_payroll" and rep["dup_pct"] == 25.0 and rep["missing_pct"] == 12.5
    assert rep["quality_score"] == 100 - 15 - 5 - 5
    tiny = spark.createDataFrame([("a", "1")], "x string, y string")
    assert quality_report(tiny)["is_valid"] is False


def test_adaptive_fixture_pipeline(spark):
    res = run_adaptive(adaptive_input(spark, SF_SMALL), model="heuristic", clv="heuristic")
    assert res.mapping["name_based"]["account_length"] == "tenure"
    assert res.mapping["churn_from"] == "status words of CustomerStatus"
    assert res.thresholds.get("tenure_conversion") == "years_to_months"
    df = res.df
    assert df.where((F.col("Churn_Prob") < 0.05) | (F.col("Churn_Prob") > 0.95)).count() == 0
    assert set(r[0] for r in df.select("Segment").distinct().collect()) <= {
        "High Risk - High Value", "High Risk - Low Value", "Low Risk - High Value", "Low Risk - Low Value"}
    assert "ExpectedTotal" not in res.export().columns


def test_events_file_value_inference_and_isolation(spark):
    from tidemark.sources.fixtures import events_input
    from conftest import SF_MID
    res = run_adaptive(events_input(spark, SF_MID), model="heuristic", clv="heuristic")
    assert res.mapping["name_based"]["days_as_customer"] == "tenure_days"
    assert res.mapping["tenure_inferred_from"] == "tenure_days"
    assert res.mapping["churn_from"] == "Active, active rows count as retained"
    assert 0 < res.thresholds.get("multivariate_outliers", 0) < 0.1 * res.df.count()
    assert "_is_outlier" not in res.export().columns


def test_value_evidence(spark):
    from tidemark.operators.mapping import numeric_profile, value_inference
    df = spark.range(200).selectExpr("cast(1 + id % 60 as double) as span", "40 + id % 7 + 0.5 as paid_per_bill",
                                     "5000 + id * 3 + 0.25 as overall", "cast(id as double) as code", "900 + id * 1.5 as yearly_cost")
    prof = numeric_profile(df, df.columns)
    found = value_inference(df.columns, df.columns, prof)
    assert {k: v[0] for k, v in found.items()} == {"tenure": "span", "MonthlyCharges": "paid_per_bill", "TotalCharges": "overall"}
    assert found["MonthlyCharges"][1] == 0.3 + 0.4 + 0.1 and found["TotalCharges"][1] == 0.4 + 0.2
    # with a known monthly charge, a column of more than three charges is likelier a total
    known = df.withColumnRenamed("paid_per_bill", "MonthlyCharges").drop("yearly_cost")
    prof = numeric_profile(known, known.columns)
    assert value_inference(known.columns, known.columns, prof)["TotalCharges"] == ("overall", 0.4 + 0.3 + 0.2)
