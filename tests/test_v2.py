"""Adaptive lineage release 2.0: D5, P15 by name, F10, F18, A8/A9 variants."""

from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.plans.adaptive_v2 import run_adaptive_v2, to_binary
from tidemark.sources.fixtures import adaptive_input

from conftest import SF_SMALL


def test_v2_on_adaptive_fixture(spark):
    res = run_adaptive_v2(adaptive_input(spark, SF_SMALL), model="heuristic", clv="heuristic")
    assert res.mapping == {"account_length": "tenure", "total_spend": "TotalCharges",
                           "customer_status": "Churn"}
    df = res.df
    # no 2.0 synonym for "mrr" and no column in the 10..500 range: monthly defaults to 50;
    # status text fails the numeric cast, so every churn flag is 0
    assert df.where(F.col("MonthlyCharges") != 50.0).count() == 0
    assert df.agg(F.max("Churn")).first()[0] == 0
    assert df.where((F.col("Priority") <= 0) | (F.col("Priority") > 100)).count() == 0
    clv = A.qcut_counts(df, "Predicted_CLV", "CLV Tier", on_duplicate="all").collect()
    assert [(r[0], r[1]) for r in clv] == [("All", df.count())]


def test_v2_name_units_and_inference(spark):
    rows = [(f"c{i}", float(30 * (i + 1)), f"{20 + i}", "yes" if i % 3 == 0 else "no") for i in range(30)]
    raw = spark.createDataFrame(rows, "id string, days_active double, fee_paid string, status_flag string")
    res = run_adaptive_v2(raw.select("id", F.col("days_active").cast("string").alias("days_active"),
                                     "fee_paid", "status_flag"))
    got = {r["id"]: (r["tenure"], r["MonthlyCharges"], r["Churn"]) for r in res.df.collect()}
    assert got["c0"] == (1.0, 20.0, 1) and got["c1"] == (2.0, 21.0, 0)   # days / 30, fee keyword
    assert "Inferred 'tenure' from 'days_active'" in res.notes


def test_binary_tokens_numbers_are_not_tokens(spark):
    df = spark.createDataFrame([("Yes",), ("1",), ("1.0",), (None,), ("lost",)], "x string")
    assert [r[0] for r in df.select(to_binary("x")).collect()] == [1, 1, 0, 0, 1]


def test_v2_report_tables(spark):
    from tidemark.plans.report import v2_tables
    res = run_adaptive_v2(adaptive_input(spark, SF_SMALL), model="heuristic", clv="heuristic")
    t = v2_tables(res)
    assert "ChargeRatio" not in t["data"].columns and "SpendingVariance" in t["data"].columns
    assert t["tenure_dist"].count() == 5
    assert t["churn_dist"].agg(F.sum("Count")).first()[0] == res.df.count()
