"""Text-to-number traps, table-driven."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.numeric import adaptive_num, clean_num, reparse_float, safe_float

CLEAN_CASES = [
    ("1234.56", 1234.56), ("$1,234.56", 1234.56), ("1.234,56", 1234.56), ("12.345", 12345.0),
    ("1234,56", 123456.0), ("(5)", 5.0), ("1e-05", None), ("₹ 1,23,456.78", 123456.78),
    ("  42 ", 42.0), ("N/A", None), ("", None), (None, None), ("-7.5", -7.5), ("€ 3", 3.0),
    ("1,234", 1234.0), ("12.34.56", None),
]


@pytest.mark.parametrize("text,want", CLEAN_CASES)
def test_clean_num(spark, text, want):
    got = spark.createDataFrame([(text,)], "s string").select(clean_num(F.col("s"))).first()[0]
    assert got == want


ADAPTIVE_CASES = [
    ("NA", None), ("#REF!", None), ("-", None), ("$1,200", 1200.0), ("15%", 15.0),
    (" 7 ", 7.0), ("1.234,56", 1.23456), ("abc", None),
]


@pytest.mark.parametrize("text,want", ADAPTIVE_CASES)
def test_adaptive_num(spark, text, want):
    got = spark.createDataFrame([(text,)], "s string").select(adaptive_num(F.col("s"))).first()[0]
    assert got == want


REPARSE_CASES = [(29.125, 29125.0), (0.125, 125.0), (1e-05, None), (36.0, 36.0), (1234.5, 1234.5),
                 (1000.125, 1000.125), (1e16, 116.0), (-3.5, -3.5)]


@pytest.mark.parametrize("v,want", REPARSE_CASES)
def test_reparse_trap(spark, v, want):
    df = spark.createDataFrame([(v,)], "v double")
    got = df.select(reparse_float(F.col("v"))).first()[0]
    assert got == want
    strict = df.select(reparse_float(F.col("v"), strict=True)).first()[0]
    assert strict == v


def test_safe_float(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (2.5,)], "v double")
    got = [r[0] for r in df.select(safe_float("v", 9.0)).collect()]
    assert got == [9.0, 9.0, 9.0, 2.5]
    assert not any(math.isnan(g) for g in got)


DIRTY = ["30d", "1.5f", "0x1p3", "1e7", "inf", "-inf", "+nan", "+Infinity", " 12 ", "1e-05", "12.345", "-1.234,56", "٣", "5-3", ".5", "5.", "--1"]


def test_numbers_as_python_reads_them(spark):
    rows = spark.createDataFrame([(x,) for x in DIRTY], "s string").select("s", adaptive_num("s").alias("a"), clean_num("s").alias("c")).collect()
    for r in rows:
        try:
            want = None if r.s == "٣" else float(r.s.strip().replace(",", ""))
        except ValueError:
            want = None
        assert r.a == want or (want != want and r.a != r.a)
    core = {r.s: r.c for r in rows}
    assert core["30d"] == 30.0 and core["1.5f"] == 1.5 and core["1e7"] == 17.0 and core["12.345"] == 12345.0
    assert core["-1.234,56"] == -1.23456 and core["5-3"] is None and core[".5"] == 0.5 and core["5."] == 5.0 and core["inf"] is None


@pytest.mark.parametrize("parse", [clean_num, adaptive_num, reparse_float])
def test_each_pattern_runs_once_a_cell(spark, parse):
    df = spark.range(1).selectExpr("cast(id as string) as s").select(parse(F.col("s")).alias("o"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 3 and plan.count("RLIKE") <= 2
