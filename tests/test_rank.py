"""Distributed percentile ranks and quantiles against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import rank as R
from tidemark.operators.rank import quantiles, with_pct_ranks

from conftest import SF_MID


def test_pct_rank_matches_pandas_on_ties(spark):
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    got = with_pct_ranks(li, ["l_quantity"], ["r"], n_buckets=16).toPandas()
    want = got["l_quantity"].rank(pct=True, method="average")
    assert np.allclose(got["r"].to_numpy(), want.to_numpy(), rtol=0, atol=1e-15)


@pytest.mark.parametrize("buckets", [1, 2, 7, 300])
def test_ranks_equal_a_window(spark, buckets):
    from pyspark.sql import Window
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet").select("l_quantity", "l_extendedprice")
    got = with_pct_ranks(li, ["l_quantity", "l_extendedprice"], ["a", "b"], n_buckets=buckets)
    n = li.count()
    for c, r in (("l_quantity", "a"), ("l_extendedprice", "b")):
        w, ties = Window.orderBy(c), Window.partitionBy(c)
        bad = got.withColumn("want", (F.rank().over(w) + (F.count("*").over(ties) - 1) / 2) / n).where(F.col("want") != F.col(r))
        assert bad.count() == 0


def test_exchanges_do_not_grow_with_the_columns(spark):
    df = spark.range(5000).selectExpr("id", *[f"cast(hash(id, {i}) as double) as x{i}" for i in range(6)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [with_pct_ranks(df, [f"x{i}" for i in range(n)])._jdf.queryExecution().executedPlan().toString() for n in (1, 3, 6)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # by cell, by row number, and the rows that meet their ranks
    assert [p.count("Exchange hashpartitioning") for p in plans] == [3, 3, 3]


def test_hot_values_and_nulls_are_not_moved_by_cell(spark):
    df = spark.range(9000).selectExpr("case when id % 3 = 0 then 5.0 when id % 3 = 1 then null else cast(id as double) end as x",
                                      "cast(1 as double) as constant", "cast(null as double) as none", "double('nan') as nan",
                                      "if(id % 2 = 0, double('inf'), double(id)) as inf")
    got = with_pct_ranks(df, ["x", "constant", "none", "nan", "inf"]).toPandas()
    for c in ("x", "constant", "inf"):
        assert np.allclose(got[f"{c}_pct"], got[c].rank(pct=True), atol=1e-15, equal_nan=True)
    assert got["none_pct"].isna().all() and got["nan_pct"].isna().all()
    rows, cells = R._cut(df.select("x"), ["x"], 64)
    assert 5.0 in cells[0].edges and rows.where("__c0 % 2 = 0").groupBy("__c0").count().agg(F.max("count")).first()[0] < 9000 / 40


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(1.0,), (None,), (2.0,), (2.0,)], "x double")
    got = sorted((r["x"], r["r"]) for r in with_pct_ranks(df, ["x"], ["r"]).collect()
                 if r["x"] is not None)
    assert got == [(1.0, 1 / 3), (2.0, 2.5 / 3), (2.0, 2.5 / 3)]
    assert [r["r"] for r in with_pct_ranks(df, ["x"], ["r"]).collect() if r["x"] is None] == [None]


@pytest.mark.parametrize("q", [0.0, 0.01, 0.25, 0.5, 0.65, 0.7, 0.95, 0.99, 1.0])
def test_quantiles_match_numpy(spark, q):
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet").select("l_quantity", "l_extendedprice")
    pdf = li.toPandas()
    got = quantiles(li, {"l_quantity": [q], "l_extendedprice": [q]})
    assert got["l_quantity"][0] == float(pdf["l_quantity"].quantile(q))
    assert got["l_extendedprice"][0] == float(pdf["l_extendedprice"].quantile(q))


def test_brackets_narrow(spark):
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet").select("l_extendedprice", "l_quantity")
    qs = [0.001, 0.3, 0.5, 0.999]
    want = li.toPandas()
    for bracket, accuracy in ((2, 10000), (50, 20), (0, 100)):
        got = quantiles(li, {c: qs for c in want.columns}, accuracy=accuracy, max_bracket=bracket)
        for c in want.columns:
            assert got[c] == [want[c].quantile(q) for q in qs]


def test_null_values_are_spread(spark):
    df = spark.range(20000).selectExpr("id", "if(id % 10 < 9, null, cast(id as double)) as x")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = with_pct_ranks(df, ["x"], ["r"])
        sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(sizes) < 0.5 * 20000 and out.filter("x is null and r is not null").count() == 0


def test_skewed_value(spark):
    # one value holds a third of the rows: it is one row after the partial aggregate
    rows = [(7.0,)] * 300 + [(float(i),) for i in range(600)]
    df = spark.createDataFrame(rows, "x double")
    got = with_pct_ranks(df, ["x"], ["r"]).toPandas()
    want = got["x"].rank(pct=True)
    assert np.allclose(got["r"], want, atol=1e-15)
    assert quantiles(df, {"x": [0.5]})["x"][0] == float(pd.Series([r[0] for r in rows]).median())


def test_salted_join_back_with_several_hot_values(spark):
    rows = [(1.0,)] * 400 + [(2.0,)] * 300 + [(float(i),) for i in range(10, 310)]
    df = spark.createDataFrame(rows, "x double")
    got = with_pct_ranks(df, ["x"], ["r"], n_buckets=4).toPandas()
    assert len(got) == len(rows)
    assert np.allclose(got["r"], got["x"].rank(pct=True), atol=1e-15)
