"""K1-K5 report tables, the writer, and the folder stream."""

import glob
import os
import tempfile

from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators import aggregates as A
from tidemark.plans import report
from tidemark.plans.core import run_core
from tidemark.sources.fixtures import churn_input

from conftest import SF_SMALL


def test_core_tables_and_audit(spark):
    res = run_core(churn_input(spark, SF_SMALL), model="heuristic")
    tables = report.core_tables(res)
    audit = {(r["section"], r["key"]): r["value"] for r in tables["data_quality"].collect()}
    assert audit[("columns", "churn")] == "Churn"
    assert audit[("columns", "id")] == "customerID"
    assert audit[("source", "rows kept")] == f"{res.df.count():,}"
    assert tables["processed_data"].columns[0] == "customerID"
    assert tables["high_risk_customers"].where(F.col("Churn_Prob") < 0.6).count() == 0
    assert audit[("source", "path")] == "not from a file" and audit[("model", "metrics withheld")] == "no" and ("method", "labels") in audit
    # all chart tables come from one count and equal those counted one by one
    for name, column in report.CHART_CUTS.items():
        assert tables[name].collect() == A.safe_cut(res.df, column).collect()
    assert tables["data_segments"].collect() == A.value_counts(res.df, "Segment").collect()
    assert tables["data_risk_tiers"].collect() == A.value_counts(res.df, "Risk_Tier", "Risk Tier", order=C.RISK_TIERS).collect()
    out = tempfile.mkdtemp(prefix="tidemark-rep-")
    written = report.write_tables(tables, out)
    assert len(written) == len(tables)
    assert spark.read.parquet(os.path.join(out, "segment_summary")).count() == \
        tables["segment_summary"].count()


def test_folder_stream_processes_each_file_once(spark):
    inbox = tempfile.mkdtemp(prefix="tidemark-in-")
    out = tempfile.mkdtemp(prefix="tidemark-out-")
    ckpt = tempfile.mkdtemp(prefix="tidemark-ck-")
    rows = churn_input(spark, SF_SMALL).toPandas()
    rows.to_csv(os.path.join(inbox, "customers_a.csv"), index=False)
    from tidemark.streaming.watch import watch_folder
    q = watch_folder(spark, inbox, out, checkpoint=ckpt, lineage="core", available_now=True)
    q.awaitTermination(600)
    got = spark.read.parquet(glob.glob(os.path.join(out, "customers_a.csv-*", "processed_data"))[0])
    assert got.count() == len(rows.drop_duplicates())
    # a restart finds nothing new
    q2 = watch_folder(spark, inbox, out, checkpoint=ckpt, lineage="core", available_now=True)
    q2.awaitTermination(600)
    assert q2.lastProgress is None or q2.lastProgress["numInputRows"] == 0
