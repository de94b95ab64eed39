"""K1-K5: the report as named tables, written as Parquet.

The workbook of the reference becomes a folder of tables: processed data,
raw copy, audit rows, one table per chart source, segment summary, action
list. Only the audit table is assembled from driver-side scalars (a few
dozen rows of text); every other table is a distributed DataFrame.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.operators import aggregates as A
from tidemark.operators import features as FX
from tidemark.plans.adaptive import AdaptiveResult
from tidemark.plans.core import CoreResult


def _fmt_int(v) -> str:
    return f"{int(v):,}"


def audit_rows(spark, rows: list[tuple[str, str, str]]) -> DataFrame:
    """K3: (section, key, value) rows, unpivoted from one row of literals
    (``inline`` of an array of structs), so the table is an ordinary DataFrame."""
    if not rows:
        return spark.createDataFrame([], "section string, key string, value string")
    structs = [F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), F.lit(str(v)).alias("value"))
               for s, k, v in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


# how each figure of the core report comes about
METHOD = {
    "labels": "yes/no words of the churn column; without one, the riskiest share by ranks of tenure, charge, spread and total",
    "risk score": "trained probability, or a weighted sum of percentile ranks where nothing can be trained",
    "customer value": "total charges times the probability to stay",
    "segments": "risk at or above the high limit, value at or above its median",
    "revenue at risk": "twelve monthly charges of the customers at high risk",
}


def _shown(value, form: str = "{}", missing: str = "none") -> str:
    return missing if value is None else form.format(value)


def core_audit(res: CoreResult, source: str | None = None) -> DataFrame:
    """K3: where the table came from, which columns were used, the model, the figures and the method.

    ``source`` is the path that was read, if any; metrics of made-up labels are withheld and said to be.
    """
    df, r = res.df, res.roles
    k = A.core_kpis(df, res.lineage).first().asDict()
    rows_in = res.raw.count() if res.raw is not None else None
    withheld = res.synthetic and res.accuracy is None
    metric = "withheld" if withheld else "not measured"
    sections = {
        "source": {
            "file": os.path.basename(source.rstrip("/")) if source else "not from a file", "path": source or "not from a file",
            "rows read": _shown(rows_in, "{:,}"), "columns read": _shown(len(res.raw.columns) if res.raw is not None else None),
            "rows kept": _fmt_int(k["total_customers"]),
            "rows left out": _shown(None if rows_in is None else rows_in - k["total_customers"], "{:,}"),
        },
        "columns": {
            **{role: _shown(r[role], missing="not found, made up" if role == "churn" else "not found, stood in for")
               for role in ("churn", "tenure", "monthly", "total")},
            "id": _shown(r["id"], missing="not found"), "label source": res.churn_source,
            "labels are real": "no" if res.synthetic else "yes",
        },
        "model": {
            "scorer": res.model_name, "features": ", ".join(C.CORE_FEATURES),
            "accuracy": _shown(res.accuracy, "{:.2%}", metric), "area under curve": _shown(res.auc, "{:.4f}", metric),
            "metrics withheld": "yes, the labels are made up" if withheld else "no",
        },
        "figures": {
            "customers": _fmt_int(k["total_customers"]), "churn rate": f"{k['churn_rate']}%", "retention rate": f"{k['retention_rate']}%",
            "high risk": f"{k['high_risk_n']:,} ({k['high_risk_pct']}%)", "medium risk": _fmt_int(k["med_risk_n"]), "low risk": _fmt_int(k["low_risk_n"]),
            **{name: f"{k[key]:,.0f}" for name, key in (("revenue at risk", "revenue_at_risk"), ("charges of those at risk", "tc_at_risk_hist"),
                                                       ("value of all customers", "total_clv"), ("mean value", "avg_clv"), ("mean monthly charge", "avg_monthly"))},
            "mean tenure": f"{k['avg_tenure']} months",
        },
        "method": METHOD,
    }
    return audit_rows(df.sparkSession, [(section, key, value) for section, entries in sections.items() for key, value in entries.items()])


CHART_CATEGORIES = {"data_segments": ("Segment", "Segment", None), "data_risk_tiers": ("Risk_Tier", "Risk Tier", C.RISK_TIERS)}
CHART_CUTS = {"data_churn_prob": "Churn_Prob", "data_clv": "Predicted_CLV", "data_tenure": "tenure", "data_monthly": "MonthlyCharges"}


def core_tables(res: CoreResult, source: str | None = None) -> dict[str, DataFrame]:
    """All core report tables."""
    df = res.df
    return {
        "processed_data": res.processed(),
        "raw_data": res.raw,
        "data_quality": core_audit(res, source),
        "segment_summary": A.segment_summary(df),
        "high_risk_customers": A.top_risk(df, res.id_col),
        **A.distributions(df, CHART_CATEGORIES, CHART_CUTS),
    }


def adaptive_audit(res: AdaptiveResult) -> DataFrame:
    q = res.quality
    rows = [("quality", "score", str(q["quality_score"])), ("quality", "domain", q["domain"] or "unknown")]
    rows += [(section, str(i + 1), text) for section, texts in (("finding", q["issues"]), ("advice", q["recommendations"]), ("note", res.notes))
             for i, text in enumerate(texts)]
    rows += [("mapping", k, str(v)) for k, v in res.mapping.items()] + [("model", "scorer", res.model_note)]
    return audit_rows(res.df.sparkSession, rows)


def adaptive_tables(res: AdaptiveResult) -> dict[str, DataFrame]:
    """All adaptive report tables (K3, K4, K5, A5-A10)."""
    df = res.df
    out = {
        "data": res.export(),
        "data_quality": adaptive_audit(res),
        "summary": A.adaptive_kpis(df),
        "segments": A.value_counts(df, "Segment", percentage=True),
        "churn_dist": A.fixed_bins(df, "Churn_Prob", C.PROB_BINS, C.PROB_BIN_LABELS, "Risk Level"),
        "tenure_dist": A.tenure_group_counts(
            df, FX.tenure_labels(df.agg(F.max("tenure")).first()[0])[1]),
    }
    clv = A.qcut_counts(df, "Predicted_CLV", "CLV Tier")
    spend = A.qcut_counts(df, "AvgMonthlySpend", "Spend Tier")
    if clv is not None:
        out["clv_dist"] = clv
    if spend is not None:
        out["spend_dist"] = spend
    return out


def write_tables(tables: dict[str, DataFrame], out_dir: str, mode: str = "overwrite") -> list[str]:
    """Write each table as Parquet under ``out_dir/<name>``."""
    written = []
    for name, df in tables.items():
        if df is None:
            continue
        path = os.path.join(out_dir, name)
        safe = df.toDF(*[c.replace(" ", "_").replace("(", "").replace(")", "").replace(".", "_")
                         for c in df.columns])
        safe.write.mode(mode).parquet(path)
        written.append(path)
    return written


def v2_tables(res) -> dict[str, DataFrame]:
    """Release 2.0 report tables: data (2 helper columns dropped), segments,
    churn distribution (lowest edge excluded), quintiles collapsing to one
    ``All`` row on duplicate edges, tenure groups (zero counts kept)."""
    df = res.df
    return {
        "data": res.export(),
        "segments": A.value_counts(df, "Segment", percentage=True),
        "churn_dist": A.fixed_bins(df, "Churn_Prob", C.PROB_BINS, C.PROB_BIN_LABELS, "Risk Level",
                                   include_lowest=False),
        "clv_dist": A.qcut_counts(df, "Predicted_CLV", "CLV Tier", on_duplicate="all"),
        "spend_dist": A.qcut_counts(df, "AvgMonthlySpend", "Spend Tier", on_duplicate="all"),
        "tenure_dist": A.tenure_group_counts(df, C.V2_TENURE_GROUPS[1]),
    }
