"""The adaptive lineage as first released (2.0): exact synonyms only,
keyword inference with unit conversion by name, placeholder churn, a
tenure/charge heuristic, best-accuracy model choice.

Same Spark shape as :mod:`tidemark.plans.adaptive`: scalar driver barriers,
distributed ranks and exact quantiles, column expressions for every rule.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.numeric import as_double, bound, lower_token, py_strip, to_double
from tidemark.operators import features as FX
from tidemark.operators.rank import numbered_boundary, quantiles, with_pct_ranks
from tidemark.operators.repeats import without_repeats
from tidemark.plans.adaptive import numeric_columns
from tidemark.session import materialize


def _q(c):
    return F.col(f"`{c}`")


@dataclass
class V2Result:
    df: DataFrame
    mapping: dict
    notes: list = field(default_factory=list)
    model_note: str = ""
    accuracy: float | None = None

    def export(self) -> DataFrame:
        return self.df.drop(*[c for c in C.V2_EXPORT_DROP_COLUMNS if c in self.df.columns])


def v2_num(c) -> F.Column:
    """v2.0 text-to-number: null tokens, then ``$ , %`` removed anywhere."""
    known = bound(py_strip(_q(c) if isinstance(c, str) else c), lambda t: F.when(~t.isin(C.V2_NULL_TOKENS), t))
    return to_double(F.translate(known, "$,%", ""))


def to_binary(c: str) -> F.Column:
    """1 for a positive token, else 0 (numbers print as ``1.0``, which is not one)."""
    return F.when(lower_token(_q(c).cast("string")).isin(C.V2_BINARY_POSITIVE), 1).otherwise(0)


def run_adaptive_v2(raw: DataFrame, model: str = "auto", clv: str = "ridge",
                    pin: str = "checkpoint") -> V2Result:
    notes: list[str] = []
    names = [str(c).strip().replace("\n", " ").replace("\r", "") for c in raw.columns]
    df = materialize(raw.toDF(*names), pin)
    r = df.agg(F.count(F.lit(1)).alias("__n"),
               *[F.count(v2_num(c)).alias(f"p{i}") for i, c in enumerate(df.columns)]).first()
    n = max(r["__n"], 1)
    df = df.select(*[(v2_num(c).alias(c) if r[f"p{i}"] / n > C.ADAPTIVE_ADOPT_RATIO else _q(c))
                     for i, c in enumerate(df.columns)])
    mapped = {}
    for c in df.columns:
        target = C.V2_COLUMN_MAPPINGS.get(c.lower().strip().replace(" ", "_"))
        if target is not None and target not in df.columns:
            mapped[c] = target
    if mapped:
        df = df.select(*[_q(c).alias(mapped.get(c, c)) for c in df.columns])
    numeric = numeric_columns(df)
    for target in ("tenure", "MonthlyCharges", "TotalCharges", "Churn"):
        if target in df.columns:
            continue
        df, src = _infer(df, target, numeric)
        if src:
            notes.append(f"Inferred '{target}' from '{src}'")
    df, fewer = without_repeats(materialize(_clean(df), pin))
    df = _features(materialize(df, pin) if fewer else df)
    feats = [c for c in ["tenure", "MonthlyCharges", "TotalCharges", "AvgMonthlySpend", "ChargeRatio"]
             if c in df.columns]
    st = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("Churn").alias("k"),
                F.sum("Churn").alias("s"), F.max("tenure").alias("mt")).first()
    accuracy, note, scored = None, "", None
    if model != "heuristic" and st["k"] >= 2 and st["n"] >= 10:
        from tidemark.operators import ml
        fit = ml.v2_model(df, feats, st)
        if fit is not None:
            scored, note, accuracy = fit
    if scored is None:
        scored = heuristic_v2(df, st["mt"])
        note = note or "Using heuristic scoring"
    if clv == "ridge":
        from tidemark.operators import ml
        scored = ml.ridge_clv(scored, future=False, fill=False)
    else:
        scored = scored.withColumn("Predicted_CLV", F.col("MonthlyCharges") * C.FUTURE_MONTHS)
    scored = numbered_boundary(scored)
    th = quantiles(scored, {"Churn_Prob": [C.ADAPTIVE_RISK_QUANTILE], "Predicted_CLV": [0.5]})
    seg = scored.withColumn("Segment", FX.adaptive_segment(th["Churn_Prob"][0], th["Predicted_CLV"][0]))
    seg = seg.withColumn("__pv", F.col("Churn_Prob") * F.col("Predicted_CLV"))
    seg = with_pct_ranks(seg, ["__pv"], ["__r"]).withColumn("Priority", F.col("__r") * 100).drop("__pv", "__r")
    return V2Result(df=seg, mapping=mapped, notes=notes, model_note=note, accuracy=accuracy)


def _infer(df: DataFrame, target: str, numeric: list[str]) -> tuple[DataFrame, str | None]:
    """D5 + P15 by name."""
    if target == "Churn":
        from tidemark.operators.profile import small_distinct_counts
        counts = small_distinct_counts(df, list(df.columns), 5)
        for c in df.columns:
            if any(k in c.lower() for k in C.V2_CHURN_KEYWORDS) and counts[c] <= 5:
                return df.withColumn("Churn", to_binary(c)), c
        for c in df.columns:
            if counts[c] == 2:
                return df.withColumn("Churn", to_binary(c)), c
        return df.withColumn("Churn", F.lit(0)), None
    if target == "tenure":
        for c in numeric:
            low = c.lower()
            if any(k in low for k in C.V2_TENURE_KEYWORDS):
                t = _q(c)
                if "day" in low:
                    t = t / 30
                elif "year" in low:
                    t = t * 12
                elif "week" in low:
                    t = t / 4
                return df.withColumn("tenure", t), c
        if numeric:
            r = df.agg(*[F.min(_q(c)).alias(f"a{i}") for i, c in enumerate(numeric)],
                       *[F.max(_q(c)).alias(f"b{i}") for i, c in enumerate(numeric)]).first()
            for i, c in enumerate(numeric):
                if r[f"a{i}"] is not None and r[f"a{i}"] >= 0 and r[f"b{i}"] <= 1000:
                    return df.withColumn("tenure", _q(c)), c
        return df.withColumn("tenure", F.lit(12.0)), None
    if target == "MonthlyCharges":
        for c in numeric:
            low = c.lower()
            if any(k in low for k in C.V2_MONTHLY_KEYWORDS) and not any(x in low for x in C.V2_MONTHLY_EXCLUDE):
                return df.withColumn("MonthlyCharges", _q(c)), c
        cands = [c for c in numeric if c not in ("tenure", "Churn")]
        meds = quantiles(df, {c: [0.5] for c in cands}) if cands else {}
        for c in cands:
            m = meds[c][0]
            if m is not None and 10 <= m <= 500:
                return df.withColumn("MonthlyCharges", _q(c)), c
        return df.withColumn("MonthlyCharges", F.lit(50.0)), None
    for c in numeric:
        if any(k in c.lower() for k in C.V2_TOTAL_KEYWORDS):
            return df.withColumn("TotalCharges", _q(c)), c
    if "tenure" in df.columns and "MonthlyCharges" in df.columns:
        return df.withColumn("TotalCharges", F.col("MonthlyCharges") * F.col("tenure")), "calculated"
    return df.withColumn("TotalCharges", F.lit(C.V2_DEFAULT_TOTAL)), None


def _clean(df: DataFrame) -> DataFrame:
    """P13 (2.0): median fill (1 / 50 when missing), abs, tenure 0 -> 1."""
    keys = ["tenure", "MonthlyCharges", "TotalCharges"]
    kinds = dict(df.dtypes)
    df = df.withColumns({c: as_double(c, kinds[c]) for c in keys})
    df = df.withColumn("Churn", (F.coalesce(as_double("Churn", kinds["Churn"]), F.lit(0.0))
                                 .cast("int") > 0).cast("int"))
    meds = quantiles(df, {c: [0.5] for c in keys})
    for c in keys:
        m = meds[c][0]
        if m is None or m != m:
            m = 1.0 if c == "tenure" else 50.0
        df = df.withColumn(c, F.abs(F.coalesce(_q(c), F.lit(float(m)))))
    df = df.withColumn("tenure", F.when(F.col("tenure") == 0, F.lit(1.0)).otherwise(F.col("tenure")))
    return df.na.drop(how="all")


def _features(df: DataFrame) -> DataFrame:
    """F1 (core form), F7 (one label set), F5, F6 (signed), F2 (total / max)."""
    r = df.agg(F.avg("MonthlyCharges").alias("mm"), F.max("TotalCharges").alias("mx")).first()
    t, m, tot = F.col("tenure"), F.col("MonthlyCharges"), F.col("TotalCharges")
    edges, labels = C.V2_TENURE_GROUPS
    tg = F.when((t >= edges[0]) & (t <= edges[1]), labels[0])
    for i in range(1, len(edges) - 1):
        tg = tg.when((t > edges[i]) & (t <= edges[i + 1]), labels[i])
    tg = tg.when(t > edges[-1], labels[-1])
    mean_m, max_t = r["mm"], r["mx"]
    return df.withColumns({
        "AvgMonthlySpend": FX.clip(tot / (t + 1), 0),
        "TenureGroup": tg,
        "ChargeRatio": m / F.lit(mean_m) if mean_m and mean_m > 0 else F.lit(1.0),
        "ExpectedTotal": m * t,
        "SpendingVariance": tot - m * t,
        "ValueScore": tot / F.lit(max_t) * 100 if max_t and max_t > 0 else F.lit(50.0),
    })


def heuristic_v2(df: DataFrame, max_tenure: float | None) -> DataFrame:
    """.6 short tenure + .4 charge deviation, clipped to [.05, .95]."""
    t = F.col("tenure")
    ts = (F.lit(1.0) - FX.clip(t / F.lit(max_tenure), 0, 1)) if max_tenure else F.lit(0.5)
    cs = FX.clip(F.col("ChargeRatio") - 1, -1, 1) * 0.2 + 0.5
    return df.withColumn("Churn_Prob", FX.clip(ts * 0.6 + cs * 0.4, 0.05, 0.95))
