"""DuckDB SQL for the registered queries (the correctness oracle).

Each string runs on the driver's parquet tables registered as views and
recomputes the same fixture and the same rules independently of Spark.
"""

from __future__ import annotations

from tidemark import config as C
from tidemark.sources.fixtures import AS_OF, CHURN_GAP_DAYS, DAYS_PER_MONTH


def _list(vals) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in vals)


def money_sql(cents: str) -> str:
    return (f"(CAST(({cents}) // 100 AS VARCHAR) || '.' || "
            f"lpad(CAST(({cents}) % 100 AS VARCHAR), 2, '0'))")


def clean_num_sql(x: str) -> str:
    """P6 in DuckDB regex terms."""
    s = f"regexp_replace(regexp_replace(CAST({x} AS VARCHAR), '[₹$€£¥]', '', 'g'), '\\s+', '', 'g')"
    fixed = (f"CASE WHEN regexp_full_match({s}, '\\d{{1,3}}(\\.\\d{{3}})+(,\\d+)?') "
             f"THEN replace(replace({s}, '.', ''), ',', '.') ELSE replace({s}, ',', '') END")
    return f"TRY_CAST(regexp_replace({fixed}, '[^0-9.\\-]', '', 'g') AS DOUBLE)"


def adaptive_num_sql(x: str) -> str:
    """P7 in DuckDB terms."""
    t = f"regexp_replace(CAST({x} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"
    t = f"(CASE WHEN {t} IN ({_list(C.ADAPTIVE_NULL_TOKENS)}) THEN NULL ELSE {t} END)"
    t = f"regexp_replace(regexp_replace({t}, '[$€£¥₹,]', '', 'g'), '%$', '')"
    return f"TRY_CAST({t} AS DOUBLE)"


def reparse_sql(v: str) -> str:
    """P10 trap on an already numeric value."""
    s = f"CAST({v} AS VARCHAR)"
    return (f"(CASE WHEN {v} IS NULL OR isnan({v}) OR isinf({v}) THEN NULL "
            f"WHEN abs({v}) > 0 AND abs({v}) < 1e-4 THEN NULL "
            f"WHEN {v} >= 0.001 AND {v} < 1000 AND regexp_full_match({s}, '\\d{{1,3}}\\.\\d{{3}}') "
            f"THEN TRY_CAST(replace({s}, '.', '') AS DOUBLE) ELSE {v} END)")


def np_round_sql(x: str, d: int) -> str:
    """numpy rounding: half-to-even of ``x * 10**d`` on the binary value."""
    scale = float(10 ** d)
    return f"(round_even(({x}) * {scale}, 0) / {scale})"


def clip0(x: str) -> str:
    """pandas ``clip(lower=0)``: NULL stays NULL (``greatest`` would skip it)."""
    return f"(CASE WHEN ({x}) < 0 THEN 0.0 ELSE ({x}) END)"


def history_cte() -> str:
    return f"""
per AS (
  SELECT o_custkey, min(o_orderdate) AS first_order, max(o_orderdate) AS last_order,
         count(*) AS n_orders, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents
  FROM orders GROUP BY o_custkey),
hist AS (
  SELECT c.c_custkey, c.c_acctbal, c.c_mktsegment, p.n_orders, p.cents,
         CAST(floor(date_diff('day', CAST(p.first_order AS DATE), DATE '{AS_OF}') / {DAYS_PER_MONTH}.0) AS BIGINT) AS tenure_m,
         (p.last_order IS NULL OR date_diff('day', CAST(p.last_order AS DATE), DATE '{AS_OF}') > {CHURN_GAP_DAYS}) AS churned
  FROM customer c LEFT JOIN per p ON c.c_custkey = p.o_custkey)"""


def churn_input_cte(with_churn: bool = True) -> str:
    churn = ",\n         CASE WHEN churned THEN 'Yes' ELSE 'No' END AS Churn" if with_churn else ""
    return history_cte() + f""",
churn_input AS (
  SELECT 'C' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS customerID,
         CAST(tenure_m AS VARCHAR) AS tenure,
         {money_sql('cents // greatest(tenure_m, 1)')} AS MonthlyCharges,
         {money_sql('cents')} AS TotalCharges{churn}
  FROM hist)"""


def pct_rank_sql(col: str) -> str:
    """Average-tie percentile rank over the whole relation."""
    return (f"((2 * rank() OVER (ORDER BY {col}) + count(*) OVER (PARTITION BY {col}) - 1) "
            f"/ (2.0 * count({col}) OVER ()))")


def core_ctes(labelled: bool = True, source: str = "SELECT DISTINCT * FROM churn_input", first_release: bool = False) -> str:
    """E1 on the ``churn_input`` fixture: pick, fill, repair, label, features,
    heuristic score, CLV, segment, tier -> CTE ``final``."""
    w = C.HEURISTIC_WEIGHTS
    sw = C.SYNTHETIC_WEIGHTS
    seg = C.SEGMENTS_CORE
    tiers = C.RISK_TIERS
    total = "tc1" if first_release else "greatest(CASE WHEN tc1 < MonthlyCharges THEN tenure * MonthlyCharges ELSE tc1 END, 0)"
    value = "MonthlyCharges * ln(1 + tenure)" if first_release else "ln(1 + TotalCharges)"
    loyalty = "tenure / (MonthlyCharges + 1)" if first_release else "tenure * (TotalCharges / (MonthlyCharges + 1))"
    spread = "MonthlyCharges - AvgMonthlySpend" if first_release else "(MonthlyCharges - AvgMonthlySpend) / (AvgMonthlySpend + 1)"
    # total regressed on features with total itself among them is total
    clv = "TotalCharges" if first_release else "greatest(TotalCharges, 0) * (1 - Churn_Prob)"
    if labelled:
        label = f"""
mapped AS (
  SELECT *, CASE WHEN lower(trim(Churn)) IN ({_list(C.CHURN_YES)}) THEN 1
                 WHEN lower(trim(Churn)) IN ({_list(C.CHURN_NO)}) THEN 0 END AS mc
  FROM repaired),
mode_t AS (SELECT CASE WHEN sum(mc) > count(mc) - sum(mc) THEN 1 ELSE 0 END AS mode_v,
                  1 - count(mc) / count(*) AS null_frac, quantile_cont(tenure, 0.5) AS med_t FROM mapped),
labelled AS (
  SELECT customerID, tenure, MonthlyCharges, TotalCharges,
         CASE WHEN null_frac > {C.UNMAPPED_CHURN_LIMIT} THEN CAST(tenure < med_t AS INTEGER)
              ELSE coalesce(mc, mode_v) END AS Churn
  FROM mapped, mode_t)"""
    else:
        label = f"""
sv AS (
  SELECT *, abs((MonthlyCharges - TotalCharges / (tenure + 1)) / (TotalCharges / (tenure + 1) + 1)) AS svt
  FROM repaired),
risk AS (
  SELECT *, (1.0 - {pct_rank_sql('tenure')}) * {sw['tenure']} + {pct_rank_sql('MonthlyCharges')} * {sw['monthly']}
            + {pct_rank_sql('svt')} * {sw['variance']} + (1.0 - {pct_rank_sql('TotalCharges')}) * {sw['total']} AS risk
  FROM sv),
thr AS (SELECT quantile_cont(risk, {C.SYNTHETIC_CUT_QUANTILE}) AS t FROM risk),
labelled AS (
  SELECT customerID, tenure, MonthlyCharges, TotalCharges, CAST(risk >= t AS INTEGER) AS Churn
  FROM risk, thr)"""
    return f""",
dedup AS ({source}),
picked AS (
  SELECT customerID, {'Churn' if labelled else 'NULL AS Churn'},
         {clip0(reparse_sql(clean_num_sql('tenure')))} AS t0,
         {clip0(reparse_sql(clean_num_sql('MonthlyCharges')))} AS m0,
         {clip0(reparse_sql(clean_num_sql('TotalCharges')))} AS tc0
  FROM dedup),
meds AS (SELECT quantile_cont(t0, 0.5) AS mt, quantile_cont(m0, 0.5) AS mm,
                quantile_cont(tc0, 0.5) AS mtc FROM picked),
filled AS (
  SELECT customerID, Churn,
         coalesce(t0, coalesce(mt, {C.PICK_DEFAULTS['tenure']})) AS tenure,
         coalesce(m0, coalesce(mm, {C.PICK_DEFAULTS['monthly']})) AS MonthlyCharges,
         coalesce(tc0, coalesce(mtc, {C.PICK_DEFAULTS['total']})) AS tc1
  FROM picked, meds),
repaired AS (
  SELECT customerID, Churn, tenure, MonthlyCharges,
         {total} AS TotalCharges
  FROM filled),{label},
feats AS (
  SELECT *, greatest(TotalCharges / (tenure + 1), 0) AS AvgMonthlySpend,
         greatest({value}, 0) AS ValueScore,
         greatest({loyalty}, 0) AS LoyaltyScore
  FROM labelled),
feats2 AS (
  SELECT *, greatest(abs({spread}), 0) AS SpendVariance
  FROM feats),
scored AS (
  SELECT *, {np_round_sql(f"least(greatest((1.0 - {pct_rank_sql('tenure')}) * {w['tenure']} + {pct_rank_sql('MonthlyCharges')} * {w['monthly']} + {pct_rank_sql('SpendVariance')} * {w['variance']}, 0), 1)", 4)} AS Churn_Prob
  FROM feats2),
clv AS (SELECT *, greatest({clv}, 0) AS Predicted_CLV FROM scored),
clv_med AS (SELECT quantile_cont(Predicted_CLV, 0.5) AS mc FROM clv),
final AS (
  SELECT customerID, tenure, MonthlyCharges, TotalCharges, AvgMonthlySpend, ValueScore, LoyaltyScore,
         SpendVariance, Churn, Churn_Prob, Predicted_CLV,
         CASE WHEN Churn_Prob >= {C.HIGH_RISK} AND Predicted_CLV >= mc THEN '{seg[0]}'
              WHEN Churn_Prob >= {C.HIGH_RISK} THEN '{seg[1]}'
              WHEN Predicted_CLV >= mc THEN '{seg[2]}' ELSE '{seg[3]}' END AS Segment,
         CASE WHEN Churn_Prob <= 0.30 THEN '{tiers[0]}' WHEN Churn_Prob <= 0.60 THEN '{tiers[1]}'
              WHEN Churn_Prob <= 1.001 THEN '{tiers[2]}' ELSE '{tiers[0]}' END AS Risk_Tier
  FROM clv, clv_med)"""


def core_final(labelled: bool = True) -> str:
    return "WITH" + churn_input_cte(with_churn=labelled) + core_ctes(labelled)


def core_edges(mapped: bool = True) -> str:
    """E1 on the edge-case file; ``plan`` as its code among the sorted values (missing first)."""
    k = "CAST(substr(customerID, 2) AS BIGINT)"
    label = f"CASE WHEN {k} % 17 = 0 THEN 'maybe' ELSE Churn END" if mapped else f"CASE WHEN {k} % 4 <> 0 THEN 'pending' ELSE Churn END"
    rows = f"""
    SELECT customerID, CASE WHEN {k} % 11 <> 0 THEN tenure END AS tenure, MonthlyCharges,
           CASE WHEN {k} % 13 = 0 THEN '1.00' ELSE TotalCharges END AS TotalCharges, {label} AS Churn,
           CASE WHEN {k} % 7 = 0 THEN NULL WHEN {k} % 7 < 3 THEN 'basic' ELSE 'gold' END AS plan FROM churn_input"""
    edges = f""",
whole AS ({rows}),
twice AS (SELECT * FROM whole UNION ALL SELECT * FROM whole WHERE {k} % 9 = 0
          UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL FROM whole WHERE {k} % 10 = 0),
codes AS (SELECT plan, CAST(row_number() OVER (ORDER BY coalesce(plan, '__missing__')) - 1 AS DOUBLE) AS code
          FROM (SELECT DISTINCT plan FROM twice WHERE customerID IS NOT NULL))"""
    source = "SELECT DISTINCT * FROM twice WHERE customerID IS NOT NULL OR tenure IS NOT NULL OR MonthlyCharges IS NOT NULL OR plan IS NOT NULL"
    return "WITH" + churn_input_cte() + edges + core_ctes(True, source) + """
, plans AS (SELECT w.customerID, c.code AS plan FROM whole w JOIN codes c ON w.plan IS NOT DISTINCT FROM c.plan)"""


def adaptive_edges() -> str:
    """E3 on the edge-case file."""
    k = "CAST(substr(customer_id, 3) AS BIGINT)"
    source = adaptive_input_cte() + f""",
whole AS (
  SELECT customer_id, CASE WHEN {k} % 19 = 0 THEN '-' || account_length WHEN {k} % 23 = 0 THEN '99999' WHEN {k} % 29 <> 0 THEN account_length END AS account_length,
         CASE WHEN {k} % 31 <> 0 THEN mrr END AS mrr, CASE WHEN {k} % 37 = 0 THEN 'N/A' ELSE total_spend END AS total_spend,
         CASE WHEN customer_status IN ('Cancelled', 'inactive', 'Lapsed') THEN 'Yes' ELSE 'no ' END AS gone, plan, balance
  FROM adaptive_input),
edges AS (SELECT * FROM whole UNION ALL SELECT * FROM whole WHERE {k} % 9 = 0)"""
    typed = f"""
  SELECT customer_id, {adaptive_num_sql('account_length')} AS tenure, {adaptive_num_sql('mrr')} AS MonthlyCharges,
         {adaptive_num_sql('total_spend')} AS TotalCharges, gone, plan, {adaptive_num_sql('balance')} AS balance
  FROM edges"""
    churn = f"(CASE WHEN lower(trim(gone)) IN ({_list(C.BINARY_CHURN_POSITIVE)}) THEN 1 ELSE 0 END)"
    return adaptive_final(source=source, typed=typed, churn=churn, passthrough=("gone", "plan", "balance"))


R6 = "(round_even(({c}) * 1000000.0, 0) / 1000000.0) AS {a}"


def r6(c: str, a: str | None = None) -> str:
    return R6.format(c=c, a=a or c)


def adaptive_input_cte() -> str:
    k = "c_custkey"
    return history_cte() + f""",
adaptive_input AS (
  SELECT 'U-' || CAST({k} AS VARCHAR) AS customer_id,
         CAST(tenure_m AS VARCHAR) AS account_length,
         '$' || {money_sql('cents // greatest(tenure_m, 1)')} AS mrr,
         {money_sql('cents')} AS total_spend,
         CASE WHEN churned AND {k} % 3 = 0 THEN 'Cancelled' WHEN churned AND {k} % 3 = 1 THEN 'inactive'
              WHEN churned THEN 'Lapsed' WHEN {k} % 2 = 0 THEN 'Active' ELSE 'current customer' END AS customer_status,
         c_mktsegment AS plan,
         (CASE WHEN c_acctbal < 0 THEN '-' ELSE '' END) || {money_sql('abs(CAST(round(c_acctbal * 100) AS BIGINT))')} AS balance
  FROM hist)"""


def status_sql(x: str) -> str:
    tok = f"lower(trim(coalesce(CAST({x} AS VARCHAR), 'nan')))"
    zero = [k for k, v in C.STATUS_MAPPINGS.items() if v == 0]
    one = [k for k, v in C.STATUS_MAPPINGS.items() if v == 1]
    pos = " OR ".join(f"contains({tok}, '{f}')" for f in C.STATUS_ACTIVE_FRAGMENTS)
    neg = " OR ".join(f"contains({tok}, '{f}')" for f in C.STATUS_CHURN_FRAGMENTS)
    return (f"(CASE WHEN {tok} IN ({_list(zero)}) THEN 0 WHEN {tok} IN ({_list(one)}) THEN 1 "
            f"WHEN {pos} THEN 0 WHEN {neg} THEN 1 ELSE 0 END)")


def _charge_ctes(src: str, col: str, tag: str) -> str:
    return f"""
{tag}a AS (SELECT * REPLACE (CASE WHEN {col} < 0 THEN -{col} ELSE {col} END AS {col}) FROM {src}),
{tag}s AS (SELECT greatest(0, quantile_cont({col}, 0.25) - 3 * (quantile_cont({col}, 0.75) - quantile_cont({col}, 0.25))) AS lo_{tag},
                 quantile_cont({col}, 0.75) + 3 * (quantile_cont({col}, 0.75) - quantile_cont({col}, 0.25)) AS hi_{tag},
                 count(*) AS n_{tag} FROM {tag}a),
{tag}e AS (SELECT count(*) FILTER (WHERE {col} > hi_{tag} OR {col} < lo_{tag}) AS e_{tag} FROM {tag}a, {tag}s),
{tag} AS (SELECT * EXCLUDE (lo_{tag}, hi_{tag}, n_{tag}, e_{tag}) REPLACE (
    CASE WHEN hi_{tag} > lo_{tag} * 100 AND e_{tag} > 0 AND e_{tag} < n_{tag} * 0.1
         THEN (CASE WHEN {col} > hi_{tag} THEN hi_{tag} WHEN {col} < lo_{tag} THEN lo_{tag} ELSE {col} END)
         ELSE {col} END AS {col}) FROM {tag}a, {tag}s, {tag}e)"""


def adaptive_final(source: str | None = None, typed: str | None = None, churn: str | None = None,
                   id_col: str = "customer_id",
                   passthrough: tuple = ("CustomerStatus", "plan", "balance")) -> str:
    """E3 with the heuristic scorer and heuristic CLV. Defaults describe the
    adaptive fixture; ``source``/``typed``/``churn``/``passthrough`` describe
    another input (``typed`` must yield tenure, MonthlyCharges, TotalCharges)."""
    source = source if source is not None else adaptive_input_cte()
    typed = typed if typed is not None else f"""
  SELECT customer_id, {adaptive_num_sql('account_length')} AS tenure, {adaptive_num_sql('mrr')} AS MonthlyCharges,
         {adaptive_num_sql('total_spend')} AS TotalCharges, customer_status AS CustomerStatus, plan,
         {adaptive_num_sql('balance')} AS balance
  FROM adaptive_input"""
    churn = churn if churn is not None else status_sql("CustomerStatus")
    keep = ", ".join((id_col,) + tuple(passthrough))
    seg = C.SEGMENTS_ADAPTIVE
    rec = C.RECOMMENDATIONS
    groups = []
    for limit, edges, labels in C.TENURE_GROUPS:
        parts = [f"WHEN tenure >= {edges[0]} AND tenure <= {edges[1]} THEN '{labels[0]}'"]
        for i in range(1, len(edges) - 1):
            parts.append(f"WHEN tenure > {edges[i]} AND tenure <= {edges[i + 1]} THEN '{labels[i]}'")
        parts.append(f"WHEN tenure > {edges[-1]} THEN '{labels[-1]}'")
        groups.append((limit, "CASE " + " ".join(parts) + " END"))
    tg = (f"CASE WHEN mxt <= {groups[0][0]} THEN {groups[0][1]} WHEN mxt <= {groups[1][0]} "
          f"THEN {groups[1][1]} ELSE {groups[2][1]} END")
    return "WITH" + source + f""",
typed AS ({typed}),
st AS (SELECT *, {churn} AS Churn FROM typed),
t1 AS (SELECT * REPLACE (CASE WHEN tenure < 0 THEN -tenure ELSE tenure END AS tenure) FROM st),
t1s AS (SELECT quantile_cont(tenure, 0.5) FILTER (WHERE NOT tenure > 600) AS med_rest FROM t1),
t2 AS (SELECT * EXCLUDE (med_rest) REPLACE (CASE WHEN tenure > 600 THEN coalesce(med_rest, 24) ELSE tenure END AS tenure) FROM t1, t1s),
t2s AS (SELECT quantile_cont(tenure, 0.5) AS med2, max(tenure) AS mx2 FROM t2),
t3 AS (SELECT * EXCLUDE (med2, mx2) REPLACE (CASE WHEN med2 > 365 THEN tenure / 30
                WHEN med2 > 50 AND mx2 < 100 AND mx2 <= 80 THEN tenure * 12 ELSE tenure END AS tenure) FROM t2, t2s),
{_charge_ctes('t3', 'MonthlyCharges', 'cm').lstrip()},
{_charge_ctes('cm', 'TotalCharges', 'ct').lstrip()},
meds AS (SELECT quantile_cont(tenure, 0.5) AS m1, quantile_cont(MonthlyCharges, 0.5) AS m2,
                quantile_cont(TotalCharges, 0.5) AS m3 FROM ct),
cl AS (
  SELECT DISTINCT {keep},
         CAST(coalesce(Churn, 0) > 0 AS INTEGER) AS Churn,
         greatest(abs(coalesce(tenure, CASE WHEN m1 IS NULL OR m1 <= 0 THEN 1.0 ELSE m1 END)), 1) AS tenure,
         abs(coalesce(MonthlyCharges, CASE WHEN m2 IS NULL OR m2 <= 0 THEN 50.0 ELSE m2 END)) AS MonthlyCharges,
         abs(coalesce(TotalCharges, CASE WHEN m3 IS NULL OR m3 <= 0 THEN 50.0 ELSE m3 END)) AS TotalCharges
  FROM ct, meds),
fs AS (SELECT max(tenure) AS mxt, avg(MonthlyCharges) AS mean_m FROM cl),
f1 AS (
  SELECT cl.*, greatest(TotalCharges / greatest(tenure, 1), 0) AS AvgMonthlySpend,
         {tg} AS TenureGroup,
         CASE WHEN mean_m > 0 THEN MonthlyCharges / mean_m ELSE 1.0 END AS ChargeRatio,
         MonthlyCharges * tenure AS ExpectedTotal,
         abs(TotalCharges - MonthlyCharges * tenure) AS SpendingVariance
  FROM cl, fs),
p99 AS (SELECT quantile_cont(SpendingVariance, 0.99) AS pv, quantile_cont(TotalCharges, 0.99) AS pt FROM f1),
f2 AS (
  SELECT f1.*, CASE WHEN pv > 0 THEN 1.0 - least(greatest(SpendingVariance / pv, 0), 1) ELSE 1.0 END AS SpendingConsistency,
         CASE WHEN pt > 0 THEN least(greatest(TotalCharges / pt * 100, 0), 100) ELSE 50.0 END AS ValueScore
  FROM f1, p99),
hs AS (SELECT quantile_cont(greatest(tenure, 1), 0.95) AS mt, quantile_cont(abs(ChargeRatio - 1), 0.95) AS md,
              count(DISTINCT Churn) AS k, avg(Churn) AS rate FROM f2),
h1 AS (
  SELECT f2.*, k, rate,
         0.5 + (CASE WHEN mt > 0 THEN (1.0 - least(greatest(greatest(tenure, 1) / mt, 0), 1)) * 0.25 ELSE 0 END)
             + (CASE WHEN md > 0 THEN least(greatest(abs(ChargeRatio - 1) / md, 0), 1) * 0.15 ELSE 0 END)
             + (1.0 - SpendingConsistency) * 0.1 AS score
  FROM f2, hs),
h2 AS (
  SELECT * EXCLUDE (k, rate, score),
         least(greatest(CASE WHEN k > 1 THEN {pct_rank_sql('score')} * rate * 2 ELSE score END, 0.05), 0.95) AS Churn_Prob
  FROM h1),
v AS (SELECT *, MonthlyCharges * 24 * (1.0 - Churn_Prob * 0.5) AS Predicted_CLV FROM h2),
th AS (SELECT quantile_cont(Churn_Prob, 0.7) AS pc, quantile_cont(Predicted_CLV, 0.5) AS vc FROM v),
sg AS (
  SELECT v.*, Predicted_CLV AS Future_CLV,
         CASE WHEN Churn_Prob > pc AND Predicted_CLV > vc THEN '{seg[0]}' WHEN Churn_Prob > pc THEN '{seg[1]}'
              WHEN Predicted_CLV > vc THEN '{seg[2]}' ELSE '{seg[3]}' END AS Segment,
         ({pct_rank_sql('Churn_Prob')} * 0.6 + {pct_rank_sql('Predicted_CLV')} * 0.4) * 100 AS Priority
  FROM v, th),
final AS (
  SELECT *, CASE WHEN Segment = '{seg[0]}' AND Churn_Prob > 0.8 THEN '{rec['hh_urgent']}'
                 WHEN Segment = '{seg[0]}' THEN '{rec['hh']}'
                 WHEN Segment = '{seg[1]}' AND Churn_Prob > 0.8 THEN '{rec['hl_urgent']}'
                 WHEN Segment = '{seg[1]}' THEN '{rec['hl']}'
                 WHEN Segment = '{seg[2]}' THEN '{rec['lh']}' ELSE '{rec['ll']}' END AS Recommendation
  FROM sg)"""


def v2_num_sql(x: str) -> str:
    t = f"regexp_replace(CAST({x} AS VARCHAR), '^\\s+|\\s+$', '', 'g')"
    t = f"(CASE WHEN {t} IN ({_list(C.V2_NULL_TOKENS)}) THEN NULL ELSE {t} END)"
    return f"TRY_CAST(regexp_replace({t}, '[$,%]', '', 'g') AS DOUBLE)"


def v2_final() -> str:
    """Release 2.0 of the adaptive lineage on the adaptive fixture (heuristic
    scorer, heuristic value)."""
    edges, labels = C.V2_TENURE_GROUPS
    tg = [f"WHEN tenure >= {edges[0]} AND tenure <= {edges[1]} THEN '{labels[0]}'"]
    for i in range(1, len(edges) - 1):
        tg.append(f"WHEN tenure > {edges[i]} AND tenure <= {edges[i + 1]} THEN '{labels[i]}'")
    tg.append(f"WHEN tenure > {edges[-1]} THEN '{labels[-1]}'")
    seg = C.SEGMENTS_ADAPTIVE
    return "WITH" + adaptive_input_cte() + f""",
typed AS (
  SELECT customer_id, {v2_num_sql('account_length')} AS tenure, {v2_num_sql('mrr')} AS mrr,
         {v2_num_sql('total_spend')} AS TotalCharges, customer_status AS Churn, plan,
         {v2_num_sql('balance')} AS balance
  FROM adaptive_input),
pickm AS (SELECT quantile_cont(mrr, 0.5) AS m_mrr, quantile_cont(TotalCharges, 0.5) AS m_tot,
                 quantile_cont(balance, 0.5) AS m_bal FROM typed),
inf AS (
  SELECT typed.*, CASE WHEN m_mrr BETWEEN 10 AND 500 THEN mrr WHEN m_tot BETWEEN 10 AND 500 THEN TotalCharges
                       WHEN m_bal BETWEEN 10 AND 500 THEN balance ELSE 50.0 END AS MonthlyCharges
  FROM typed, pickm),
meds AS (SELECT quantile_cont(tenure, 0.5) AS m1, quantile_cont(MonthlyCharges, 0.5) AS m2,
                quantile_cont(TotalCharges, 0.5) AS m3 FROM inf),
cl AS (
  SELECT DISTINCT customer_id, mrr, plan, balance,
         CAST(CAST(coalesce(TRY_CAST(Churn AS DOUBLE), 0) AS INTEGER) > 0 AS INTEGER) AS Churn,
         CASE WHEN abs(coalesce(tenure, coalesce(m1, 1.0))) = 0 THEN 1.0
              ELSE abs(coalesce(tenure, coalesce(m1, 1.0))) END AS tenure,
         abs(coalesce(MonthlyCharges, coalesce(m2, 50.0))) AS MonthlyCharges,
         abs(coalesce(TotalCharges, coalesce(m3, 50.0))) AS TotalCharges
  FROM inf, meds),
fs AS (SELECT avg(MonthlyCharges) AS mm, max(TotalCharges) AS mx, max(tenure) AS mt FROM cl),
f AS (
  SELECT cl.*, greatest(TotalCharges / (tenure + 1), 0) AS AvgMonthlySpend,
         CASE {" ".join(tg)} END AS TenureGroup,
         CASE WHEN mm > 0 THEN MonthlyCharges / mm ELSE 1.0 END AS ChargeRatio,
         MonthlyCharges * tenure AS ExpectedTotal,
         TotalCharges - MonthlyCharges * tenure AS SpendingVariance,
         CASE WHEN mx > 0 THEN TotalCharges / mx * 100 ELSE 50.0 END AS ValueScore, mt
  FROM cl, fs),
h AS (
  SELECT * EXCLUDE (mt),
         least(greatest((1.0 - least(greatest(tenure / mt, 0), 1)) * 0.6
                        + (least(greatest(ChargeRatio - 1, -1), 1) * 0.2 + 0.5) * 0.4, 0.05), 0.95) AS Churn_Prob
  FROM f),
v AS (SELECT *, MonthlyCharges * 24 AS Predicted_CLV FROM h),
th AS (SELECT quantile_cont(Churn_Prob, 0.7) AS pc, quantile_cont(Predicted_CLV, 0.5) AS vc FROM v),
final AS (
  SELECT v.*,
         CASE WHEN Churn_Prob > pc AND Predicted_CLV > vc THEN '{seg[0]}' WHEN Churn_Prob > pc THEN '{seg[1]}'
              WHEN Predicted_CLV > vc THEN '{seg[2]}' ELSE '{seg[3]}' END AS Segment,
         {pct_rank_sql('(Churn_Prob * Predicted_CLV)')} * 100 AS Priority
  FROM v, th)"""


def events_input_cte() -> str:
    from tidemark.sources.fixtures import ACTIVE_SINCE
    cents = "CAST(round(value * 100) AS BIGINT)"
    return f"""
eper AS (
  SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_events,
         count(*) FILTER (WHERE event_type = 'error') AS n_errors,
         sum(CASE WHEN event_type = 'purchase' THEN {cents} ELSE 0 END) AS purchase_cents,
         sum({cents}) AS value_cents
  FROM events GROUP BY user_id),
events_input AS (
  SELECT 'E' || CAST(user_id AS VARCHAR) AS user_id,
         CAST(date_diff('day', CAST(first_ts AS DATE), CAST(last_ts AS DATE)) AS VARCHAR) AS days_as_customer,
         {money_sql('purchase_cents')} AS monthly_spend,
         {money_sql('value_cents')} AS lifetime_value,
         CASE WHEN CAST(last_ts AS DATE) >= DATE '{ACTIVE_SINCE}' THEN 'yes' ELSE 'no' END AS is_active,
         CAST(n_events AS VARCHAR) AS event_count, CAST(n_errors AS VARCHAR) AS error_count,
         CAST(floor((epoch(last_ts) - epoch(first_ts)) / 3600) AS BIGINT)::VARCHAR AS active_hours
  FROM eper)"""


def tenure_inference_sql(src: str, cands: list[str]) -> str:
    """D4 for tenure in SQL: score every candidate from its statistics, keep
    the first best one when it scores above 0.5."""
    scores = []
    for c in cands:
        name = 0.4 if any(h in c.lower() for h in C.TENURE_HINTS) else 0.0
        scores.append(
            f"(((({name} + CASE WHEN min({c}) >= 0 AND max({c}) <= 600 AND quantile_cont({c}, 0.5) BETWEEN 1 AND 120 "
            f"THEN 0.3 ELSE 0 END) + CASE WHEN avg(CASE WHEN {c} IS NULL THEN NULL WHEN {c} = floor({c}) THEN 1.0 ELSE 0.0 END) > 0.9 "
            f"THEN 0.2 ELSE 0 END) + CASE WHEN stddev_samp({c}) > 1 THEN 0.1 ELSE 0 END)) AS s_{c}")
    pick = " ".join(
        f"WHEN s_{c} > 0.5 AND s_{c} = mx AND {' AND '.join(f's_{c} > s_{d}' for d in cands[:i]) or 'TRUE'} THEN '{c}'"
        for i, c in enumerate(cands))
    return f"""
d4s AS (SELECT {', '.join(scores)} FROM {src}),
d4 AS (SELECT *, CASE {pick} END AS best FROM (SELECT *, greatest({', '.join(f's_{c}' for c in cands)}) AS mx FROM d4s))"""
