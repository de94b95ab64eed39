"""Fixed values.

Everything in this module is a value that has to equal the behaviour being
reproduced (keyword lists, token sets, thresholds, labels) for the results to
match. They are stated plainly and in their natural order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES -- core lineage
# ---------------------------------------------------------------------------

LABEL_ENC_MAX = 20          # most distinct strings a column may have to be label-encoded
LABEL_ENC_MAX_OLD = 25      # same limit in the first three releases
MIN_ROWS_FOR_ML = 20
NUMERIC_ADOPT_RATIO = 0.40  # core: a column becomes numeric if >= 40% parses
ADAPTIVE_ADOPT_RATIO = 0.5  # adaptive: strictly more than half must parse

# Role keywords, most specific first (keyword order outranks column order).
ROLE_KEYWORDS = {
    "churn": ["churn", "attrition", "churned", "leave", "exit", "cancel", "left", "status"],
    "tenure": ["tenure", "seniority", "duration", "period", "months", "age"],
    "monthly": ["monthlycharge", "monthlyfee", "monthly", "charge", "rate", "fee", "price",
                "subscription"],
    "total": ["totalcharge", "totalrevenue", "lifetimevalue", "total", "revenue", "bill",
              "spend", "amount", "sales", "ltv"],
    "id": ["customerid", "custid", "userid", "accountid", "clientid", "memberid", "id"],
}
ROLE_PRIORITY = ["churn", "tenure", "monthly", "total", "id"]

# Defaults used when a role has no column at all.
PICK_DEFAULTS = {"tenure": 12.0, "monthly": 500.0, "total": 6000.0}

CHURN_YES = ["yes", "y", "true", "1", "1.0", "churned", "left", "cancelled", "cancel", "exit",
             "quit", "inactive", "lost", "gone", "departed", "attrited", "closed"]
CHURN_NO = ["no", "n", "false", "0", "0.0", "active", "retained", "stay", "stayed", "current",
            "existing", "ongoing", "present", "alive", "good", "loyal"]

UNMAPPED_CHURN_LIMIT = 0.60   # more unmapped than this -> synthetic label
SYNTHETIC_CUT_QUANTILE = 0.65  # top 35% of the synthetic risk score are churners
SYNTHETIC_WEIGHTS = {"tenure": 0.40, "monthly": 0.30, "variance": 0.20, "total": 0.10}
HEURISTIC_WEIGHTS = {"tenure": 0.55, "monthly": 0.25, "variance": 0.20}

HIGH_RISK = 0.60
MEDIUM_RISK = 0.30
RED_ROW = 0.80
TOP_RISK_ROWS = 1000

SEGMENTS_CORE = ["High Risk – High Value", "High Risk – Low Value",
                 "Low Risk – High Value", "Low Risk – Low Value"]
RISK_TIERS = ["Low Risk (0-30%)", "Medium Risk (30-60%)", "High Risk (60-100%)"]
RISK_TIER_EDGES = [0.0, 0.30, 0.60, 1.001]

CORE_FEATURES = ["tenure", "MonthlyCharges", "TotalCharges", "AvgMonthlySpend", "ValueScore",
                 "LoyaltyScore", "SpendVariance"]
PROCESSED_COLUMNS = ["tenure", "MonthlyCharges", "TotalCharges", "AvgMonthlySpend",
                     "ValueScore", "LoyaltyScore", "SpendVariance", "Churn", "Churn_Prob",
                     "Predicted_CLV", "Segment", "Risk_Tier"]
SAFE_CUT_BINS = 6
ALL_VALUES_LABEL = "All Values"

# Encodings and separators tried by the core loader, in order.
CORE_ENCODINGS = ["utf-8-sig", "utf-8", "latin1", "cp1252", "iso-8859-1", "utf-16"]
CORE_SEPARATORS = [None, ",", ";", "\t", "|", ":"]

# Random forest / boosting settings of the core lineage.
CORE_RF = {"numTrees": 300, "maxDepth": 12}
CORE_GBT = {"maxIter": 150, "maxDepth": 5}
SEED = 42

# ---------------------------------------------------------------------------
# FIXED VALUES -- adaptive lineage
# ---------------------------------------------------------------------------

ADAPTIVE_MIN_ROWS = 3
# FIXED VALUES: cell texts that a table reader takes as missing.
NA_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
            "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
ADAPTIVE_ENCODINGS = ["utf-8", "latin-1", "cp1252", "iso-8859-1", "utf-16", "ascii", "utf-8-sig"]
ADAPTIVE_DELIMITERS = [",", ";", "\t", "|", ":"]
DELIMITER_SAMPLE_BYTES = 16384

MOST_TENURE = 600   # months

# Name synonyms (lower-case key -> canonical name), in their natural order.
COLUMN_MAPPINGS = {
    "tenure": "tenure", "tenure_months": "tenure", "customer_tenure": "tenure",
    "months": "tenure", "duration": "tenure", "time_as_customer": "tenure",
    "account_length": "tenure", "customer_age_months": "tenure", "loyalty_months": "tenure",
    "months_as_customer": "tenure", "subscription_length": "tenure",
    "membership_duration": "tenure", "account_age": "tenure", "customer_since_months": "tenure",
    "service_tenure": "tenure", "tenure_days": "tenure_days", "tenure_years": "tenure_years",
    "days_as_customer": "tenure_days", "years_as_customer": "tenure_years",
    "customer_lifetime_days": "tenure_days",
    "monthlycharges": "MonthlyCharges", "monthly_charges": "MonthlyCharges",
    "monthly_charge": "MonthlyCharges", "monthly_fee": "MonthlyCharges",
    "monthly_payment": "MonthlyCharges", "monthly_amount": "MonthlyCharges",
    "monthly_spend": "MonthlyCharges", "monthly_bill": "MonthlyCharges",
    "monthly_cost": "MonthlyCharges", "recurring_charge": "MonthlyCharges",
    "mrr": "MonthlyCharges", "monthly_revenue": "MonthlyCharges",
    "subscription_fee": "MonthlyCharges", "plan_price": "MonthlyCharges",
    "monthly_rate": "MonthlyCharges", "billing_amount": "MonthlyCharges",
    "avg_monthly_spend": "MonthlyCharges", "average_monthly_charge": "MonthlyCharges",
    "annual_charges": "AnnualCharges", "yearly_charges": "AnnualCharges",
    "annual_fee": "AnnualCharges", "yearly_fee": "AnnualCharges",
    "annual_payment": "AnnualCharges", "yearly_payment": "AnnualCharges",
    "annual_spend": "AnnualCharges", "yearly_spend": "AnnualCharges",
    "arr": "AnnualCharges", "annual_revenue": "AnnualCharges",
    "totalcharges": "TotalCharges", "total_charges": "TotalCharges",
    "total_charge": "TotalCharges", "total_payment": "TotalCharges",
    "lifetime_value": "TotalCharges", "total_spend": "TotalCharges",
    "total_amount": "TotalCharges", "cumulative_charges": "TotalCharges",
    "total_revenue": "TotalCharges", "customer_value": "TotalCharges",
    "ltv": "TotalCharges", "clv": "TotalCharges", "cltv": "TotalCharges",
    "total_billings": "TotalCharges", "all_time_spend": "TotalCharges",
    "cumulative_spend": "TotalCharges", "historical_charges": "TotalCharges",
    "churn": "Churn", "churned": "Churn", "is_churn": "Churn",
    "has_churned": "Churn", "customer_churn": "Churn", "attrition": "Churn",
    "left": "Churn", "exited": "Churn", "cancelled": "Churn",
    "terminated": "Churn", "inactive": "Churn", "lost": "Churn",
    "customer_status": "CustomerStatus", "status": "CustomerStatus",
    "account_status": "CustomerStatus", "subscription_status": "CustomerStatus",
    "active": "Active", "is_active": "Active", "current_customer": "Active",
    "retained": "Active", "is_retained": "Active",
    "payment_status": "PaymentStatus", "billing_status": "PaymentStatus",
    "invoice_status": "PaymentStatus", "transaction_status": "PaymentStatus",
}

# Status text -> churn flag.
STATUS_MAPPINGS = {
    "active": 0, "current": 0, "retained": 0, "staying": 0, "continued": 0,
    "subscribed": 0, "enrolled": 0, "member": 0, "yes_active": 0,
    "in_good_standing": 0, "good": 0, "ok": 0, "valid": 0, "live": 0,
    "churned": 1, "cancelled": 1, "canceled": 1, "terminated": 1,
    "inactive": 1, "left": 1, "exited": 1, "lost": 1, "closed": 1,
    "suspended": 1, "expired": 1, "lapsed": 1, "dormant": 1,
    "unsubscribed": 1, "withdrawn": 1, "dropped": 1,
}
STATUS_ACTIVE_FRAGMENTS = ["activ", "current", "good", "valid"]
STATUS_CHURN_FRAGMENTS = ["churn", "cancel", "termin", "inactiv", "left", "exit"]
ACTIVE_TRUE_TOKENS = ["yes", "true", "1", "active", "y"]

VALIDATE_CHURN_YES = ["yes", "y", "true", "1", "churned", "left", "exited", "cancelled"]
VALIDATE_CHURN_NO = ["no", "n", "false", "0", "stayed", "active", "retained"]
BINARY_CHURN_POSITIVE = ["yes", "y", "true", "1", "churned"]
BINARY_CHURN_NEGATIVE = ["no", "n", "false", "0", "stayed"]

ADAPTIVE_NULL_TOKENS = ["", " ", "NA", "N/A", "null", "NULL", "None", "nan", "NaN", "-", "#N/A",
                        "#REF!", "#VALUE!"]

DOMAIN_PATTERNS = {
    "customer_analytics": ["customer", "subscriber", "member", "client", "user", "account",
                           "churn", "tenure", "monthly", "charges", "subscription", "plan"],
    "hr_payroll": ["employee", "salary", "department", "hire_date", "job_title", "payroll",
                   "benefits", "manager", "performance", "hr"],
    "sales": ["order", "product", "quantity", "price", "discount", "sale", "invoice", "sku",
              "inventory", "shipping"],
    "financial": ["transaction", "balance", "credit", "debit", "interest", "loan", "mortgage",
                  "investment", "portfolio"],
}
RELEVANCE_ID = ["customer", "user", "account", "member", "subscriber", "client", "id"]
RELEVANCE_VALUE = ["charge", "payment", "spend", "revenue", "amount", "price", "fee", "bill",
                   "cost", "value", "salary", "income"]
RELEVANCE_TIME = ["tenure", "month", "day", "year", "date", "time", "duration", "age", "length",
                  "since", "period"]
RELEVANCE_CHURN = ["churn", "status", "active", "cancelled", "terminated", "left", "exited",
                   "attrition", "retained"]

TENURE_HINTS = ["tenure", "month", "duration", "time", "age", "length", "period"]
MONTHLY_HINTS = ["monthly", "charge", "fee", "payment", "bill", "cost", "price", "rate"]
ANNUAL_HINTS = ["annual", "yearly", "total", "lifetime", "cumulative"]
TOTAL_HINTS = ["total", "lifetime", "cumulative", "ltv", "clv", "value", "overall"]

TENURE_GROUPS = [
    (12, [0, 3, 6, 9, 12], ["0-3mo", "3-6mo", "6-9mo", "9-12mo", "12+mo"]),
    (60, [0, 6, 12, 24, 36], ["0-6mo", "6-12mo", "1-2yr", "2-3yr", "3+yr"]),
    (None, [0, 12, 24, 48, 72], ["0-1yr", "1-2yr", "2-4yr", "4-6yr", "6+yr"]),
]

SEGMENTS_ADAPTIVE = ["High Risk - High Value", "High Risk - Low Value",
                     "Low Risk - High Value", "Low Risk - Low Value"]
RECOMMENDATIONS = {
    "hh_urgent": "URGENT: Immediate retention outreach required",
    "hh": "Priority retention program - offer incentives",
    "hl_urgent": "Evaluate cost of retention vs acquisition",
    "hl": "Standard retention communication",
    "lh": "Loyalty program - upsell opportunities",
    "ll": "Monitor - standard engagement",
}
ADAPTIVE_RISK_QUANTILE = 0.7
ADAPTIVE_HIGH_RISK = 0.7
FUTURE_MONTHS = 24
PROB_BINS = [0, 0.2, 0.4, 0.6, 0.8, 1.0]
PROB_BIN_LABELS = ["0-20%", "20-40%", "40-60%", "60-80%", "80-100%"]
QUINTILE_LABELS = ["Very Low", "Low", "Medium", "High", "Very High"]
EXPORT_DROP_COLUMNS = ["ExpectedTotal", "ChargeRatio", "SpendingVariance", "_is_outlier"]
ISOLATION_CONTAMINATION = 0.05
ISOLATION_MIN_ROWS = 50
ADAPTIVE_RF = {"numTrees": 100, "maxDepth": 6}
ADAPTIVE_GBT = {"maxIter": 80, "maxDepth": 4}

# ---------------------------------------------------------------------------
# FIXED VALUES -- adaptive lineage, release 2.0
# ---------------------------------------------------------------------------

V2_NULL_TOKENS = ["", " ", "NA", "N/A", "null", "NULL", "None", "nan", "NaN", "-"]
V2_COLUMN_MAPPINGS = {
    "tenure": "tenure", "tenure_months": "tenure", "customer_tenure": "tenure",
    "months": "tenure", "duration": "tenure", "time_as_customer": "tenure",
    "account_length": "tenure", "customer_age": "tenure", "loyalty_months": "tenure",
    "monthlycharges": "MonthlyCharges", "monthly_charges": "MonthlyCharges",
    "monthly_charge": "MonthlyCharges", "monthly_fee": "MonthlyCharges",
    "monthly_payment": "MonthlyCharges", "monthly_amount": "MonthlyCharges",
    "monthly_spend": "MonthlyCharges", "monthly_bill": "MonthlyCharges",
    "monthly_cost": "MonthlyCharges", "recurring_charge": "MonthlyCharges",
    "totalcharges": "TotalCharges", "total_charges": "TotalCharges",
    "total_charge": "TotalCharges", "total_payment": "TotalCharges",
    "lifetime_value": "TotalCharges", "total_spend": "TotalCharges",
    "total_amount": "TotalCharges", "cumulative_charges": "TotalCharges",
    "total_revenue": "TotalCharges", "customer_value": "TotalCharges",
    "churn": "Churn", "churned": "Churn", "is_churn": "Churn",
    "has_churned": "Churn", "customer_churn": "Churn", "attrition": "Churn",
    "left": "Churn", "exited": "Churn", "cancelled": "Churn",
    "terminated": "Churn", "inactive": "Churn", "lost": "Churn",
    "status": "Churn", "customer_status": "Churn", "active": "Churn",
}
V2_CHURN_KEYWORDS = ["churn", "left", "exit", "attrition", "cancel", "status", "active"]
V2_BINARY_POSITIVE = ["yes", "y", "true", "1", "churned", "left", "exited", "cancelled", "inactive",
                      "lost"]
V2_TENURE_KEYWORDS = ["month", "tenure", "time", "period", "duration", "age", "length", "days",
                      "weeks", "years"]
V2_MONTHLY_KEYWORDS = ["monthly", "charge", "fee", "payment", "price", "amount", "bill", "cost",
                       "rate"]
V2_MONTHLY_EXCLUDE = ["total", "cumulative", "lifetime", "sum"]
V2_TOTAL_KEYWORDS = ["total", "lifetime", "cumulative", "sum", "overall", "aggregate"]
V2_TENURE_GROUPS = ([0, 12, 24, 48, 72], ["0-1yr", "1-2yr", "2-4yr", "4-6yr", "6+yr"])
V2_DEFAULT_TOTAL = 600.0
V2_EXPORT_DROP_COLUMNS = ["ExpectedTotal", "ChargeRatio"]
V2_RF = {"numTrees": 100, "maxDepth": 8, "minInstancesPerNode": 1}
V2_GBT = {"maxIter": 80, "maxDepth": 4}


# FIXED VALUES: quality rules as (limit, penalty) steps, highest limit first.
QUALITY_MISSING_STEPS = ((50, 40), (20, 20), (5, 5))     # percent of cells
QUALITY_DUPLICATE_STEPS = ((30, 15), (10, 5))            # percent of rows
QUALITY_PENALTIES = {"no_numbers": 30, "other_domain": 15, "unknown_domain": 20, "empty_columns": 10, "no_value": 10}
QUALITY_DOMAIN_HITS = 3       # names that settle the domain
QUALITY_NUMERIC_SHARE = 0.3   # parsed share of a possibly numeric column
QUALITY_VALID_SCORE = 30


# FIXED VALUES: evidence from values (D4). A role's score adds the points of every rule that holds: words in the
# name, the bounds of a column's values, share of whole numbers, spread. Of rules in one group the first counts.
VALUE_EVIDENCE = {
    "tenure": [
        {"words": TENURE_HINTS, "points": 0.4},
        {"min": (0, None), "max": (None, 600), "median": (1, 120), "points": 0.3},
        {"whole": (0.9, None), "strict": True, "points": 0.2},
        {"std": (1, None), "strict": True, "points": 0.1},
    ],
    "MonthlyCharges": [
        {"words": MONTHLY_HINTS, "points": 0.3},
        {"words": ANNUAL_HINTS, "points": -0.2},
        {"median": (10, 500), "points": 0.4, "group": "level"},
        {"median": (1, 1000), "points": 0.2, "group": "level"},
        {"broken": (0.1, None), "strict": True, "points": 0.1},
    ],
    "TotalCharges": [
        {"words": TOTAL_HINTS, "points": 0.4},
        {"above_monthly": (0, None), "strict": True, "points": 0.3},
        {"median": (100, 100000), "points": 0.2},
    ],
}
VALUE_EVIDENCE_LIMIT = 0.5
VALUE_EVIDENCE_MONTHS = 3   # a total is more than this many monthly charges
VALUE_EVIDENCE_BARRED = ["tenure", "MonthlyCharges", "TotalCharges", "Churn", "AnnualCharges"]
# defaults of required columns, and the bounds within which a column may stand in
REQUIRED_DEFAULTS = {"tenure": 12.0, "MonthlyCharges": 50.0, "Churn": 0}
STAND_IN_TENURE = (0, 1000)
STAND_IN_MONTHLY = (10, 500)
AMOUNT_CORRELATION_LIMIT = 0.3
