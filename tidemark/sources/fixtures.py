"""Customer files derived from the driver's parquet tables.

The reference reads one customer file as text. These builders produce such a
file from ``customer`` and ``orders`` with Spark, so every query's work grows
with the tables. Money is carried as integer cents and printed by integer
arithmetic, so the text is identical in any engine.

Scale notes: ``orders`` is pre-aggregated per customer (map-side partial
aggregation, so a customer holding a third of all orders is one row per map
task) and the result, already hash-partitioned by customer key, joins
``customer`` with only the customer side shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES: fixture parameters.
AS_OF = "2001-08-01"     # last order date in the driver data
CHURN_GAP_DAYS = 180     # no order in this many days -> churned
DAYS_PER_MONTH = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def money_text(cents: F.Column) -> F.Column:
    """Integer cents (>= 0) -> ``1234.56``."""
    return F.concat((cents / 100).cast("long").cast("string"), F.lit("."),
                    F.lpad((cents % 100).cast("string"), 2, "0"))


def customer_history(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    """One row per customer: first/last order, order count and spend in cents."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    per = orders.groupBy("o_custkey").agg(
        F.min("o_orderdate").alias("first_order"),
        F.max("o_orderdate").alias("last_order"),
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"),
    )
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    day = F.lit(as_of).cast("date")
    j = cust.join(per, cust.c_custkey == per.o_custkey, "left")
    tenure = F.floor(F.datediff(day, F.col("first_order").cast("date")) / DAYS_PER_MONTH)
    churned = F.col("last_order").isNull() | (
        F.datediff(day, F.col("last_order").cast("date")) > CHURN_GAP_DAYS)
    return j.select(
        "c_custkey", "c_acctbal", "c_mktsegment", "n_orders", "cents",
        tenure.cast("long").alias("tenure_m"),
        churned.alias("churned"),
    )


def churn_input(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    """FIXTURES ``churn_input``: the core customer file, every column text."""
    h = customer_history(spark, sf_dir, as_of)
    monthly_cents = F.expr("cents div greatest(tenure_m, 1)")
    return h.select(
        F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("customerID"),
        F.col("tenure_m").cast("string").alias("tenure"),
        money_text(monthly_cents).alias("MonthlyCharges"),
        money_text(F.col("cents")).alias("TotalCharges"),
        F.when(F.col("churned"), "Yes").otherwise("No").alias("Churn"),
    )


def churn_unlabelled(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    """FIXTURES ``churn_unlabelled``: the same file without a churn column."""
    return churn_input(spark, sf_dir, as_of).drop("Churn")


def churn_edges(spark: SparkSession, sf_dir: str, mapped: bool = True) -> DataFrame:
    """The core customer file as users have it: padded names, an ``Unnamed`` index, an empty column,
    blank rows, rows twice, missing tenure, totals below a month's charge, a text column to encode and
    labels that no rule knows (a few, or with ``mapped=False`` three in four)."""
    base = churn_input(spark, sf_dir).withColumn("k", F.expr("cast(substring(customerID, 2) as long)"))
    known = F.when(F.col("k") % 17 == 0, "maybe") if mapped else F.when(F.col("k") % 4 != 0, "pending")
    rows = base.select(
        "k", F.col("customerID").alias(" customerID"), F.when(F.col("k") % 11 != 0, F.col("tenure")).alias("tenure "),
        "MonthlyCharges", F.when(F.col("k") % 13 == 0, "1.00").otherwise(F.col("TotalCharges")).alias("TotalCharges"),
        known.otherwise(F.col("Churn")).alias("Churn"),
        F.when(F.col("k") % 7 == 0, F.lit(None)).when(F.col("k") % 7 < 3, "basic").otherwise("gold").alias("plan"),
        F.lit(None).cast("string").alias("empty"))
    again = rows.filter("k % 9 = 0")
    blank = rows.filter("k % 10 = 0").select("k", *[F.lit(None).cast("string").alias(c) for c in rows.columns[1:]])
    parts = [d.withColumn("Unnamed: 0", F.concat(F.lit(tag), F.col("k").cast("string"))) for tag, d in (("a", rows), ("b", again), ("c", blank))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).drop("k")


def adaptive_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adaptive file as users have it: blank rows, rows twice, an empty column, negative and impossible
    tenure, missing amounts, and churn only as a yes/no column of an unknown name."""
    base = adaptive_input(spark, sf_dir).withColumn("k", F.expr("cast(substring(customer_id, 3) as long)"))
    tenure = (F.when(F.col("k") % 19 == 0, F.concat(F.lit("-"), F.col("account_length"))).when(F.col("k") % 23 == 0, "99999")
              .when(F.col("k") % 29 != 0, F.col("account_length")))
    rows = base.select(
        "k", F.col("customer_id").alias(" customer_id "), tenure.alias("account_length\t"),
        F.when(F.col("k") % 31 != 0, F.col("mrr")).alias("mrr"), F.when(F.col("k") % 37 == 0, "N/A").otherwise(F.col("total_spend")).alias("total_spend"),
        F.when(F.col("customer_status").isin("Cancelled", "inactive", "Lapsed"), "Yes").otherwise("no ").alias("gone"),
        "plan", "balance", F.lit(None).cast("string").alias("nothing"))
    again = rows.filter("k % 9 = 0")
    blank = rows.filter("k % 10 = 0").select("k", *[F.lit(None).cast("string").alias(c) for c in rows.columns[1:]])
    return rows.unionByName(again).unionByName(blank).drop("k")


def adaptive_input(spark: SparkSession, sf_dir: str, as_of: str = AS_OF) -> DataFrame:
    """A customer file named the adaptive way (synonyms, status text, $ amounts).

    ``account_length`` -> tenure, ``mrr`` -> MonthlyCharges, ``total_spend`` ->
    TotalCharges, ``customer_status`` -> CustomerStatus (status text mapped to
    churn), plus a plan segment and the account balance as extra columns.
    """
    h = customer_history(spark, sf_dir, as_of)
    monthly_cents = F.expr("cents div greatest(tenure_m, 1)")
    key = F.col("c_custkey")
    status = (F.when(F.col("churned") & (key % 3 == 0), "Cancelled")
              .when(F.col("churned") & (key % 3 == 1), "inactive")
              .when(F.col("churned"), "Lapsed")
              .when(key % 2 == 0, "Active")
              .otherwise("current customer"))
    return h.select(
        F.concat(F.lit("U-"), key.cast("string")).alias("customer_id"),
        F.col("tenure_m").cast("string").alias("account_length"),
        F.concat(F.lit("$"), money_text(monthly_cents)).alias("mrr"),
        money_text(F.col("cents")).alias("total_spend"),
        status.alias("customer_status"),
        F.col("c_mktsegment").alias("plan"),
        F.concat(F.when(F.col("c_acctbal") < 0, "-").otherwise(""),
                 money_text(F.abs(F.round(F.col("c_acctbal") * 100).cast("long")))).alias("balance"),
    )


def _grouped(int_part: F.Column, sep: str) -> F.Column:
    """Thousands grouping for values below one million."""
    return F.when(int_part >= 1000, F.concat((int_part / 1000).cast("long").cast("string"), F.lit(sep),
                                             F.lpad((int_part % 1000).cast("string"), 3, "0"))
                  ).otherwise(int_part.cast("string"))


def dirty_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES ``dirty_numbers``: account balances written five ways.

    By ``c_custkey % 5``: plain ``1234.56``, US ``$1,234.56``, European
    ``1.234,56``, Indian-style ``1,234.56`` with a rupee sign, and ``N/A``.
    Every row is kept; the key only chooses the format.
    """
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    cents = F.abs(F.round(F.col("c_acctbal") * 100).cast("long"))
    sign = F.when(F.col("c_acctbal") < 0, "-").otherwise("")
    ip = (cents / 100).cast("long")
    frac = F.lpad((cents % 100).cast("string"), 2, "0")
    fmt = F.col("c_custkey") % 5
    text = (F.when(fmt == 0, F.concat(sign, ip.cast("string"), F.lit("."), frac))
            .when(fmt == 1, F.concat(sign, F.lit("$"), _grouped(ip, ","), F.lit("."), frac))
            .when(fmt == 2, F.concat(sign, _grouped(ip, "."), F.lit(","), frac))
            .when(fmt == 3, F.concat(F.lit("₹ "), sign, _grouped(ip, ","), F.lit("."), frac))
            .otherwise(F.lit("N/A")))
    return cust.select("c_custkey", text.alias("balance"))


# FIXED VALUES: events fixture parameter.
ACTIVE_SINCE = "2024-01-28"   # a last event on or after this day counts as active


def events_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A per-user customer file from ``events`` (every column text).

    ``days_as_customer`` (a days synonym, so tenure has to be inferred from
    values), ``monthly_spend`` (purchase value), ``lifetime_value`` (all
    value), ``is_active`` (inverted churn), and three plain counts that feed
    the isolation forest. ``events`` is aggregated per user with map-side
    partial aggregation; nothing is joined.
    """
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", "value")
    cents = F.round(F.col("value") * 100).cast("long")
    per = ev.groupBy("user_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("event_type") == "error").alias("n_errors"),
        F.sum(F.when(F.col("event_type") == "purchase", cents).otherwise(F.lit(0))).alias("purchase_cents"),
        F.sum(cents).alias("value_cents"),
    )
    secs = F.unix_timestamp("last_ts") - F.unix_timestamp("first_ts")
    return per.select(
        F.concat(F.lit("E"), F.col("user_id").cast("string")).alias("user_id"),
        F.datediff(F.col("last_ts").cast("date"), F.col("first_ts").cast("date")).cast("string")
        .alias("days_as_customer"),
        money_text(F.col("purchase_cents")).alias("monthly_spend"),
        money_text(F.col("value_cents")).alias("lifetime_value"),
        F.when(F.col("last_ts").cast("date") >= F.lit(ACTIVE_SINCE).cast("date"), "yes").otherwise("no")
        .alias("is_active"),
        F.col("n_events").cast("string").alias("event_count"),
        F.col("n_errors").cast("string").alias("error_count"),
        F.floor(secs / 3600).cast("long").cast("string").alias("active_hours"),
    )
