"""A peak rule from transactions to alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.functions.scoring import ratio_score
from txnwatch.operators.alerts import alert_id, enrichment_block, metadata_block, peak_details, trigger_reason
from txnwatch.operators.enrich import first_per_key
from txnwatch.operators.filters import apply_filters
from txnwatch.operators.skew import UNKNOWN, Hot, hot_groups
from txnwatch.operators.threshold import threshold_column
from txnwatch.operators.windows import in_peak_window, peak_windows
from txnwatch.rules import Rule

# Customer columns that alert texts and context blocks may show.
SHOWN = (
    "customer_name", "name", "occupation", "annual_income", "account_type", "customer_type", "risk_score",
    "country", "region",
)


def _customer_columns(rule: Rule, customers: DataFrame) -> list[str]:
    wanted = set(SHOWN)
    threshold = rule.threshold
    for name in (threshold.segment_field, threshold.reference_field):
        wanted.add(name)
    if threshold.formula and "customer." in threshold.formula:
        wanted.update(customers.columns)
    return [c for c in customers.columns if c in wanted and c != "customer_id"]


def scored_windows(
    transactions: DataFrame, customers: DataFrame, rule: Rule, hot: Hot = UNKNOWN
) -> DataFrame:
    """Peak windows that reach the threshold, with the customer columns alerts need."""
    hot = hot_groups(transactions, ["customer_id"]) if hot is UNKNOWN else hot
    kept = apply_filters(transactions, customers, rule.filters, "peak", rule.mapping, hot)
    windows = peak_windows(kept, rule.window_days, rule.function, _value_column(rule, transactions), hot=hot)
    if rule.min_transactions is not None:
        windows = windows.filter(F.col("transaction_count") >= rule.min_transactions)
    columns = _customer_columns(rule, customers)
    # Both sides have one row per customer, so no key can dominate this join.
    single = first_per_key(customers.select("customer_id", *columns), ["customer_id"])
    joined = windows.join(single, "customer_id", "left")
    scored = joined.withColumn("threshold", threshold_column(rule.threshold, columns))
    return scored.filter(F.col("aggregated_value") >= F.col("threshold"))


def _value_column(rule: Rule, transactions: DataFrame) -> str | Column:
    name = rule.resolve(rule.value_field)
    return name if name in transactions.columns else F.lit(0.0)


def peak_alerts(
    transactions: DataFrame, customers: DataFrame, rule: Rule, run_id: str, hot: Hot = UNKNOWN
) -> DataFrame:
    """One alert per customer whose peak window reaches the threshold."""
    rows = scored_windows(transactions, customers, rule, hot)
    columns = rows.columns
    name = F.coalesce(*[F.col(c) for c in ("customer_name", "name") if c in columns], F.lit("Unknown"))
    return rows.select(
        alert_id(run_id, rule.scenario_id, ["customer_id"], "window_end", "aggregated_value").alias("alert_id"),
        F.lit(run_id).alias("run_id"),
        F.lit(rule.scenario_id).alias("scenario_id"),
        F.lit(rule.scenario_name).alias("scenario_name"),
        "customer_id",
        name.alias("customer_name"),
        "alert_date",
        "aggregated_value",
        "threshold",
        "transaction_count",
        ratio_score("aggregated_value", "threshold").alias("risk_score"),
        F.lit(rule.metadata.get("severity", "MEDIUM")).alias("risk_classification"),
        trigger_reason(rule, columns, rule.window_days).alias("trigger_reason"),
        peak_details(rule, rule.window_days).alias("trigger_details"),
        metadata_block(rule.metadata).alias("alert_metadata"),
        enrichment_block(rule.enrichment, columns).alias("enrichment_data"),
        "window_start",
        "window_end",
        "start_value",
        "starts_at_last",
    )


def peak_links(
    transactions: DataFrame, customers: DataFrame, alerts: DataFrame, rule: Rule, hot: Hot = UNKNOWN
) -> DataFrame:
    """The filtered transactions inside each alert's window."""
    hot = hot_groups(transactions, ["customer_id"]) if hot is UNKNOWN else hot
    kept = apply_filters(transactions, customers, rule.filters, "peak", rule.mapping, hot)
    marks = alerts.select(
        "alert_id", "customer_id", "window_start", "window_end", "start_value", "starts_at_last", "transaction_count"
    )
    return in_peak_window(kept, marks, _value_column(rule, transactions), hot=hot)
