"""A grouped rule from transactions to alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.functions.scoring import band_score, score_class
from txnwatch.operators.aggregate import group_aggregate, grouped_links
from txnwatch.operators.alerts import alert_condition, alert_id, dedup_alerts, details_map
from txnwatch.operators.enrich import add_customer_fields, enrich_with_customers
from txnwatch.operators.filters import apply_filters
from txnwatch.operators.skew import UNKNOWN, Hot, hot_groups
from txnwatch.operators.threshold import threshold_column
from txnwatch.operators.windows import in_trailing_window, trailing_windows
from txnwatch.rules import Rule, customer_fields_of


def prepared(transactions: DataFrame, customers: DataFrame, rule: Rule, hot: Hot = UNKNOWN) -> DataFrame:
    """Filtered transactions, with customer columns only where the rule groups by them."""
    kept = apply_filters(transactions, customers, rule.filters, "grouped", rule.mapping, hot)
    keys = [name for name in rule.group_by if name not in transactions.columns and name in customers.columns]
    return enrich_with_customers(kept, customers, keys, hot=hot) if keys else kept


def _own_keys(rule: Rule, hot: Hot) -> Hot:
    """Hot customers are the hot groups only when the rule groups by customer alone."""
    return hot if list(rule.group_by) == ["customer_id"] else UNKNOWN


def aggregated(rows: DataFrame, rule: Rule, hot: Hot = UNKNOWN) -> DataFrame:
    """D1, D6-D8 by the rule's time window."""
    window = rule.time_window
    field = rule.resolve(rule.value_field)
    if window is not None and window.kind == "rolling":
        return trailing_windows(rows, window.micros, rule.function, rule.group_by, field, hot=_own_keys(rule, hot))
    values = group_aggregate(rows, rule.function, field, rule.group_by, window)
    start = F.col("time_group") if window is not None else F.lit(None).cast("timestamp")
    return values.withColumns({"window_start": start, "window_end": F.col("alert_date")})


def with_threshold(
    values: DataFrame, customers: DataFrame, transactions: DataFrame, rule: Rule, hot: Hot = None
) -> DataFrame:
    """Customer attributes, the threshold, and the rows that reach it.

    A fixed threshold is applied before attributes are joined, so only possible alerts are joined.
    """
    if rule.threshold is not None and rule.threshold.kind == "fixed":
        values = values.withColumn("threshold", threshold_column(rule.threshold, [])).filter(
            F.col("aggregated_value") >= F.col("threshold")
        )
    fields = customer_fields_of(rule, customers.columns, transactions.columns)
    if "customer_id" in values.columns:
        rolling = rule.time_window is not None and rule.time_window.kind == "rolling"
        # A trailing rule has one row per customer and instant, so hot customers stay hot; a group or
        # calendar bucket leaves few rows per customer.
        values = add_customer_fields(values, customers, fields, hot=hot if rolling else None)
    if rule.threshold is not None and rule.threshold.kind != "fixed":
        values = values.withColumn("threshold", threshold_column(rule.threshold, values.columns)).filter(
            F.col("aggregated_value") >= F.col("threshold")
        )
    return values


def grouped_alerts(
    transactions: DataFrame, customers: DataFrame, rule: Rule, run_id: str, hot: Hot = UNKNOWN
) -> DataFrame:
    """One alert per customer and day among the groups or windows that meet threshold and condition."""
    hot = hot_groups(transactions, ["customer_id"]) if hot is UNKNOWN else hot
    rows = prepared(transactions, customers, rule, hot)
    hits = alert_condition(with_threshold(aggregated(rows, rule, hot), customers, transactions, rule, hot), rule)
    columns = [c for c in hits.columns if c not in ("window_start", "window_end", "peers")]
    if "customer_id" not in columns:
        hits = hits.withColumn("customer_id", F.lit(None).cast("string"))
    if "threshold" not in columns:
        hits = hits.withColumn("threshold", F.lit(None).cast("double"))
    name = F.coalesce(F.col("customer_name").cast("string"), F.lit("Unknown")) if "customer_name" in columns else F.lit("Unknown")
    owner = [*rule.group_by, *(["time_group"] if "time_group" in columns else [])]
    score = band_score("aggregated_value")
    alerts = hits.select(
        alert_id(run_id, rule.scenario_id, owner, "window_end", "aggregated_value").alias("alert_id"),
        F.lit(run_id).alias("run_id"),
        F.lit(rule.scenario_id).alias("scenario_id"),
        F.lit(rule.scenario_name).alias("scenario_name"),
        F.col("customer_id").cast("string").alias("customer_id"),
        name.alias("customer_name"),
        "alert_date",
        "aggregated_value",
        "threshold",
        "transaction_count",
        score.alias("risk_score"),
        score_class(score).alias("risk_classification"),
        F.lit(None).cast("string").alias("trigger_reason"),
        details_map(columns).alias("trigger_details"),
        "window_start",
        "window_end",
        *[c for c in owner if c != "customer_id"],
    )
    return dedup_alerts(alerts)


def grouped_alert_links(
    transactions: DataFrame, customers: DataFrame, alerts: DataFrame, rule: Rule, hot: Hot = UNKNOWN
) -> DataFrame:
    """The filtered transactions behind each alert."""
    hot = hot_groups(transactions, ["customer_id"]) if hot is UNKNOWN else hot
    rows = prepared(transactions, customers, rule, hot)
    window = rule.time_window
    if window is not None and window.kind == "rolling":
        marks = alerts.select("alert_id", *rule.group_by, "window_start", "window_end")
        return in_trailing_window(rows, marks, window.micros, rule.group_by, hot=_own_keys(rule, hot))
    return grouped_links(rows, alerts, rule.group_by, window, hot=_own_keys(rule, hot))
