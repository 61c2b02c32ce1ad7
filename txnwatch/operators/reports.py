"""Dashboards, run lists, traces and exports as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnwatch.functions.rows import one_row
from txnwatch.operators.enrich import add_customer_fields, scenario_names
from txnwatch.operators.skew import numbered


def dashboard_grouped(transactions: DataFrame, alerts: DataFrame, runs: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Rows scanned, open high alerts with their level, runs, and share of enabled scenarios."""
    high = F.count_if((F.col("risk_classification") == "HIGH") & (F.col("alert_status") == "OPN"))
    share = F.format_string("%.1f%%", F.try_divide(F.count_if("enabled") * 100.0, F.count(F.lit(1))))
    level = F.when(F.col("active_high_risk_alerts") > 50, "High").when(F.col("active_high_risk_alerts") > 10, "Medium").otherwise("Low")
    return one_row(
        [
            transactions.agg(F.count(F.lit(1)).alias("transactions_scanned")),
            alerts.agg(high.alias("active_high_risk_alerts")),
            runs.agg(F.count(F.lit(1)).alias("total_simulations")),
            scenarios.agg(F.when(F.count(F.lit(1)) == 0, "100%").otherwise(share).alias("system_coverage")),
        ]
    ).withColumn("risk_score", level)


def dashboard_peak(
    transactions: DataFrame, customers: DataFrame, alerts: DataFrame, runs: DataFrame, uploads: DataFrame
) -> DataFrame:
    """Table sizes, whether there is data, and the newest dataset's name."""
    return one_row(
        [
            alerts.agg(F.count(F.lit(1)).alias("total_alerts")),
            transactions.agg(F.count(F.lit(1)).alias("transactions_scanned")),
            customers.agg(F.count(F.lit(1)).alias("customers_scanned")),
            runs.agg(F.count(F.lit(1)).alias("total_simulations")),
            uploads.agg(F.max_by("dataset_name", F.struct("upload_timestamp", "upload_id")).alias("dataset_name")),
        ]
    ).withColumn("has_data", F.col("transactions_scanned") > 0)


def run_list(runs: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Runs numbered by creation, with scenario names."""
    order = ["created_at", "run_id"]
    return numbered(scenario_names(runs, scenarios).withColumn("_all", F.lit(1)), ["_all"], order, "run_number").drop("_all")


def recent_runs(runs: DataFrame, scenarios: DataFrame, last: int = 5) -> DataFrame:
    """The newest runs with their number among all runs and scenario names.

    The newest are found first; their number follows from the total, so older runs are never numbered.
    """
    newest = runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(last)
    place = F.row_number().over(W.orderBy(F.desc("created_at"), F.desc("run_id")))
    total = runs.agg(F.count(F.lit(1)).alias("_total")).withColumn("_places", F.sequence(F.lit(1), F.lit(last)))
    numbers = total.select(F.explode("_places").alias("_place"), (F.col("_total") + 1).alias("_next"))
    placed = scenario_names(newest, scenarios).withColumn("_place", place)
    return placed.join(numbers, "_place").withColumn("run_number", F.col("_next") - F.col("_place")).drop("_place", "_next")


def report_summary(scenarios: DataFrame, runs: DataFrame) -> DataFrame:
    """Scenarios, active ones, alerts over all runs and the last run."""
    return one_row(
        [
            scenarios.agg(F.count(F.lit(1)).alias("total_scenarios"), F.count_if("enabled").alias("active_scenarios")),
            runs.agg(F.coalesce(F.sum("total_alerts"), F.lit(0)).alias("total_alerts"), F.max("created_at").alias("last_run")),
        ]
    )


def run_totals(alerts: DataFrame, grouped: bool) -> DataFrame:
    """Alerts per run; grouped runs leave out suppressed ones."""
    counted = F.count_if(~F.col("excluded")) if grouped else F.count(F.lit(1))
    return alerts.groupBy("run_id").agg(counted.alias("total_alerts"))


def run_alerts(alerts: DataFrame, run_id: str) -> DataFrame:
    """The alerts of one run."""
    return alerts.filter(F.col("run_id") == run_id)


def run_detail(runs: DataFrame, run_id: str) -> DataFrame:
    """Metadata of one run."""
    columns = ["run_id", "run_type", "created_at", "total_alerts", "total_transactions", "status"]
    return runs.filter(F.col("run_id") == run_id).select(*[c for c in columns if c in runs.columns])


def alert_trace(links: DataFrame, transactions: DataFrame, alert_id: str) -> DataFrame:
    """The transactions behind one alert, largest contribution first."""
    chosen = links.filter(F.col("alert_id") == alert_id).select("transaction_id", "contribution_percentage")
    return (
        chosen.join(transactions, "transaction_id", "inner")
        .select(
            "transaction_id",
            F.coalesce(F.col("contribution_percentage").cast("double"), F.lit(0.0)).alias("contribution_percentage"),
            F.coalesce(F.col("transaction_amount").try_cast("double"), F.lit(0.0)).alias("amount"),
            F.col("transaction_date").try_cast("timestamp").alias("date"),
            F.coalesce(F.col("beneficiary_name"), F.lit("Unknown")).alias("beneficiary"),
            F.coalesce(F.col("transaction_narrative"), F.lit("N/A")).alias("description"),
        )
        .orderBy(F.desc("contribution_percentage"), "transaction_id")
    )


def search(df: DataFrame, text: str, columns: Sequence[str]) -> DataFrame:
    """Rows in which any of the columns contains the text, case-insensitively."""
    hit = F.lit(False)
    for name in columns:
        hit = hit | F.coalesce(F.lower(F.col(name).cast("string")).contains(text.lower()), F.lit(False))
    return df.filter(hit)


def export_alerts(alerts: DataFrame, customers: DataFrame) -> DataFrame:
    """The nine export columns of a run."""
    rows = add_customer_fields(alerts, customers, ["occupation", "annual_income"])
    # The titles of the export.
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("N/A")) if name in rows.columns else F.lit("N/A")
    return rows.select(
        F.col("alert_id").alias("Alert ID"),
        F.col("scenario_name").alias("Scenario"),
        F.col("risk_score").alias("Risk Score"),
        F.col("customer_id").alias("Customer ID"),
        F.coalesce("customer_name", F.lit("Unknown")).alias("Customer Name"),
        shown("occupation").alias("Occupation"),
        shown("annual_income").alias("Annual Income"),
        F.coalesce(F.date_format("alert_date", "yyyy-MM-dd HH:mm:ss"), F.lit("N/A")).alias("Date"),
        F.col("trigger_reason").alias("Trigger Reason"),
    )


def export_comparison(diff: DataFrame) -> DataFrame:
    """The seven export columns of a comparison."""
    # The titles of the export.
    names = {
        "customer_id": "Customer ID", "status": "Status", "risk_score": "Risk Score", "risk_change": "Risk Change",
        "scenario": "Scenario", "amount": "Amount", "reason": "Reason",
    }
    return diff.select(*[F.col(column).alias(title) for column, title in names.items()])
