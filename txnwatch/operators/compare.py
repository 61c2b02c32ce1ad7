"""Comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnwatch.functions.rows import one_row
from txnwatch.operators.skew import skew_join
from txnwatch.operators.windows import amount_of

# Score of an alert without one, by classification.
CLASS_SCORE = {"CRITICAL": 90, "HIGH": 75, "MEDIUM": 50, "LOW": 25}
DEFAULT_SCORE = 50


def _percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), 2), F.lit(0.0))


def visible(alerts: DataFrame, exclude_suppressed: bool) -> DataFrame:
    """Suppressed alerts count unless asked otherwise."""
    return alerts.filter(~F.col("excluded")) if exclude_suppressed else alerts


def customer_counts(baseline: DataFrame, refined: DataFrame) -> DataFrame:
    """Alerts per customer in both runs and the change, one row per customer of either run."""
    sides = baseline.select("customer_id", F.lit(1).alias("_b"), F.lit(0).alias("_r")).unionByName(
        refined.select("customer_id", F.lit(0).alias("_b"), F.lit(1).alias("_r"))
    )
    return sides.groupBy("customer_id").agg(
        F.sum("_b").alias("baseline_alerts"), F.sum("_r").alias("refined_alerts")
    ).withColumn("net_change", F.col("refined_alerts") - F.col("baseline_alerts"))


def customer_sets(baseline: DataFrame, refined: DataFrame) -> DataFrame:
    """Each customer as removed, added or maintained."""
    counts = customer_counts(baseline, refined)
    status = (
        F.when(F.col("refined_alerts") == 0, "removed").when(F.col("baseline_alerts") == 0, "added").otherwise("maintained")
    )
    return counts.select("customer_id", status.alias("status"))


def summary_peak(baseline: DataFrame, refined: DataFrame, exclude_suppressed: bool = False) -> DataFrame:
    """G1: counts, reduction rate and customer sets of two runs."""
    counts = customer_counts(visible(baseline, exclude_suppressed), visible(refined, exclude_suppressed))
    b, r = F.col("baseline_alerts"), F.col("refined_alerts")
    return counts.agg(
        F.coalesce(F.sum(b), F.lit(0)).alias("baseline_alerts"),
        F.coalesce(F.sum(r), F.lit(0)).alias("refined_alerts"),
        F.coalesce(F.sum(b - r), F.lit(0)).alias("net_change"),
        _percent(F.sum(b - r), F.sum(b)).alias("reduction_rate"),
        F.count_if((b > 0) & (r > 0)).alias("maintained_customers"),
        F.count_if((b > 0) & (r == 0)).alias("removed_customers"),
        F.count_if((b == 0) & (r > 0)).alias("added_customers"),
    )


def summary_grouped(baseline: DataFrame, refined: DataFrame, exclude_suppressed: bool = False) -> DataFrame:
    """Counts and percent reduction."""
    return summary_peak(baseline, refined, exclude_suppressed).select(
        "baseline_alerts", "refined_alerts", "net_change", F.col("reduction_rate").alias("percent_reduction")
    )


def _latest(alerts: DataFrame) -> DataFrame:
    """One alert per customer: the latest, by id among equals."""
    return alerts.groupBy("customer_id").agg(
        F.max(
            F.struct("alert_date", "alert_id", "risk_score", "scenario_name", "aggregated_value", "trigger_reason")
        ).alias("_a")
    )


def diff_peak(baseline: DataFrame, refined: DataFrame, limit: int | None = 100) -> DataFrame:
    """Customer by customer, the refined alert preferred, highest scores first."""
    old = _latest(baseline).withColumnRenamed("_a", "_old")
    new = _latest(refined).withColumnRenamed("_a", "_new")
    joined = old.join(new, "customer_id", "full_outer")
    shown = F.coalesce("_new", "_old")
    rows = joined.select(
        "customer_id",
        F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "added").otherwise("maintained").alias("status"),
        shown["risk_score"].alias("risk_score"),
        F.coalesce(F.col("_new.risk_score") - F.col("_old.risk_score"), F.lit(0)).alias("risk_change"),
        shown["scenario_name"].alias("scenario"),
        F.coalesce(shown["aggregated_value"], F.lit(0.0)).alias("amount"),
        shown["trigger_reason"].alias("reason"),
    )
    ordered = rows.orderBy(F.desc("risk_score"), "customer_id")
    return ordered.limit(limit) if limit else ordered


def diff_grouped(
    baseline: DataFrame, refined: DataFrame, links: DataFrame, transactions: DataFrame, limit: int | None = 50
) -> DataFrame:
    """Customers without alerts in the refined run: their alerts, linked amount, top score and scenarios."""
    gone = skew_join(baseline, refined.select("customer_id").distinct(), ["customer_id"], "left_anti", salt_on=["alert_id"])
    by_class = F.lit(DEFAULT_SCORE)
    for name, score in CLASS_SCORE.items():
        by_class = F.when(F.upper("risk_classification") == name, score).otherwise(by_class)
    score = F.when(F.col("risk_score") > 0, F.col("risk_score")).otherwise(by_class)
    # A run has few scenarios, so the set per customer is bounded by the rules of the run.
    heads = gone.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.max(score).alias("max_risk_score"),
        F.array_sort(F.collect_set("scenario_id")).alias("scenarios"),
    )
    amounts = transactions.select("transaction_id", amount_of("transaction_amount").alias("_amount"))
    owners = gone.select("alert_id", "customer_id")
    # One transaction is linked by few alerts (rules times overlapping windows), so only alerts can be hot.
    kept = skew_join(links.select("alert_id", "transaction_id"), owners, ["alert_id"], "inner", salt_on=["transaction_id"])
    totals = (
        kept.join(amounts, "transaction_id", "inner")
        .groupBy("customer_id")
        .agg(F.sum("_amount").cast("double").alias("_total"))
    )
    rows = heads.join(totals, "customer_id", "left").select(
        "customer_id",
        F.lit("removed").alias("status"),
        "alert_count",
        F.round(F.coalesce("_total", F.lit(0.0)), 2).alias("total_amount"),
        "max_risk_score",
        "scenarios",
    )
    ordered = rows.orderBy(F.desc("max_risk_score"), "customer_id")
    return ordered.limit(limit) if limit else ordered


def exposure(diff: DataFrame, score: str = "risk_score", amount: str = "amount") -> DataFrame:
    """Mean of the ten highest scores of a diff, its level, three samples and the row count.

    Any row at all makes the level CRITICAL. ``diff`` is the (limited) output of ``diff_peak`` or
    ``diff_grouped``; only its ten top rows are ever ranked.
    """
    top = diff.orderBy(F.desc(score), "customer_id").limit(10)
    rank = F.row_number().over(W.orderBy(F.desc(score), "customer_id"))
    sentence = F.format_string(
        "Customer %s: $%,.0f suppressed (score: %s)", F.col("customer_id"), F.col(amount).cast("double"), F.col(score).cast("string")
    )
    ranked = top.select(
        F.col(score).cast("double").alias("_score"), rank.alias("_rank"), sentence.alias("_text"), F.lit(None).cast("long").alias("_n")
    )
    counted = diff.agg(F.count(F.lit(1)).alias("_n")).select(
        F.lit(None).cast("double").alias("_score"), F.lit(None).cast("int").alias("_rank"), F.lit(None).cast("string").alias("_text"), "_n"
    )
    first_three = F.array_sort(F.collect_list(F.when(F.col("_rank") <= 3, F.struct("_rank", "_text"))))
    both = ranked.unionByName(counted).agg(
        F.round(F.coalesce(F.avg("_score"), F.lit(0.0)), 2).alias("risk_score"),
        first_three["_text"].alias("sample_exploits"),
        F.sum("_n").alias("total_suppressions"),
    )
    return both.select(
        "risk_score",
        F.when(F.col("total_suppressions") > 0, "CRITICAL").otherwise("SAFE").alias("risk_level"),
        "sample_exploits",
        F.col("total_suppressions").alias("high_risk_suppressions"),
        "total_suppressions",
    )


def efficiency(summary: DataFrame, risk: DataFrame) -> DataFrame:
    """Reduction weighed by the remaining safety; both inputs are one row."""
    both = one_row([summary.select("net_change", "percent_reduction", "refined_alerts"), risk.select("risk_score")])
    return both.select(
        F.col("net_change").alias("alerts_delta"),
        (F.col("percent_reduction") * (1 - F.col("risk_score") / 100)).alias("efficiency_score"),
        F.col("refined_alerts").alias("overlap_count"),
    )


def latest_run(runs: DataFrame, identifier: str, completed_only: bool = True, last: int | None = None) -> DataFrame:
    """The run with this id, else the latest run that contains the rule; at most one row.

    ``last`` looks only at the most recent runs (50 for a rule page, 100 for a comparison).
    """
    pool = runs.filter(F.col("status") == "completed") if completed_only else runs
    if last:
        pool = pool.orderBy(F.desc("created_at"), F.desc("run_id")).limit(last)
    by_rule = pool.filter(F.array_contains("scenarios_run", identifier))
    direct = runs.filter(F.col("run_id") == identifier)
    both = direct.withColumn("_order", F.lit(0)).unionByName(by_rule.withColumn("_order", F.lit(1)))
    return both.orderBy("_order", F.desc("created_at"), F.desc("run_id")).limit(1).drop("_order")


def alert_diff(baseline: DataFrame, refined: DataFrame) -> DataFrame:
    """Each (customer, scenario, day) as RETAINED, EXCLUDED, NEW_ALERT or DROPPED_SILENTLY."""
    keys = ["customer_id", "scenario_id", "alert_day"]

    def keyed(alerts: DataFrame, name: str) -> DataFrame:
        return alerts.withColumn("alert_day", F.to_date("alert_date")).groupBy(*keys).agg(
            F.min(F.col("excluded").cast("int")).alias(name)
        )

    joined = keyed(baseline, "_b").join(keyed(refined, "_r"), keys, "full_outer")
    status = (
        F.when(F.col("_r").isNull(), "DROPPED_SILENTLY")
        .when(F.col("_r") == 1, "EXCLUDED")
        .when(F.col("_b").isNull(), "NEW_ALERT")
        .otherwise("RETAINED")
    )
    return joined.select(*keys, status.alias("status"))


def alert_diff_counts(diff: DataFrame) -> DataFrame:
    """Alerts per status."""
    return diff.groupBy("status").agg(F.count(F.lit(1)).alias("alerts"))
