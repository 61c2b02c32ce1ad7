"""Grouped aggregation, contributions and beneficiary history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnwatch.operators.skew import UNKNOWN, Hot, hot_groups, hot_within, numbered, skew_join, whole
from txnwatch.operators.windows import AMOUNT, amount_of, instant, micros, number
from txnwatch.rules import TimeWindow


def calendar_bucket(ts: str | Column, window: TimeWindow) -> Column:
    """Start of the bucket: multiples of N days or hours since 1970, or the calendar month."""
    column = F.col(ts) if isinstance(ts, str) else ts
    if window.unit == "months":
        return F.date_trunc("month", instant(column))
    return F.timestamp_micros(whole(micros(column), window.micros) * F.lit(window.micros))


def aggregate_value(function: str, field: str | Column) -> Column:
    """D2-D5 as one aggregate; sums of nothing are 0, ``count`` counts filled values."""
    value = amount_of(field)
    if function == "sum":
        return F.coalesce(F.sum(value), F.lit(0).cast(AMOUNT)).cast("double")
    if function == "count":
        return F.count(F.col(field) if isinstance(field, str) else field).cast("double")
    if function == "avg":
        return F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))
    return {"max": F.max, "min": F.min}[function](value).cast("double")


def group_aggregate(
    transactions: DataFrame,
    function: str,
    field: str,
    group_by: Sequence[str],
    window: TimeWindow | None = None,
    ts: str = "transaction_date",
) -> DataFrame:
    """Aggregate per group and calendar bucket, with ``transaction_count`` and the last date.

    Rows with a missing key are left out. Partial sums are formed before the shuffle, so a group that
    holds most of the rows costs no more than a small one. The transactions of a group are not gathered
    into a list; ``grouped_links`` returns them as rows.
    """
    keys = list(group_by)
    rows = transactions
    if window is not None:
        rows = rows.withColumn("time_group", calendar_bucket(ts, window))
        keys.append("time_group")
    extra = []
    if "customer_id" not in keys and "customer_id" in transactions.columns:
        first = F.struct(F.col(ts), F.col("transaction_id"), F.col("customer_id"))
        extra.append(F.min(first)["customer_id"].alias("customer_id"))
    return (
        rows.dropna(subset=keys)
        .groupBy(*keys)
        .agg(
            aggregate_value(function, field).alias("aggregated_value"),
            F.count(F.lit(1)).alias("transaction_count"),
            F.max(instant(ts)).alias("alert_date"),
            *extra,
        )
    )


def grouped_links(
    transactions: DataFrame,
    alerts: DataFrame,
    group_by: Sequence[str],
    window: TimeWindow | None,
    ts: str = "transaction_date",
    hot: Hot = UNKNOWN,
) -> DataFrame:
    """The transactions behind each grouped or calendar alert, one row per pair."""
    keys = list(group_by)
    rows = transactions
    if window is not None:
        rows = rows.withColumn("time_group", calendar_bucket(ts, window))
        keys.append("time_group")
    finer = hot_within(rows, keys, list(group_by), hot)
    return skew_join(rows, alerts.select("alert_id", *keys), keys, "inner", salt_on=["transaction_id"], hot=finer)


def contributions(links: DataFrame, amount: str = "transaction_amount", order: Sequence[str] = ("transaction_date", "transaction_id")) -> DataFrame:
    """Share of each transaction in its alert's total (0 when the total is not positive) and its place 1..n.

    Refunds can leave a small total, so shares may be far above 100 or below 0.
    """
    rows = links.select(
        "alert_id",
        "transaction_id",
        *[c for c in ("upload_id",) if c in links.columns],
        *[c for c in order if c not in ("alert_id", "transaction_id")],
        number(amount).alias("_value"),
    )
    hot = hot_groups(rows, ["alert_id"])
    by = W.partitionBy("alert_id")
    place = F.row_number().over(by.orderBy(*order)).cast("long").alias("sequence_order")
    whole_alert = F.sum("_value").over(by).alias("_total")
    if hot is None:
        placed = rows.select("*", place, whole_alert)
    else:
        # Only alerts with very many transactions need the range sort.
        few = hot.drop("_pieces")
        cold = rows.join(few, "alert_id", "left_anti").select("*", place, whole_alert)
        large = numbered(rows.join(few, "alert_id", "left_semi"), ["alert_id"], list(order), "sequence_order", {"_total": "_value"})
        placed = cold.unionByName(large)
    total = F.col("_total").cast("double")
    share = F.round(F.col("_value").cast("double") * 100 / total, 2)
    return placed.select(
        *[c for c in rows.columns if c != "_value"],
        F.when(total > 0, share).otherwise(F.lit(0.0)).try_cast("decimal(38,2)").alias("contribution_percentage"),
        F.lit(False).alias("is_primary_trigger"),
        "sequence_order",
    )


def beneficiary_history(
    transactions: DataFrame, amount: str = "transaction_amount", ts: str = "transaction_date"
) -> DataFrame:
    """Totals per beneficiary; the mean gap in days follows from first, last and count."""
    names = [F.when(F.trim(c) != "", F.col(c)) for c in ("beneficiary_name", "beneficiary") if c in transactions.columns]
    value = amount_of(amount)
    at = instant(ts)
    gap = (F.unix_micros("last_transaction_date") - F.unix_micros("first_transaction_date")) / F.lit(86_400_000_000.0)
    return (
        transactions.withColumn("beneficiary_name", F.coalesce(*names))
        .filter(F.col("beneficiary_name").isNotNull())
        .groupBy("beneficiary_name")
        .agg(
            F.count(F.lit(1)).alias("total_transactions"),
            F.coalesce(F.sum(value), F.lit(0).cast(AMOUNT)).cast("double").alias("total_amount"),
            F.stddev_samp(value.cast("double")).alias("std_dev_amount"),
            F.min(at).alias("first_transaction_date"),
            F.max(at).alias("last_transaction_date"),
        )
        .withColumn("avg_days_between_txns", F.try_divide(gap, (F.col("total_transactions") - 1).cast("double")))
    )
