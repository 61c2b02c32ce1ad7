"""Datasets: duplicates, stubs, tenants, resolution, replacement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from txnwatch.operators.skew import list_join, skew_join


def last_wins(df: DataFrame, keys: Sequence[str], sequence: str | Column) -> DataFrame:
    """One row per key, the last by ingest sequence.

    Spark keeps one row per key in each task before the shuffle, so repeated keys stay cheap.
    """
    order = F.col(sequence) if isinstance(sequence, str) else sequence
    place = F.row_number().over(W.partitionBy(*keys).orderBy(order.desc()))
    return df.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Stored rows replaced by incoming rows with the same key; incoming duplicates resolve to the last."""
    both = stored.withColumn("_batch", F.lit(0)).unionByName(incoming.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    return last_wins(both, keys, F.struct("_batch", sequence)).drop("_batch")


def unknown_customers(transactions: DataFrame, customers: DataFrame) -> DataFrame:
    """Customer ids of transactions without a customer row, each once; ids are reduced before the join."""
    ids = transactions.select("customer_id").filter(F.col("customer_id").isNotNull()).distinct()
    return ids.join(customers.select("customer_id").distinct(), "customer_id", "left_anti")


def with_stubs(transactions: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers plus a stub, marked ``auto_created``, for each unknown id."""
    known = customers if "auto_created" in customers.columns else customers.withColumn("auto_created", F.lit(False))
    stubs = unknown_customers(transactions, customers).withColumn("auto_created", F.lit(True))
    return known.unionByName(stubs, allowMissingColumns=True)


def referential_check(transactions: DataFrame, customers: DataFrame) -> DataFrame:
    """How many transactions, and how many customer ids, lack a customer row."""
    counts = transactions.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n"))
    missing = counts.join(customers.select("customer_id").distinct(), "customer_id", "left_anti")
    return missing.agg(
        F.count(F.lit(1)).alias("unknown_customers"), F.coalesce(F.sum("_n"), F.lit(0)).alias("orphan_transactions")
    )


def of_user(df: DataFrame, uploads: DataFrame, user_id: str) -> DataFrame:
    """Rows whose upload belongs to the user."""
    own = uploads.filter(F.col("user_id") == user_id).select("upload_id").distinct()
    return list_join(df, own, ["upload_id"])


def latest_upload(
    uploads: DataFrame, now: Any = None, active_only: bool = False, with_transactions: bool = False, user_id: str | None = None
) -> DataFrame:
    """The newest upload, at most one row.

    ``active_only`` wants an active upload that has not expired at ``now``; ``with_transactions`` one
    that holds transactions.
    """
    pool = uploads if user_id is None else uploads.filter(F.col("user_id") == user_id)
    if active_only:
        pool = pool.filter((F.col("status") == "active") & (F.col("expires_at") > F.lit(now).cast("timestamp")))
    if with_transactions:
        pool = pool.filter(F.col("record_count_transactions") > 0)
    return pool.orderBy(F.desc("upload_timestamp"), F.desc("upload_id")).limit(1)


def without_upload(tables: Mapping[str, DataFrame], upload_id: str, keep: Sequence[str] = ()) -> dict[str, DataFrame]:
    """The tables without an upload and everything derived from it.

    Tables with ``upload_id`` lose its rows; runs of the upload go, with their alerts, links and logs.
    ``keep`` names tables left alone, such as customers when only transactions are replaced.
    """
    result = dict(tables)
    runs = tables.get("runs")
    gone_runs = runs.filter(F.col("upload_id") == upload_id).select("run_id") if runs is not None else None
    alerts = tables.get("alerts")
    gone_alerts = None
    if gone_runs is not None and alerts is not None:
        gone_alerts = list_join(alerts, gone_runs, ["run_id"]).select("alert_id")
    for name, df in tables.items():
        if name in keep:
            continue
        if "upload_id" in df.columns:
            df = df.filter(~F.col("upload_id").eqNullSafe(F.lit(upload_id)))
        elif name == "alerts" and gone_runs is not None:
            df = list_join(df, gone_runs, ["run_id"], "left_anti")
        if name in ("alert_transactions", "alert_exclusion_logs") and gone_alerts is not None:
            df = skew_join(df, gone_alerts, ["alert_id"], "left_anti")
        result[name] = df
    return result


def replace_upload(stored: DataFrame, incoming: DataFrame, upload_id: str) -> DataFrame:
    """The rows of one upload exchanged for new ones."""
    others = stored.filter(~F.col("upload_id").eqNullSafe(F.lit(upload_id)))
    return others.unionByName(incoming.withColumn("upload_id", F.lit(upload_id)), allowMissingColumns=True)
