"""Expiry of datasets and removal of personal data.

Each step returns the next state of the tables it touches; the caller writes them. The clock is a
parameter, so a run can be repeated.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnwatch.functions.rows import one_row
from txnwatch.operators.skew import list_join, skew_join

DEFAULT_HOURS = 48
LONGEST_HOURS = 168


def _clock(now: Any) -> Column:
    return F.lit(now).cast("timestamp")


def _plus(column: Column, hours: int) -> Column:
    return column + F.make_dt_interval(hours=F.lit(hours))


def stamp_expiry(df: DataFrame, now: Any, hours: int = DEFAULT_HOURS) -> DataFrame:
    """Rows that expire ``hours`` from now."""
    return df.withColumn("expires_at", _plus(_clock(now), hours))


def extend_expiry(uploads: DataFrame, upload_id: str, hours: int, now: Any) -> DataFrame:
    """A later expiry for one upload, never beyond a week from now."""
    later = F.least(_plus(F.col("expires_at"), hours), _plus(_clock(now), LONGEST_HOURS))
    return uploads.withColumn("expires_at", F.when(F.col("upload_id") == upload_id, later).otherwise(F.col("expires_at")))


def propagate_expiry(rows: DataFrame, uploads: DataFrame) -> DataFrame:
    """Child rows take the expiry of their upload; rows of unknown uploads keep theirs."""
    new = uploads.select("upload_id", F.col("expires_at").alias("_new"))
    joined = list_join(rows, new, ["upload_id"], "left")
    return joined.withColumn("expires_at", F.coalesce("_new", "expires_at")).select(*rows.columns)


def expired(uploads: DataFrame, now: Any) -> DataFrame:
    """Active uploads whose time is over."""
    return uploads.filter((F.col("status") == "active") & (F.col("expires_at") < _clock(now)))


def cleanup(uploads: DataFrame, transactions: DataFrame, customers: DataFrame, alerts: DataFrame, now: Any) -> dict[str, DataFrame]:
    """The next state of all four tables.

    Alerts of affected customers lose the customer's name before transactions and customers of the
    expired uploads disappear; the uploads become ``expired``.
    """
    gone = expired(uploads, now).select("upload_id").distinct()
    people = _affected(customers, gone)
    marked = skew_join(alerts, people.withColumn("_gone", F.lit(True)), ["customer_id"], "left")
    hit = F.coalesce(F.col("_gone"), F.lit(False)) & ~F.col("is_anonymized")
    state = {
        "customer_name": F.when(hit, F.concat(F.lit("ANONYMIZED-"), F.substring("customer_id", 1, 8))).otherwise(F.col("customer_name")),
        "is_anonymized": F.col("is_anonymized") | hit,
        "anonymized_at": F.when(hit, _clock(now)).otherwise(
            F.col("anonymized_at") if "anonymized_at" in alerts.columns else F.lit(None).cast("timestamp")
        ),
    }
    if "trigger_details" in alerts.columns:
        state["trigger_details"] = _without_pii(alerts, hit)
    status = F.when((F.col("status") == "active") & (F.col("expires_at") < _clock(now)), "expired").otherwise(F.col("status"))
    return {
        "alerts": marked.withColumns(state).drop("_gone"),
        "transactions": list_join(transactions, gone, ["upload_id"], "left_anti"),
        "customers": list_join(customers, gone, ["upload_id"], "left_anti"),
        "uploads": uploads.withColumn("status", status),
    }


def _without_pii(alerts: DataFrame, hit: Column) -> Column:
    """Details marked ``pii_removed``: a map gets the key, JSON text (and a struct, as JSON text) the field.

    JSON text also loses the customer's name wherever it occurs, as a run writes customer fields into it.
    """
    column, kind = F.col("trigger_details"), alerts.schema["trigger_details"].dataType
    if isinstance(kind, T.MapType):
        details = F.coalesce(column, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
        kept = F.map_filter(details, lambda key, _: key != "pii_removed")
        return F.when(hit, F.map_concat(kept, F.create_map(F.lit("pii_removed"), F.lit("true")))).otherwise(column)
    text = F.to_json(column) if isinstance(kind, T.StructType) else column
    plain = F.regexp_replace(F.coalesce(F.trim(text), F.lit("{}")), r',?\s*"pii_removed"\s*:\s*"?true"?', "")
    name = F.nullif(F.trim("customer_name"), F.lit(""))
    plain = F.coalesce(F.replace(plain, name, F.lit("ANONYMIZED")), plain)
    body = F.regexp_replace(plain, r"\}$", "")
    added = F.concat(body, F.when(F.trim(body) == "{", F.lit("")).otherwise(F.lit(",")), F.lit('"pii_removed":"true"}'))
    return F.when(hit, added).otherwise(text)


def _affected(customers: DataFrame, gone: DataFrame) -> DataFrame:
    return list_join(customers, gone, ["upload_id"]).select("customer_id").distinct()


def cleanup_counts(uploads: DataFrame, transactions: DataFrame, customers: DataFrame, alerts: DataFrame, now: Any) -> DataFrame:
    """I4: what a cleanup would change. Rows are counted per upload before uploads are joined."""
    gone = expired(uploads, now).select("upload_id").distinct()

    def counted(df: DataFrame, key: str, among: DataFrame, name: str) -> DataFrame:
        per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(among, key, "left_semi")
        return per_key.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias(name))

    visible = alerts.filter(~F.col("is_anonymized"))
    active = uploads.filter(F.col("status") == "active")
    return one_row(
        [
            counted(visible, "customer_id", _affected(customers, gone), "alerts_anonymized"),
            counted(transactions, "upload_id", gone, "transactions_deleted"),
            counted(customers, "upload_id", gone, "customers_deleted"),
            counted(active, "upload_id", gone, "uploads_expired"),
        ]
    )


def lifecycle_stats(uploads: DataFrame, alerts: DataFrame, now: Any) -> DataFrame:
    """Active and overdue uploads, anonymised and active alerts."""
    active = F.col("status") == "active"
    of_uploads = uploads.agg(
        F.count_if(active).alias("active_uploads"),
        F.count_if(active & (F.col("expires_at") < _clock(now))).alias("expired_uploads_pending_cleanup"),
    )
    of_alerts = alerts.agg(
        F.count_if("is_anonymized").alias("anonymized_alerts"), F.count_if(~F.col("is_anonymized")).alias("active_alerts")
    )
    return one_row([of_uploads, of_alerts]).withColumn("total_alerts", F.col("anonymized_alerts") + F.col("active_alerts"))
