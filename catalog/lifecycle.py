"""Expiry, cleanup and investigation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import Tables, query
from catalog.ingest import rows_by, stored_state
from catalog.rules import FLAGSHIP, peak_alert_sql
from txnwatch.operators import lifecycle
from txnwatch.operators.aggregate import contributions
from txnwatch.operators.reports import alert_trace, search
from txnwatch.plans.run import run_rules
from txnwatch.sources.state import apply_cleanup

NOW = "1998-06-01 00:00:00"
DUE = "select upload_id from upload where status = 'active' and expires_at < timestamp '1998-06-01'"


@query("i1_stamp_expiry", "select transaction_id, timestamp '1998-06-03' as expires_at from txn")
def stamp(t: Tables) -> DataFrame:
    return lifecycle.stamp_expiry(t.txn.select("transaction_id"), NOW)


@query(
    "i2_extend_expiry",
    """select transaction_id, case when upload_id = 'UP1997' then least(expires_at + interval 1000 hour, timestamp '1998-06-08') else expires_at end as expires_at
       from txn join upload using (upload_id)""",
)
def extend(t: Tables) -> DataFrame:
    later = lifecycle.extend_expiry(t.upload, "UP1997", 1000, NOW)
    rows = t.txn.select("transaction_id", "upload_id", F.lit(None).cast("timestamp").alias("expires_at"))
    return lifecycle.propagate_expiry(rows, later).select("transaction_id", "expires_at")


def state(t: Tables) -> dict[str, DataFrame]:
    return lifecycle.cleanup(t.upload, t.txn, t.cust, t.alert, NOW)


HIT = f"customer_id in (select customer_id from cust where upload_id in ({DUE})) and not is_anonymized"


@query(
    "i3_cleanup_alerts",
    f"""select alert_id, case when {HIT} then 'ANONYMIZED-' || substr(customer_id, 1, 8) else customer_name end as customer_name,
               is_anonymized or {HIT} as is_anonymized, case when {HIT} then timestamp '1998-06-01' end as anonymized_at from alert""",
)
def cleaned_alerts(t: Tables) -> DataFrame:
    return state(t)["alerts"].select("alert_id", "customer_name", "is_anonymized", "anonymized_at")


@query(
    "i3_cleanup_tables",
    f"""select 'transactions' as name, upload_id as what, count(*) as rows from txn where upload_id not in ({DUE}) group by 2
        union all select 'customers', upload_id, count(*) from cust where upload_id not in ({DUE}) group by 2
        union all select 'uploads', case when upload_id in ({DUE}) then 'expired' else status end, count(*) from upload group by 2""",
)
def cleaned_tables(t: Tables) -> DataFrame:
    parts = state(t)
    counted = [
        parts[name].groupBy(F.col(column).alias("what")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "what", "rows")
        for name, column in (("transactions", "upload_id"), ("customers", "upload_id"), ("uploads", "status"))
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query(
    "i3_stored_cleanup",
    f"""select 'transactions' as name, upload_id as what, count(*) as rows from txn where upload_id not in ({DUE}) group by 2
        union all select 'customers', upload_id, count(*) from cust where upload_id not in ({DUE}) group by 2
        union all select 'uploads', case when upload_id in ({DUE}) then 'expired' else status end, count(*) from upload group by 2
        union all select 'alerts', case when {HIT} then 'ANONYMIZED-' || substr(customer_id, 1, 8) else customer_name end, count(*) from alert group by 2""",
)
def stored_cleanup(t: Tables) -> DataFrame:
    """The cleanup carried out on a stored state."""
    folder = stored_state(t)
    apply_cleanup(t.spark, folder, NOW)
    return rows_by(t, folder, {"transactions": "upload_id", "customers": "upload_id", "uploads": "status", "alerts": "customer_name"})


@query(
    "i3_pii_flag",
    f"select alert_id, run_id, case when {HIT} then 'true' end as pii_removed from alert",
)
def pii_flag(t: Tables) -> DataFrame:
    alerts = t.alert.withColumn("trigger_details", F.create_map(F.lit("run_id"), F.col("run_id")))
    done = lifecycle.cleanup(t.upload, t.txn, t.cust, alerts, NOW)["alerts"]
    return done.select(
        "alert_id", F.col("trigger_details")["run_id"].alias("run_id"), F.try_element_at("trigger_details", F.lit("pii_removed")).alias("pii_removed")
    )


@query(
    "i4_cleanup_dry_run",
    f"""select (select count(*) from alert where {HIT}) as alerts_anonymized, (select count(*) from txn where upload_id in ({DUE})) as transactions_deleted,
               (select count(*) from cust where upload_id in ({DUE})) as customers_deleted, (select count(*) from ({DUE})) as uploads_expired""",
)
def dry_run(t: Tables) -> DataFrame:
    return lifecycle.cleanup_counts(t.upload, t.txn, t.cust, t.alert, NOW)


@query(
    "i5_lifecycle_stats",
    f"""select (select count(*) from upload where status = 'active') as active_uploads, (select count(*) from ({DUE})) as expired_uploads_pending_cleanup,
               count(*) filter (is_anonymized) as anonymized_alerts, count(*) filter (not is_anonymized) as active_alerts, count(*) as total_alerts from alert""",
)
def stats(t: Tables) -> DataFrame:
    return lifecycle.lifecycle_stats(t.upload, t.alert, NOW)


@query(
    "j1_alert_trace",
    """with s as (select *, cast(transaction_amount as decimal(18,2)) as v, sum(cast(transaction_amount as decimal(18,2))) over (partition by alert_id) as total from line)
       select transaction_id, cast(cast(round(cast(v as double) * 100 / cast(total as double), 2) as decimal(5,2)) as double) as contribution_percentage,
              transaction_amount as amount, transaction_date as date, beneficiary_name as beneficiary, transaction_narrative as description
       from s where alert_id = (select min(alert_id) from line)""",
)
def trace(t: Tables) -> DataFrame:
    first = t.line.agg(F.min("alert_id")).first()[0]
    return alert_trace(contributions(t.line), t.line, first)


@query(
    "j2_search",
    """select alert_id, customer_name, scenario_name from alert
       where contains(lower(alert_id), '77') or contains(lower(customer_name), '77') or contains(lower(scenario_name), '77')""",
)
def found(t: Tables) -> DataFrame:
    return search(t.alert, "77", ["alert_id", "customer_name", "scenario_name"]).select("alert_id", "customer_name", "scenario_name")


@query(
    "i3_run_to_cleanup",
    peak_alert_sql(
        f"""customer_id, case when hits.{HIT.replace(" and not is_anonymized", "")} then 'ANONYMIZED-' || substr(customer_id, 1, 8) else customer_name end as customer_name,
            case when hits.{HIT.replace(" and not is_anonymized", "")} then 'true' end as pii_removed, transaction_count"""
    ),
)
def run_to_cleanup(t: Tables) -> DataFrame:
    """The JSON details that a run writes keep their fields and gain the mark."""
    alerts = run_rules({"S1": FLAGSHIP}, t.txn, t.cust, "R1", with_links=False).alerts.withColumn("is_anonymized", F.lit(False))
    done = lifecycle.cleanup(t.upload, t.txn, t.cust, alerts, NOW)["alerts"]
    return done.select(
        "customer_id", "customer_name", F.get_json_object("trigger_details", "$.pii_removed").alias("pii_removed"),
        F.get_json_object("trigger_details", "$.transaction_count").cast("long").alias("transaction_count"),
    )
