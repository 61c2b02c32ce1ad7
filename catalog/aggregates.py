"""Aggregation and windows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import Tables, query
from txnwatch.operators.aggregate import beneficiary_history, contributions, group_aggregate
from txnwatch.operators.profile import field_metadata, field_value_index
from txnwatch.operators.reports import dashboard_grouped, dashboard_peak, recent_runs, report_summary, run_totals
from txnwatch.operators.windows import DAY, in_peak_window, number, peak_windows, trailing_rows
from txnwatch.rules import TimeWindow

MONEY = "cast(transaction_amount as decimal(18,2))"
VALUE = {
    "sum": f"cast(sum({MONEY}) as double)",
    "count": "cast(count(transaction_amount) as double)",
    "avg": f"cast(sum({MONEY}) as double) / count(*)",
    "max": f"cast(max({MONEY}) as double)",
    "min": f"cast(min({MONEY}) as double)",
}


def _group(function: str) -> None:
    name = {"sum": "d1_d2_sum", "count": "d3_count_g", "avg": "d4_avg", "max": "d5_max", "min": "d5_min"}[function]
    sql = f"""select customer_id, channel, {VALUE[function]} as aggregated_value, count(*) as transaction_count,
                     max(transaction_date) as alert_date from txn group by customer_id, channel"""
    query(name, sql)(lambda t: group_aggregate(t.txn, function, "transaction_amount", ["customer_id", "channel"]))


for _function in VALUE:
    _group(_function)


@query(
    "d1_group_without_customer",
    f"""select channel, {VALUE["sum"]} as aggregated_value, count(*) as transaction_count, max(transaction_date) as alert_date,
               arg_min(customer_id, (transaction_date, transaction_id)) as customer_id from txn group by channel""",
)
def group_without_customer(t: Tables) -> DataFrame:
    return group_aggregate(t.txn, "sum", "transaction_amount", ["channel"])


@query(
    "d1_null_keys_dropped",
    f"""select transaction_narrative, {VALUE["sum"]} as aggregated_value, count(*) as transaction_count, max(transaction_date) as alert_date,
               arg_min(customer_id, (transaction_date, transaction_id)) as customer_id
        from evt where transaction_narrative is not null group by transaction_narrative""",
)
def null_keys(t: Tables) -> DataFrame:
    return group_aggregate(t.evt, "sum", "transaction_amount", ["transaction_narrative"])


@query(
    "d7_calendar_days",
    f"""select customer_id, timestamp '1970-01-01' + interval 7 day * (date_diff('day', date '1970-01-01', cast(transaction_date as date)) // 7) as time_group,
               {VALUE["sum"]} as aggregated_value, count(*) as transaction_count, max(transaction_date) as alert_date
        from evt group by 1, 2""",
)
def calendar_days(t: Tables) -> DataFrame:
    return group_aggregate(t.evt, "sum", "transaction_amount", ["customer_id"], TimeWindow(7, "days", "calendar"))


@query(
    "d7_calendar_hours",
    f"""select transaction_type, time_bucket(interval 6 hour, transaction_date, timestamp '1970-01-01') as time_group,
               {VALUE["sum"]} as aggregated_value, count(*) as transaction_count, max(transaction_date) as alert_date,
               arg_min(customer_id, (transaction_date, transaction_id)) as customer_id
        from evt group by 1, 2""",
)
def calendar_hours(t: Tables) -> DataFrame:
    return group_aggregate(t.evt, "sum", "transaction_amount", ["transaction_type"], TimeWindow(6, "hours", "calendar"))


@query(
    "d8_calendar_months",
    f"""select customer_id, cast(date_trunc('month', transaction_date) as timestamp) as time_group, {VALUE["sum"]} as aggregated_value,
               count(*) as transaction_count, max(transaction_date) as alert_date from txn group by 1, 2""",
)
def calendar_months(t: Tables) -> DataFrame:
    return group_aggregate(t.txn, "sum", "transaction_amount", ["customer_id"], TimeWindow(1, "months", "calendar"))


def _trailing(function: str) -> None:
    value = {**VALUE, "count": "cast(count(*) as double)"}[function].replace("transaction_amount", "b.transaction_amount")
    sql = f"""select a.transaction_id, a.customer_id, {value} as aggregated_value, count(*) as transaction_count
              from evt a join evt b on a.customer_id = b.customer_id
                   and b.transaction_date between a.transaction_date - interval 2 day and a.transaction_date
              group by a.transaction_id, a.customer_id"""
    query(f"d6_trailing_{function}", sql)(
        lambda t: trailing_rows(t.evt, 2 * DAY, function).select("transaction_id", "customer_id", "aggregated_value", "transaction_count")
    )


for _function in VALUE:
    _trailing(_function)


@query(
    "d6_trailing_hours",
    """select a.transaction_id, a.customer_id, cast(sum(cast(b.transaction_amount as decimal(18,2))) as double) as aggregated_value,
              count(*) as transaction_count
       from evt a join evt b on a.customer_id = b.customer_id
            and b.transaction_date between a.transaction_date - interval 6 hour and a.transaction_date
       group by a.transaction_id, a.customer_id""",
)
def trailing_hours(t: Tables) -> DataFrame:
    window = TimeWindow(6, "hours", "rolling")
    return trailing_rows(t.evt, window.micros, "sum").select("transaction_id", "customer_id", "aggregated_value", "transaction_count")


@query(
    "d6_trailing_orders",
    """select a.transaction_id, a.customer_id, cast(sum(cast(b.transaction_amount as decimal(18,2))) as double) as aggregated_value,
              count(*) as transaction_count
       from txn a join txn b on a.customer_id = b.customer_id
            and b.transaction_date between a.transaction_date - interval 90 day and a.transaction_date
       group by a.transaction_id, a.customer_id""",
)
def trailing_orders(t: Tables) -> DataFrame:
    window = TimeWindow(3, "months", "rolling")
    return trailing_rows(t.txn, window.micros, "sum").select("transaction_id", "customer_id", "aggregated_value", "transaction_count")


def peak_sql(view: str, days: int, function: str) -> str:
    """The peak window by joining every start with the items of its window, as CTEs ending in ``peak``."""
    value = {
        "sum": "cast(sum(b.v) as double)", "count": "cast(count(*) as double)", "avg": "cast(sum(b.v) as double) / count(*)",
        "max": "cast(max(b.v) as double)", "min": "cast(min(b.v) as double)",
    }[function]
    return f"""with items as (
          select customer_id, transaction_date as d, {MONEY} as v, transaction_id as id,
                 row_number() over (partition by customer_id order by transaction_date, {MONEY}, transaction_id) as rn
          from {view}),
        windows as (
          select a.customer_id, a.rn, a.d as window_start, {value} as agg, count(*) as n, max(b.d) as last_d
          from items a join items b on a.customer_id = b.customer_id and b.rn >= a.rn and b.d <= a.d + interval {days} day
          group by a.customer_id, a.rn, a.d),
        ranked as (
          select *, row_number() over (partition by customer_id order by agg desc, rn) as k from windows where agg > 0),
        people as (select customer_id, max(d) as last_date, min(d) as first_date, count(*) as customer_transactions from items group by customer_id),
        peak as (
          select p.customer_id, coalesce(r.agg, 0) as aggregated_value, coalesce(r.n, 0) as transaction_count,
                 coalesce(r.last_d, p.last_date) as alert_date, r.window_start, r.window_start + interval {days} day as window_end,
                 p.customer_transactions, p.first_date, p.last_date, r.rn
          from people p left join ranked r on p.customer_id = r.customer_id and r.k = 1)
        """


PEAK_COLUMNS = "customer_id, aggregated_value, transaction_count, alert_date, window_start, customer_transactions"


def _peak(name: str, view: str, days: int, function: str) -> None:
    sql = peak_sql(view, days, function) + f"select {PEAK_COLUMNS} from peak"
    query(name, sql)(lambda t: peak_windows(getattr(t, view), days, function).select(*PEAK_COLUMNS.split(", ")))


_peak("d9_peak_sum_orders", "txn", 30, "sum")
for _function in VALUE:
    _peak(f"d9_peak_{_function}_events", "evt", 2, _function)


@query(
    "d9_peak_members",
    peak_sql("txn", 30, "sum")
    + """select p.customer_id, i.id as transaction_id from peak p join items i on p.customer_id = i.customer_id and i.rn >= p.rn and i.d <= p.window_end""",
)
def peak_members(t: Tables) -> DataFrame:
    return in_peak_window(t.txn, peak_windows(t.txn, 30, "sum")).select("customer_id", "transaction_id")


@query(
    "d10_text_values",
    """select customer_id, cast(sum(case when transaction_type = 'error' then 0 else cast(transaction_amount as decimal(18,2)) end) as double) as aggregated_value,
              count(*) as transaction_count from evt group by customer_id""",
)
def text_values(t: Tables) -> DataFrame:
    shown = F.when(F.col("transaction_type") == "error", "none").otherwise(F.col("transaction_amount").cast("string"))
    rows = t.evt.withColumn("transaction_amount", shown)
    return peak_windows(rows, 3650, "sum").select("customer_id", "aggregated_value", "transaction_count")


@query(
    "d11_minimum_count",
    peak_sql("txn", 30, "sum") + "select customer_id, aggregated_value, transaction_count from peak where transaction_count >= 3",
)
def minimum_count(t: Tables) -> DataFrame:
    rows = peak_windows(t.txn, 30, "sum").filter(F.col("transaction_count") >= 3)
    return rows.select("customer_id", "aggregated_value", "transaction_count")


@query(
    "d12_contributions",
    """with p as (select *, cast(transaction_amount as decimal(18,2)) as v from line)
       select alert_id, transaction_id, upload_id,
              cast(cast(round(cast(v as double) * 100 / cast(sum(v) over (partition by alert_id) as double), 2) as decimal(5,2)) as double) as contribution_percentage,
              row_number() over (partition by alert_id order by transaction_date, transaction_id) as sequence_order from p""",
)
def shares(t: Tables) -> DataFrame:
    done = contributions(t.line)
    return done.select(
        "alert_id", "transaction_id", "upload_id", F.col("contribution_percentage").cast("double").alias("contribution_percentage"), "sequence_order"
    )


@query(
    "d14_value_index",
    """with v as (
         select 'channel' as field_name, channel as field_value from txn union all select 'transaction_type', transaction_type from txn
         union all select 'upload_id', upload_id from txn union all select 'transaction_id', transaction_id from txn),
       c as (select field_name, field_value, count(*) as value_count from v group by all)
       select field_name, field_value, value_count, round(value_count * 100.0 / (select count(*) from txn), 2) as value_percentage
       from c where field_name in (select field_name from c group by field_name having count(*) < 1000)""",
)
def value_index(t: Tables) -> DataFrame:
    return field_value_index(t.txn, ["channel", "transaction_type", "upload_id", "transaction_id"])


@query(
    "d15_field_metadata",
    """with v as (
         select 'transaction_narrative' as f, transaction_narrative as x from evt union all select 'transaction_amount', cast(transaction_amount as varchar) from evt
         union all select 'customer_id', customer_id from evt),
       d as (select f, x, count(*) n from v where x is not null group by f, x),
       s as (select f, x, row_number() over (partition by f order by x) k from d)
       select d.f as field_name, case when d.f = 'transaction_narrative' then 'text' else 'numeric' end as field_type,
              (select count(*) from evt) as total_records, sum(n) as non_null_count, (select count(*) from evt) - sum(n) as null_count,
              count(*) as distinct_count, (select string_agg(x, '|' order by x) from s where s.f = d.f and k <= 10) as sample_values
       from d group by d.f""",
)
def metadata(t: Tables) -> DataFrame:
    done = field_metadata(t.evt, ["transaction_narrative", "transaction_amount", "customer_id"])
    return done.withColumn("sample_values", F.array_join("sample_values", "|")).drop("recommended_operators")


@query(
    "d16_beneficiary_history",
    """select beneficiary_name, count(*) as total_transactions, cast(sum(cast(transaction_amount as decimal(18,2))) as double) as total_amount,
              round(stddev_samp(transaction_amount), 4) as std_dev_amount, min(transaction_date) as first_transaction_date,
              max(transaction_date) as last_transaction_date,
              round(date_diff('day', min(transaction_date), max(transaction_date)) / (count(*) - 1.0), 6) as avg_days_between_txns
       from line group by beneficiary_name""",
)
def history(t: Tables) -> DataFrame:
    done = beneficiary_history(t.line)
    return done.withColumns(
        {"std_dev_amount": F.round("std_dev_amount", 4), "avg_days_between_txns": F.round("avg_days_between_txns", 6)}
    )


@query(
    "d17_dashboard_g",
    """select (select count(*) from txn) as transactions_scanned,
              (select count(*) from alert where risk_classification = 'HIGH' and alert_status = 'OPN') as active_high_risk_alerts,
              (select count(*) from run) as total_simulations,
              (select printf('%.1f%%', count(*) filter (enabled) * 100.0 / count(*)) from scenario) as system_coverage,
              (select case when count(*) > 50 then 'High' when count(*) > 10 then 'Medium' else 'Low' end from alert
               where risk_classification = 'HIGH' and alert_status = 'OPN') as risk_score""",
)
def dashboard_g(t: Tables) -> DataFrame:
    return dashboard_grouped(t.txn, t.alert, t.run, t.scenario)


@query(
    "d18_dashboard_p",
    """select (select count(*) from alert) as total_alerts, (select count(*) from txn) as transactions_scanned,
              (select count(*) from cust) as customers_scanned, (select count(*) from run) as total_simulations,
              (select arg_max(dataset_name, (upload_timestamp, upload_id)) from upload) as dataset_name, true as has_data""",
)
def dashboard_p(t: Tables) -> DataFrame:
    return dashboard_peak(t.txn, t.cust, t.alert, t.run, t.upload)


@query(
    "d18_recent_runs",
    """select * from (select run_id, row_number() over (order by created_at, run_id) as run_number, total_alerts, status from run)
       order by run_number desc limit 5""",
)
def recent(t: Tables) -> DataFrame:
    return recent_runs(t.run, t.scenario).select("run_id", "run_number", "total_alerts", "status")


@query(
    "d19_report_summary",
    """select (select count(*) from scenario) as total_scenarios, (select count(*) filter (enabled) from scenario) as active_scenarios,
              (select sum(total_alerts) from run) as total_alerts, (select max(created_at) from run) as last_run""",
)
def summary(t: Tables) -> DataFrame:
    return report_summary(t.scenario, t.run)


@query("d20_run_totals_g", "select run_id, count(*) filter (not excluded) as total_alerts from alert group by run_id")
def totals_g(t: Tables) -> DataFrame:
    return run_totals(t.alert, grouped=True)


@query("d20_run_totals_p", "select run_id, count(*) as total_alerts from alert group by run_id")
def totals_p(t: Tables) -> DataFrame:
    return run_totals(t.alert, grouped=False)


EXTREME = """with e as (select customer_id, transaction_id, transaction_date,
    transaction_amount * case cast(transaction_id as bigint) % 40 when 0 then 1e18 when 1 then 1e-9 else 1 end as a from evt)
  """


def extreme(t: Tables) -> DataFrame:
    key = F.col("transaction_id").cast("long") % 40
    factor = F.when(key == 0, 1e18).when(key == 1, 1e-9).otherwise(1.0)
    return t.evt.withColumn("transaction_amount", F.col("transaction_amount") * factor)


@query("d10_extreme_amounts", EXTREME + "select transaction_id, case when a < 1 then round(a, 12) else a end as a from e")
def extreme_amounts(t: Tables) -> DataFrame:
    return extreme(t).select("transaction_id", number("transaction_amount").cast("double").alias("a"))


@query(
    "d9_extreme_peaks",
    EXTREME + "select customer_id, max(a) as aggregated_value, count(*) as customer_transactions from e group by customer_id",
)
def extreme_peaks(t: Tables) -> DataFrame:
    return peak_windows(extreme(t), 30, "max").select("customer_id", "aggregated_value", "customer_transactions")


@query(
    "d12_refunds",
    """with p as (select *, cast(transaction_amount as decimal(18,2)) * case when right(transaction_id, 1) in ('3', '7') then -0.99 else 1 end as v from line)
       select alert_id, transaction_id,
              case when sum(v) over w > 0 then round(cast(v as double) * 100 / cast(sum(v) over w as double), 2) else 0 end as contribution_percentage,
              row_number() over (partition by alert_id order by transaction_date, transaction_id) as sequence_order from p window w as (partition by alert_id)""",
)
def refunds(t: Tables) -> DataFrame:
    sign = F.when(F.substring("transaction_id", -1, 1).isin("3", "7"), F.lit(-0.99)).otherwise(F.lit(1.0)).cast("decimal(4,2)")
    rows = t.line.withColumn("transaction_amount", F.col("transaction_amount").cast("decimal(18,2)") * sign)
    return contributions(rows).select("alert_id", "transaction_id", F.col("contribution_percentage").cast("double").alias("contribution_percentage"), "sequence_order")
