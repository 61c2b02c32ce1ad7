"""Thresholds, alert rules and scoring."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.aggregates import peak_sql
from catalog.base import Tables, half_up, query
from txnwatch.functions.scoring import band_score, ratio_score, score_class
from txnwatch.operators.aggregate import contributions
from txnwatch.operators.alerts import details_map
from txnwatch.operators.threshold import threshold_column
from txnwatch.plans.run import common_alerts, dry_run_grouped, dry_run_peak, rule_alerts, rule_links, run_rules
from txnwatch.rules import Threshold, make_rule

FLAGSHIP = {
    "scenario_name": "Urgent order peaks",
    "filters": [{"field": "channel", "operator": "in", "value": "1-URGENT, 2-HIGH, 3-MEDIUM"}],
    "aggregation": {"function": "sum", "field": "transaction_amount", "rolling_window_days": 30},
    "threshold": {
        "type": "dynamic",
        "dynamic": {"reference_field": "annual_income", "formula": "reference_field * 60", "min_threshold": 150000, "max_threshold": 480000},
    },
    "alert_metadata": {"severity": "HIGH", "category": "wire", "regulatory_tags": ["a", "b"]},
    "enrichment": {"include_customer_profile": True, "calculate_velocity_metrics": True, "include_geographic_risk": True},
}
ORDERS_PEAK = peak_sql("(select * from txn where channel in ('1-URGENT', '2-HIGH', '3-MEDIUM'))", 30, "sum")
BOUND = "greatest(0.0, least(480000.0, greatest(150000.0, c.annual_income * 60)))"


def peak_alert_sql(columns: str) -> str:
    return ORDERS_PEAK + f""", hits as (
        select p.*, c.customer_name, c.occupation, c.annual_income, c.account_type, c.country, c.region, {BOUND} as threshold
        from peak p join cust c on p.customer_id = c.customer_id where p.aggregated_value >= {BOUND})
        select {columns} from hits"""


def flagship(t: Tables) -> DataFrame:
    return rule_alerts(t.txn, t.cust, make_rule("S1", FLAGSHIP), "R1")


@query(
    "e12_peak_alerts",
    peak_alert_sql(
        """customer_id, customer_name, alert_date, aggregated_value, threshold, transaction_count, 'HIGH' as risk_classification,
           cast(least(100, floor(aggregated_value / threshold * 50)) as integer) as risk_score,
           'Customer ' || customer_name || ' (' || occupation || ', Income: ' || cast(annual_income as varchar) || ') triggered ''Urgent order peaks''. '
           || 'SUM(transaction_amount): ' || format('{:,.2f}', aggregated_value) || ' across ' || cast(transaction_count as varchar)
           || ' transactions in 30-day window. Dynamic threshold of ' || format('{:,.2f}', threshold)
           || ' used (formula: reference_field * 60, based on annual_income). ' as trigger_reason"""
    ),
)
def peak_alert_rows(t: Tables) -> DataFrame:
    return flagship(t).select(
        "customer_id", "customer_name", "alert_date", "aggregated_value", "threshold", "transaction_count",
        "risk_classification", "risk_score", "trigger_reason",
    )


@query(
    "e13_trigger_details",
    peak_alert_sql(
        """customer_id, aggregated_value, 'SUM' as aggregation_function, 'transaction_amount' as aggregation_field,
           30 as rolling_window_days, threshold as threshold_used, 'dynamic' as threshold_type, transaction_count"""
    ),
)
def trigger_details(t: Tables) -> DataFrame:
    return flagship(t).select("customer_id", "trigger_details.*")


@query(
    "e15_metadata",
    peak_alert_sql(
        """customer_id, 'HIGH' as severity, 'wire' as category, '' as sub_category, 'a,b' as regulatory_tags,
           3 as investigation_priority, false as auto_escalate"""
    ),
)
def metadata(t: Tables) -> DataFrame:
    return flagship(t).select("customer_id", "alert_metadata.*").withColumn("regulatory_tags", F.array_join("regulatory_tags", ","))


@query(
    "e16_enrichment",
    peak_alert_sql(
        """customer_id, customer_name as name, occupation, cast(annual_income as varchar) as annual_income, account_type,
           'Retail' as customer_type, country, region"""
    ),
)
def enrichment(t: Tables) -> DataFrame:
    rows = flagship(t).select("customer_id", "enrichment_data.customer_profile.*", "enrichment_data.geographic_risk.*")
    return rows.drop("risk_score")


@query(
    "d13_velocity",
    peak_alert_sql(
        f"""customer_id,
           case when customer_transactions > 1 then {half_up("customer_transactions / cast(greatest(date_diff('day', first_date, last_date), 1) as double)", 2)} end as transactions_per_day,
           case when customer_transactions > 1 then {half_up("aggregated_value / customer_transactions", 2)} end as avg_amount_per_transaction,
           case when customer_transactions > 1 then greatest(date_diff('day', first_date, last_date), 1) end as date_range_days"""
    ),
)
def velocity(t: Tables) -> DataFrame:
    return flagship(t).select("customer_id", "enrichment_data.velocity_metrics.*")


@query(
    "e18_alert_id",
    ORDERS_PEAK
    + f"""select sha256(concat_ws('/', 'R1', 'S1', p.customer_id, cast(epoch_us(p.window_end) as varchar), cast(cast(p.aggregated_value as decimal(24,6)) as varchar))) as alert_id,
            p.customer_id from peak p join cust c on p.customer_id = c.customer_id where p.aggregated_value >= {BOUND}""",
)
def ids(t: Tables) -> DataFrame:
    return flagship(t).select("alert_id", "customer_id")


def threshold_query(name: str, config: Threshold, sql: str) -> None:
    """A threshold on every customer."""
    query(name, f"select customer_id, {sql} as threshold from cust")(
        lambda t: t.cust.select("customer_id", threshold_column(config, t.cust.columns).alias("threshold"))
    )


threshold_query("e1_fixed", Threshold("fixed", 12345.0), "cast(12345 as double)")
threshold_query(
    "e2_segment_map",
    Threshold("segment_based", segment_field="occupation", segments=(("BUILDING", 100.0), ("machinery", 5.0), ("MACHINERY", 7.0)), default=99.0),
    "cast(case occupation when 'BUILDING' then 100 when 'MACHINERY' then 7 else 99 end as double)",
)
threshold_query(
    "e3_segment_list",
    Threshold("segment", segment_field="occupation", segments=(("building", 100.0), ("machinery", 7.0), ("building", 1.0))),
    "case lower(trim(occupation)) when 'building' then 100.0 when 'machinery' then 7.0 else cast('inf' as double) end",
)
threshold_query("e3_no_config", Threshold("segment"), "cast('inf' as double)")
threshold_query(
    "e4_field_based",
    Threshold("field_based", reference_field="annual_income", formula="reference_field ** 2 / (reference_field - reference_field) + 1"),
    "cast(0 as double)",
)
threshold_query(
    "e4_field_formula",
    Threshold("field_based", reference_field="risk_score", formula="reference_field * 10 / 4 - -1"),
    "cast(risk_score * 10.0 / 4 + 1 as double)",
)
threshold_query("e4_rejected_text", Threshold("field_based", reference_field="risk_score", formula="__import__('os')"), "cast(0 as double)")
threshold_query(
    "e5_dynamic",
    Threshold("dynamic", reference_field="annual_income", formula="max(reference_field, 100) * 0.5", minimum=200.0, maximum=4000.0),
    "least(4000.0, greatest(200.0, greatest(annual_income, 100.0) * 0.5))",
)
threshold_query(
    "e5_dynamic_floor", Threshold("dynamic", reference_field="annual_income", formula="reference_field"), "greatest(0.0, annual_income)"
)
threshold_query(
    "e5_old_spelling", Threshold("dynamic", reference_field="annual_income", formula="customer.annual_income * 0.5"), "greatest(0.0, annual_income * 0.5)"
)
threshold_query(
    "e5_fallback",
    Threshold("dynamic", reference_field="occupation", formula="reference_field * 2", fallback=321.0),
    "cast(321 as double)",
)
threshold_query(
    "e5_divide_by_zero",
    Threshold("dynamic", reference_field="risk_score", formula="100 / reference_field", fallback=321.0),
    "case when risk_score = 0 then 321.0 else 100.0 / risk_score end",
)
threshold_query("e5_missing_field", Threshold("dynamic", reference_field="nowhere", formula="reference_field + 5"), "cast(5 as double)")


@query("e9_band_score", "select alert_id, case when aggregated_value >= 100000 then 85 when aggregated_value >= 50000 then 70 when aggregated_value >= 20000 then 55 when aggregated_value >= 10000 then 40 else 25 end as score from alert")
def bands(t: Tables) -> DataFrame:
    return t.alert.select("alert_id", band_score("aggregated_value").alias("score"))


@query(
    "e10_ratio_score",
    """select customer_id, case when annual_income > 0 then cast(least(100.0, floor(3000 / annual_income * 50)) as integer) else 50 end as score from cust""",
)
def ratio(t: Tables) -> DataFrame:
    return t.cust.select("customer_id", ratio_score(F.lit(3000.0), "annual_income").alias("score"))


@query("e11_classification", "select alert_id, case when risk_score >= 70 then 'HIGH' when risk_score >= 40 then 'MEDIUM' else 'LOW' end as class from alert")
def classification(t: Tables) -> DataFrame:
    return t.alert.select("alert_id", score_class("risk_score").alias("class"))


CALENDAR = {
    "aggregation": {"method": "sum", "field": "transaction_amount", "group_by": ["customer_id"], "time_window": {"value": 7, "unit": "days", "type": "calendar"}},
    "threshold": {"type": "fixed", "fixed_value": 400000},
}
WEEK = "timestamp '1970-01-01' + interval 7 day * (date_diff('day', date '1970-01-01', cast(transaction_date as date)) // 7)"
BAND = "case when v >= 100000 then 85 when v >= 50000 then 70 when v >= 20000 then 55 when v >= 10000 then 40 else 25 end"


@query(
    "e7_grouped_alerts",
    f"""with g as (select customer_id, {WEEK} as w, cast(sum(cast(transaction_amount as decimal(18,2))) as double) as v, count(*) as n,
                         max(transaction_date) as alert_date from txn group by 1, 2)
        select g.customer_id, c.customer_name, alert_date, v as aggregated_value, 400000.0 as threshold, n as transaction_count,
               {BAND} as risk_score, 'HIGH' as risk_classification from g join cust c on g.customer_id = c.customer_id where v > 400000""",
)
def grouped(t: Tables) -> DataFrame:
    return rule_alerts(t.txn, t.cust, make_rule("G1", CALENDAR), "R1").select(
        "customer_id", "customer_name", "alert_date", "aggregated_value", "threshold", "transaction_count", "risk_score", "risk_classification"
    )


@query(
    "e7_expression",
    """with g as (select customer_id, cast(sum(cast(transaction_amount as decimal(18,2))) as double) as v, count(*) as n from txn group by 1)
       select g.customer_id, v as aggregated_value, n as transaction_count from g join cust c on g.customer_id = c.customer_id
       where v >= case occupation when 'BUILDING' then 1000000 when 'MACHINERY' then 2000000 else 1500000 end
         and v > case occupation when 'BUILDING' then 1000000 when 'MACHINERY' then 2000000 else 1500000 end * 1.1 and n >= 8
         and occupation in ('BUILDING', 'MACHINERY', 'FURNITURE')""",
)
def expression(t: Tables) -> DataFrame:
    config = {
        "aggregation": {"method": "sum", "field": "transaction_amount", "group_by": ["customer_id"]},
        "threshold": {"type": "segment_based", "segment_based": {"segment_field": "occupation", "values": {"BUILDING": 1000000, "MACHINERY": 2000000}, "default": 1500000}},
        "alert_condition": {"expression": "aggregated_value > threshold * 1.1 and txn_count >= 8 and occupation in ['BUILDING', 'MACHINERY', 'FURNITURE']"},
    }
    return rule_alerts(t.txn, t.cust, make_rule("G2", config), "R1").select("customer_id", "aggregated_value", "transaction_count")


@query(
    "e8_additional_conditions",
    """with g as (select customer_id, cast(sum(cast(transaction_amount as decimal(18,2))) as double) as v, count(*) as n from txn group by 1)
       select customer_id, v as aggregated_value, n as transaction_count from g where v > 1000000 and n >= 6""",
)
def additional(t: Tables) -> DataFrame:
    config = {
        "aggregation": {"method": "sum", "field": "transaction_amount", "group_by": ["customer_id"]},
        "threshold": {"type": "fixed", "fixed_value": 1000000},
        "alert_condition": {"additional_conditions": [{"field": "transaction_count", "operator": ">=", "value": 6}]},
    }
    return rule_alerts(t.txn, t.cust, make_rule("G3", config), "R1").select("customer_id", "aggregated_value", "transaction_count")


@query("e7_neither", "select customer_id, transaction_count from (select '' as customer_id, count(*) as transaction_count from txn) where false")
def neither(t: Tables) -> DataFrame:
    config = {"aggregation": {"method": "sum", "field": "transaction_amount", "group_by": ["customer_id"]}}
    return rule_alerts(t.txn, t.cust, make_rule("G4", config), "R1").select("customer_id", "transaction_count")


@query(
    "e14_details_map",
    """select alert_id, unnest(['alert_id', 'risk_score', 'excluded']) as key,
              unnest([alert_id, cast(risk_score as varchar), cast(excluded as varchar)]) as value from alert""",
)
def details(t: Tables) -> DataFrame:
    return t.alert.select("alert_id", F.explode(details_map(["alert_id", "risk_score", "excluded"])).alias("key", "value"))


ROLLING = {
    "filters": [{"field": "transaction_type", "operator": "in", "value": ["purchase", "signup", "click"]}],
    "aggregation": {"method": "sum", "field": "transaction_amount", "group_by": ["customer_id"], "time_window": {"value": 1, "unit": "days", "type": "rolling"}},
    "threshold": {"type": "fixed", "fixed_value": 200},
}
ROLLING_SQL = """with e as (select * from evt where transaction_type in ('purchase', 'signup', 'click')),
    r as (select a.customer_id, a.transaction_date as alert_date, cast(sum(cast(b.transaction_amount as decimal(18,2))) as double) as v, count(*) as n
          from (select distinct customer_id, transaction_date from e) a join e b on a.customer_id = b.customer_id
               and b.transaction_date between a.transaction_date - interval 1 day and a.transaction_date group by 1, 2),
    k as (select *, row_number() over (partition by customer_id, cast(alert_date as date) order by alert_date) as place from r where v > 200),
    a as (select * from k where place = 1)
    """


@query("e17_rolling_dedup", ROLLING_SQL + "select customer_id, alert_date, v as aggregated_value, n as transaction_count from a")
def rolling(t: Tables) -> DataFrame:
    return rule_alerts(t.evt, t.cust, make_rule("G5", ROLLING), "R1").select("customer_id", "alert_date", "aggregated_value", "transaction_count")


@query(
    "e17_rolling_links",
    ROLLING_SQL
    + """select a.customer_id, a.alert_date, e.transaction_id from a join e on a.customer_id = e.customer_id
            and e.transaction_date between a.alert_date - interval 1 day and a.alert_date""",
)
def rolling_links(t: Tables) -> DataFrame:
    rule = make_rule("G5", ROLLING)
    alerts = rule_alerts(t.evt, t.cust, rule, "R1")
    return rule_links(t.evt, t.cust, alerts, rule).select("customer_id", F.col("window_end").alias("alert_date"), "transaction_id")


@query(
    "e18_customer_of_first_transaction",
    """select channel, arg_min(customer_id, (transaction_date, transaction_id)) as customer_id, count(*) as transaction_count
       from txn group by channel having sum(cast(transaction_amount as decimal(18,2))) > 1000""",
)
def back_fill(t: Tables) -> DataFrame:
    config = {"aggregation": {"method": "sum", "field": "transaction_amount", "group_by": ["channel"]}, "threshold": {"type": "fixed", "fixed_value": 1000}}
    return rule_alerts(t.txn, t.cust, make_rule("G6", config), "R1").select("channel", "customer_id", "transaction_count")


@query(
    "e19_multi_rule_run",
    ORDERS_PEAK
    + f""", g as (select customer_id, {WEEK} as w, cast(sum(cast(transaction_amount as decimal(18,2))) as double) as v from txn group by 1, 2)
      select 'S1' as scenario_id, p.customer_id, p.aggregated_value from peak p join cust c on p.customer_id = c.customer_id where p.aggregated_value >= {BOUND}
      union all select 'G1', customer_id, v from g where v > 400000""",
)
def multi_rule(t: Tables) -> DataFrame:
    broken = {"aggregation": {"method": "median", "group_by": ["customer_id"]}}
    result = run_rules({"S1": FLAGSHIP, "bad": broken, "G1": CALENDAR}, t.txn, t.cust, "R1", with_links=False)
    assert list(result.rejected) == ["bad"]
    return result.alerts.select("scenario_id", "customer_id", "aggregated_value")


@query(
    "e19_run_links",
    ORDERS_PEAK
    + f""", h as (select p.* from peak p join cust c on p.customer_id = c.customer_id where p.aggregated_value >= {BOUND}),
      l as (select h.customer_id, i.id as transaction_id, i.d, i.v from h join items i on h.customer_id = i.customer_id and i.rn >= h.rn and i.d <= h.window_end)
      select transaction_id, row_number() over (partition by customer_id order by d, transaction_id) as sequence_order,
             cast(cast(round(cast(v as double) * 100 / cast(sum(v) over (partition by customer_id) as double), 2) as decimal(5,2)) as double) as contribution_percentage from l""",
)
def run_links(t: Tables) -> DataFrame:
    rule = make_rule("S1", FLAGSHIP)
    done = contributions(rule_links(t.txn, t.cust, rule_alerts(t.txn, t.cust, rule, "R1"), rule))
    return done.select("transaction_id", "sequence_order", F.col("contribution_percentage").cast("double").alias("contribution_percentage"))


@query(
    "e19_common_shape",
    peak_alert_sql(
        """customer_id, 'Generated by Urgent order peaks' as scenario_description, 'OPN' as alert_status, false as excluded,
           transaction_count as details_count"""
    ),
)
def common_shape(t: Tables) -> DataFrame:
    marked = flagship(t).withColumns(
        {
            "excluded": F.lit(False), "exclusion_reason": F.lit(None).cast("string"),
            "exclusion_rule_id": F.lit(None).cast("string"), "risk_flags": F.lit(None).cast("string"),
        }
    )
    return common_alerts(marked).select(
        "customer_id", "scenario_description", "alert_status", "excluded",
        F.get_json_object("trigger_details", "$.transaction_count").cast("long").alias("details_count"),
    )


@query(
    "e20_dry_run_g",
    f"""with chosen as (select customer_id from cust order by customer_id limit 20),
        g as (select customer_id, {WEEK} as w, cast(sum(cast(transaction_amount as decimal(18,2))) as double) as v from txn
              where customer_id in (select customer_id from chosen) group by 1, 2)
        select count(*) as alert_count, (select count(*) from cust) as sample_size,
               cast(floor(count(*) / least(20, (select count(*) from cust)) * (select count(*) from cust) * 1.5) as bigint) as estimated_monthly_volume
        from g where v > 300000""",
)
def dry_run(t: Tables) -> DataFrame:
    config = {**CALENDAR, "threshold": {"type": "fixed", "fixed_value": 300000}}
    return dry_run_grouped(t.txn, t.cust, make_rule("G1", config))[0]


@query("e20_dry_run_p", peak_alert_sql("count(*) as alerts_generated"))
def dry_run_p(t: Tables) -> DataFrame:
    return dry_run_peak(t.txn, t.cust, make_rule("S1", FLAGSHIP))[0]


@query("e20_dry_run_samples_p", peak_alert_sql("customer_id, aggregated_value") + " order by customer_id limit 10")
def dry_run_samples(t: Tables) -> DataFrame:
    return dry_run_peak(t.txn, t.cust, make_rule("S1", FLAGSHIP))[1].select("customer_id", "aggregated_value")


@query(
    "e19_whole_run",
    ORDERS_PEAK
    + f""", h as (select p.* from peak p join cust c on p.customer_id = c.customer_id where p.aggregated_value >= {BOUND}),
      s1 as (select 'S1' as scenario_id, h.customer_id, h.aggregated_value, h.transaction_count, count(i.id) as links
             from h join items i on h.customer_id = i.customer_id and i.rn >= h.rn and i.d <= h.window_end group by all),
      g as (select customer_id, {WEEK} as w, cast(sum(cast(transaction_amount as decimal(18,2))) as double) as v, count(*) as n from txn group by 1, 2)
      select *, 'completed' as status, 4 as scenarios, (select count(*) from s1) + (select count(*) from g where v > 400000) as total_alerts
      from (select * from s1 union all select 'G1', customer_id, v, n, n from g where v > 400000)""",
)
def whole_run(t: Tables) -> DataFrame:
    """Alerts with their stored links and the run record; two bad rules cost the others nothing."""
    broken = {"aggregation": {"method": "median", "group_by": ["customer_id"]}}
    unknown = {**CALENDAR, "aggregation": {**CALENDAR["aggregation"], "group_by": ["no_such_column"]}}
    result = run_rules({"S1": FLAGSHIP, "bad": broken, "lost": unknown, "G1": CALENDAR}, t.txn, t.cust, "R1")
    assert sorted(result.rejected) == ["bad", "lost"]
    links = result.alert_transactions.groupBy("alert_id").agg(F.count(F.lit(1)).alias("links"))
    record = result.record("2001-01-01 00:00:00").select("run_id", "status", F.size("scenarios_run").alias("scenarios"), "total_alerts")
    return (
        result.alerts.join(links, "alert_id").join(record, "run_id")
        .select("scenario_id", "customer_id", "aggregated_value", "transaction_count", "links", "status", "scenarios", "total_alerts")
    )


@query(
    "e19_refined_without_whitelist",
    f"""with g as (select customer_id, {WEEK} as w, cast(sum(cast(transaction_amount as decimal(18,2))) as double) as v, max(transaction_date) as at from evt group by 1, 2)
        select customer_id, w, exists (select 1 from evt e where e.customer_id = g.customer_id and e.transaction_narrative = 'Loan EMI payment'
                                       and e.transaction_date between g.at - interval 30 day and g.at) as excluded from g where v > 100""",
)
def without_whitelist(t: Tables) -> DataFrame:
    rule = {
        **CALENDAR, "threshold": {"type": "fixed", "fixed_value": 100},
        "refinements": [{"type": "event_based", "rule_id": "loans", "excluded_events": ["loan"]}],
    }
    alerts = run_rules({"G2": rule}, t.evt, t.cust, "R2", with_links=False).alerts
    week = F.timestamp_micros(F.floor(F.unix_micros("alert_date") / F.lit(7 * 86_400_000_000)).cast("long") * F.lit(7 * 86_400_000_000))
    return alerts.select("customer_id", week.alias("w"), "excluded")
