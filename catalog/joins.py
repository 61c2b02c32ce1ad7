"""Joins (C1-C14)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import Tables, query
from txnwatch.operators.compare import customer_counts, customer_sets
from txnwatch.operators.enrich import add_customer_fields, enrich_with_customers, linked_transactions, scenario_names
from txnwatch.operators.refine import alerts_with_keywords, lookback, verified_names
from txnwatch.rules import customer_fields_of, make_rule


@query(
    "c1_enrich_g",
    """select transaction_id, t.customer_id, t.upload_id, occupation, c.upload_id as upload_id_cust
       from txn t left join cust c on t.customer_id = c.customer_id""",
)
def enrich_g(t: Tables) -> DataFrame:
    doubled = t.cust.unionByName(t.cust.withColumn("occupation", F.lit("ZZZ")))
    rows = t.txn.select("transaction_id", "customer_id", "upload_id")
    return enrich_with_customers(rows, doubled, ["occupation", "upload_id"], [F.col("occupation") == "ZZZ"])


@query(
    "c2_enrich_p",
    """select transaction_id, t.customer_id, customer_name, annual_income from txn t
       left join (select * from cust where occupation <> 'BUILDING') c on t.customer_id = c.customer_id""",
)
def enrich_p(t: Tables) -> DataFrame:
    some = t.cust.filter(F.col("occupation") != "BUILDING")
    return enrich_with_customers(t.txn.select("transaction_id", "customer_id"), some, ["customer_name", "annual_income"])


@query(
    "c3_required_columns",
    """select t.transaction_id, t.customer_id, annual_income, country, customer_name, occupation, account_type, risk_score, customer_type
       from txn t join cust c on t.customer_id = c.customer_id""",
)
def required(t: Tables) -> DataFrame:
    rule = make_rule("S", {
        "filters": [{"field": "customer_type", "operator": "==", "value": "Retail"}, {"field": "country", "operator": "!=", "value": "x"}],
        "aggregation": {"method": "sum", "group_by": ["customer_id"]},
        "alert_condition": {"expression": "aggregated_value > annual_income"},
    })
    fields = customer_fields_of(rule, t.cust.columns, t.txn.columns)
    return enrich_with_customers(t.txn.select("transaction_id", "customer_id"), t.cust, fields, how="inner")


@query(
    "c4_segment_join",
    """select a.customer_id, n, occupation from (select customer_id, count(*) n from txn group by customer_id) a
       left join cust c on a.customer_id = c.customer_id""",
)
def segment_join(t: Tables) -> DataFrame:
    totals = t.txn.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    return add_customer_fields(totals, t.cust, ["occupation", "n"])


@query("c5_inner_join", "select transaction_id, t.customer_id, region from txn t join cust c on t.customer_id = c.customer_id where region = 'ASIA'")
def inner_join(t: Tables) -> DataFrame:
    some = t.cust.filter(F.col("region") == "ASIA")
    return enrich_with_customers(t.txn.select("transaction_id", "customer_id"), some, ["region"], how="inner")


@query(
    "c6_whitelist",
    """select distinct lower(b.beneficiary_name) as _key, e.entity_type
       from (select distinct beneficiary_name from evt where beneficiary_name <> '') b
       join entities e on e.is_active and contains(lower(e.entity_name), lower(b.beneficiary_name))""",
)
def whitelist(t: Tables) -> DataFrame:
    return verified_names(t.evt, t.entities)


@query(
    "c7_lookback",
    """select a.alert_id, a.customer_id, count(t.transaction_id) as lookback_transactions,
              cast(coalesce(sum(cast(transaction_amount as decimal(18,2))), 0) as double) as lookback_amount,
              min(t.transaction_date) as lookback_first, max(t.transaction_date) as lookback_last
       from old a left join txn t on a.customer_id = t.customer_id and t.transaction_date between a.alert_date - interval 30 day and a.alert_date
       group by a.alert_id, a.customer_id""",
)
def lookback_summary(t: Tables) -> DataFrame:
    return lookback(t.old, t.txn)


@query(
    "c8_keyword_semi_join",
    """select alert_id, customer_id from old where customer_id in
       (select customer_id from evt where regexp_matches(lower(transaction_narrative), 'tuition|university|college|school|loan|mortgage|credit'))""",
)
def keyword_semi(t: Tables) -> DataFrame:
    return alerts_with_keywords(t.old, t.evt, ["education", "loan"]).select("alert_id", "customer_id")


@query(
    "c9_run_diff",
    """select coalesce(o.customer_id, n.customer_id) as customer_id, coalesce(o.c, 0) as baseline_alerts, coalesce(n.c, 0) as refined_alerts,
              coalesce(n.c, 0) - coalesce(o.c, 0) as net_change
       from (select customer_id, count(*) c from old group by 1) o full outer join (select customer_id, count(*) c from new group by 1) n
       on o.customer_id = n.customer_id""",
)
def run_diff(t: Tables) -> DataFrame:
    return customer_counts(t.old, t.new)


@query(
    "c10_customer_sets",
    """select customer_id, case when customer_id not in (select customer_id from new) then 'removed'
              when customer_id not in (select customer_id from old) then 'added' else 'maintained' end as status
       from (select customer_id from old union select customer_id from new)""",
)
def sets(t: Tables) -> DataFrame:
    return customer_sets(t.old, t.new)


@query(
    "c11_risk_profile",
    """select alert_id, a.customer_id, is_pep, previous_sar_count from old a left join profile p on a.customer_id = p.customer_id""",
)
def risk_profile(t: Tables) -> DataFrame:
    return add_customer_fields(t.old.select("alert_id", "customer_id"), t.profile, ["is_pep", "previous_sar_count"])


@query(
    "c12_customer_flags",
    """select alert_id, a.customer_id, risk_score, account_type from (select alert_id, customer_id from old) a
       left join cust c on a.customer_id = c.customer_id""",
)
def customer_flags(t: Tables) -> DataFrame:
    return add_customer_fields(t.old.select("alert_id", "customer_id"), t.cust, ["risk_score", "account_type"])


@query(
    "c13_scenario_names",
    """with l as (select run_id, unnest(scenarios_run) as scenario_id, generate_subscripts(scenarios_run, 1) as place from run)
       select l.run_id, string_agg(coalesce(scenario_name, l.scenario_id), '|' order by place) as names
       from l left join scenario s on l.scenario_id = s.scenario_id group by l.run_id""",
)
def names(t: Tables) -> DataFrame:
    return scenario_names(t.run, t.scenario).select("run_id", F.array_join("scenario_names", "|").alias("names"))


@query(
    "c14_traceability",
    """select l.transaction_id, a.alert_id, a.customer_id, l.transaction_amount from old a join line l on a.alert_id = l.alert_id""",
)
def traceability(t: Tables) -> DataFrame:
    links = t.line.select("alert_id", "transaction_id")
    rows = t.line.select("transaction_id", "transaction_amount")
    return linked_transactions(t.old.select("alert_id", "customer_id"), links, rows)
