"""Comparison of runs and risk of suppression."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import Tables, half_up, query
from catalog.ingest import DIFF
from txnwatch.functions.scoring import gap_level
from txnwatch.operators import compare, risk
from txnwatch.operators.reports import recent_runs, run_alerts, run_detail, run_list
from txnwatch.plans.compare import compare_runs
from txnwatch.rules import Refinement


@query(
    "g1_summary_p",
    f"""with b as (select count(*) as n from old), r as (select count(*) as n from new)
        select b.n as baseline_alerts, r.n as refined_alerts, b.n - r.n as net_change, {half_up("(b.n - r.n) * 100.0 / b.n", 2)} as reduction_rate,
               (select count(*) from (select customer_id from old intersect select customer_id from new)) as maintained_customers,
               (select count(*) from (select customer_id from old except select customer_id from new)) as removed_customers,
               (select count(*) from (select customer_id from new except select customer_id from old)) as added_customers from b, r""",
)
def summary_p(t: Tables) -> DataFrame:
    return compare.summary_peak(t.old, t.new)


@query(
    "g1_summary_visible_p",
    f"""with b as (select count(*) as n from old where not excluded), r as (select count(*) as n from new where not excluded)
        select b.n as baseline_alerts, r.n as refined_alerts, {half_up("(b.n - r.n) * 100.0 / b.n", 2)} as reduction_rate from b, r""",
)
def summary_visible(t: Tables) -> DataFrame:
    return compare.summary_peak(t.old, t.new, exclude_suppressed=True).select("baseline_alerts", "refined_alerts", "reduction_rate")


@query(
    "g2_summary_g",
    f"""with b as (select count(*) as n from old), r as (select count(*) as n from new)
        select b.n as baseline_alerts, r.n as refined_alerts, b.n - r.n as net_change, {half_up("(b.n - r.n) * 100.0 / b.n", 2)} as percent_reduction from b, r""",
)
def summary_g(t: Tables) -> DataFrame:
    return compare.summary_grouped(t.old, t.new)


@query("g3_customer_diff", DIFF + "select * from j")
def diff(t: Tables) -> DataFrame:
    return compare.diff_peak(t.old, t.new, limit=None)


@query("g3_customer_diff_top", DIFF + "select * from j order by risk_score desc, customer_id limit 100")
def diff_top(t: Tables) -> DataFrame:
    return compare.diff_peak(t.old, t.new)


REMOVED = """with gone as (select * from old where customer_id not in (select customer_id from new)),
    m as (select customer_id, cast(sum(cast(l.transaction_amount as decimal(18,2))) as double) as s from gone g join line l on g.alert_id = l.alert_id group by 1),
    h as (select customer_id, count(*) as alert_count, string_agg(distinct scenario_id, ',' order by scenario_id) as scenarios,
                 max(case when risk_score > 0 then risk_score when risk_classification = 'HIGH' then 75 when risk_classification = 'LOW' then 25 else 50 end) as max_risk_score
          from gone group by 1),
    j as (select h.customer_id, 'removed' as status, alert_count, coalesce(s, 0) as total_amount, max_risk_score, scenarios
          from h left join m on h.customer_id = m.customer_id)
    """


def removed(t: Tables, limit: int | None) -> DataFrame:
    rows = t.line.select("alert_id", "transaction_id", "transaction_amount")
    links = rows.select("alert_id", "transaction_id")
    done = compare.diff_grouped(t.old, t.new, links, rows.select("transaction_id", "transaction_amount"), limit)
    return done.withColumn("scenarios", F.array_join("scenarios", ","))


@query("g4_removed_customers", REMOVED + "select * from j")
def removed_all(t: Tables) -> DataFrame:
    return removed(t, None)


@query("g4_removed_customers_top", REMOVED + "select * from j order by max_risk_score desc, customer_id limit 50")
def removed_top(t: Tables) -> DataFrame:
    return removed(t, 50)


EXPOSED = """, d as (select * from j order by {score} desc, customer_id limit {limit}),
    p as (select *, row_number() over (order by {score} desc, customer_id) as k from d)
    select (select round(avg({score}), 2) from p where k <= 10) as risk_score, 'CRITICAL' as risk_level,
           (select string_agg('Customer ' || customer_id || ': $' || format('{{:,.0f}}', {amount}) || ' suppressed (score: ' || cast({score} as varchar) || ')', '|' order by k)
            from p where k <= 3) as sample_exploits, count(*) as high_risk_suppressions, count(*) as total_suppressions from p"""


@query("g5_exposure_p", DIFF + EXPOSED.format(score="risk_score", limit=100, amount="amount"))
def exposure_p(t: Tables) -> DataFrame:
    return compare.exposure(compare.diff_peak(t.old, t.new)).withColumn("sample_exploits", F.array_join("sample_exploits", "|"))


@query("g5_exposure_g", REMOVED + EXPOSED.format(score="max_risk_score", limit=50, amount="total_amount"))
def exposure_g(t: Tables) -> DataFrame:
    done = compare.exposure(removed(t, 50), "max_risk_score", "total_amount")
    return done.withColumn("sample_exploits", F.array_join("sample_exploits", "|"))


@query(
    "g5_exposure_empty",
    "select 0.0 as risk_score, 'SAFE' as risk_level, '' as sample_exploits, 0 as high_risk_suppressions, 0 as total_suppressions from (select count(*) from old)",
)
def exposure_empty(t: Tables) -> DataFrame:
    same = removed(t, 50).filter(F.col("status") == "added")
    return compare.exposure(same, "max_risk_score", "total_amount").withColumn("sample_exploits", F.array_join("sample_exploits", "|"))


@query(
    "g6_efficiency",
    REMOVED
    + f""", p as (select max_risk_score as s from j order by max_risk_score desc, customer_id limit 10)
      select (select count(*) from old) - (select count(*) from new) as alerts_delta,
             round({half_up("((select count(*) from old) - (select count(*) from new)) * 100.0 / (select count(*) from old)", 2)}
                   * (1 - (select round(avg(s), 2) from p) / 100), 6) as efficiency_score, (select count(*) from new) as overlap_count""",
)
def efficiency(t: Tables) -> DataFrame:
    risk_row = compare.exposure(removed(t, 50), "max_risk_score", "total_amount")
    done = compare.efficiency(compare.summary_grouped(t.old, t.new), risk_row)
    return done.withColumn("efficiency_score", F.round("efficiency_score", 6))


@query(
    "g7_latest_run",
    """select 'by rule' as how, run_id from (select run_id from run where status = 'completed' and list_contains(scenarios_run, 'S3') order by created_at desc, run_id desc limit 1)
       union all select 'by id', run_id from run where run_id = 'RUN1996'
       union all select 'recent', run_id from (select * from (select * from run order by created_at desc, run_id desc limit 50)
           where list_contains(scenarios_run, 'S5') order by created_at desc, run_id desc limit 1)""",
)
def latest(t: Tables) -> DataFrame:
    found = {
        "by rule": compare.latest_run(t.run, "S3"),
        "by id": compare.latest_run(t.run, "RUN1996"),
        "recent": compare.latest_run(t.run, "S5", completed_only=False, last=50),
    }
    rows = [df.select(F.lit(how).alias("how"), "run_id") for how, df in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


RULES = [Refinement("a", ("education",)), Refinement("b", ("loan",)), Refinement("c", ("education", "loan"))]
# The transaction of an alert names its beneficiary: the supplier with the number of the customer's nation.
NAMED = """named as (select a.*, s_name as beneficiary_name from old a join customer on cast(c_custkey as varchar) = a.customer_id
                     join supplier on s_suppkey = c_nationkey % 10)"""


def named(t: Tables) -> DataFrame:
    people = t.read("customer").select(F.col("c_custkey").cast("string").alias("customer_id"), (F.col("c_nationkey") % 10).cast("long").alias("s_suppkey"))
    suppliers = t.read("supplier").select("s_suppkey", F.col("s_name").alias("beneficiary_name"))
    return t.old.join(people, "customer_id").join(suppliers, "s_suppkey").drop("s_suppkey")


SCORED_P = """with hit as (select * from old where trigger_reason in ('University payment', 'Tuition due')),
    s as (select h.alert_id, h.aggregated_value as amount, (p.is_pep or false) as pep, p.has_adverse_media as media, c.risk_score > 15 as high
          from hit h join profile p on h.customer_id = p.customer_id join cust c on c.customer_id = h.customer_id),
    scored as (select alert_id, 'Education Exclusion' as reason,
        (case when amount > 50000 then 15 else 0 end + case when pep then 25 else 0 end + case when media then 20 else 0 end + case when high then 10 else 0 end) * 1.0 as score,
        concat_ws(', ', case when amount > 50000 then 'High amount for Education: ' || format('{:,.2f}', amount) end,
                  case when pep then 'Customer is PEP' end, case when media then 'Adverse Media found' end, case when high then 'High Risk Customer' end) as factors
        from s)
    """


def flagged(t: Tables) -> DataFrame:
    """Customers with the fields a peak payload may carry."""
    return t.cust.join(t.profile, "customer_id").select(
        "customer_id",
        F.col("is_pep").alias("pep_flag"),
        F.col("has_adverse_media").cast("string").alias("adverse_media"),
        F.when(F.col("risk_score") > 15, "high").otherwise("low").alias("risk_rating"),
    )


def scored_p(t: Tables) -> DataFrame:
    return risk.score_peak(risk.gap_candidates(t.old, RULES), flagged(t))


@query("g10_alert_risk_p", SCORED_P + "select alert_id, reason, score, factors from scored")
def alert_risk_p(t: Tables) -> DataFrame:
    return scored_p(t).withColumn("factors", F.array_join("factors", ", "))


REPORT = """select least(100.0, sum(score)) as risk_score, case when sum(score) > 60 then 'CRITICAL' when sum(score) > 30 then 'DANGEROUS' when sum(score) > 0 then 'CAUTION' else 'SAFE' end as risk_level,
    count(*) as excluded_count from scored"""


@query("g8_gap_p", SCORED_P + REPORT)
def gap_p(t: Tables) -> DataFrame:
    return risk.gap_report(scored_p(t)).drop("sample_exploits")


def scored_g_sql(times: int, source: str, reason: str) -> str:
    return f"""with {NAMED}, hit as (select *, {reason} as reason from ({source}) x),
    known as (select distinct lower(h.beneficiary_name) as b from (select distinct beneficiary_name from hit) h
              join entities e on e.is_active and e.entity_type = 'University' and (e.user_id = 'u1' or e.user_id is null)
                   and contains(lower(e.entity_name), lower(h.beneficiary_name))),
    s as (select h.*, k.b is not null as verified, p.is_pep, p.has_adverse_media, p.high_risk_occupation, p.previous_sar_count as sars
          from hit h left join known k on lower(h.beneficiary_name) = k.b left join profile p on h.customer_id = p.customer_id),
    scored as (select alert_id, reason,
        greatest(0.0, case when aggregated_value > 50000 then 15 else 0 end + case when verified then -5 else 25 end + case when is_pep then 25 else 0 end
            + case when has_adverse_media then 20 else 0 end + case when high_risk_occupation then 10 else 0 end + sars * 10) as score,
        concat_ws(', ', case when aggregated_value > 50000 then 'High amount for Education: ' || cast(aggregated_value as varchar) end,
            case when not verified then 'Unverified University beneficiary: ' || beneficiary_name end, case when is_pep then 'Customer is PEP' end,
            case when has_adverse_media then 'Adverse Media found' end, case when high_risk_occupation then 'High Risk Occupation' end,
            case when sars > 0 then cast(sars as varchar) || ' Previous SARs' end) as factors
        from s, range({times}))
    """


GAP_SOURCE = "select * from named where trigger_reason in ('University payment', 'Tuition due')"


def scored_g(t: Tables) -> DataFrame:
    return risk.score_grouped(risk.gap_candidates(named(t), RULES, once=False), t.profile, t.entities, "u1")


@query("g9_alert_risk_g", scored_g_sql(2, GAP_SOURCE, "'Education Exclusion'") + "select alert_id, reason, score, factors from scored")
def alert_risk_g(t: Tables) -> DataFrame:
    return scored_g(t).withColumn("factors", F.array_join("factors", ", "))


@query("g8_gap_g", scored_g_sql(2, GAP_SOURCE, "'Education Exclusion'") + REPORT)
def gap_g(t: Tables) -> DataFrame:
    return risk.gap_report(scored_g(t)).drop("sample_exploits")


@query("g11_levels", "select alert_id, case when risk_score > 60 then 'CRITICAL' when risk_score > 30 then 'DANGEROUS' when risk_score > 0 then 'CAUTION' else 'SAFE' end as level from alert")
def levels(t: Tables) -> DataFrame:
    return t.alert.select("alert_id", gap_level("risk_score").alias("level"))


@query(
    "g12_exploits",
    SCORED_P
    + """, k as (select *, row_number() over (order by score desc, alert_id) as rank from scored)
      select rank, 'Exploit: ' || case when factors = '' then 'Generic Gap' else regexp_extract(factors, '^(High amount for Education: [0-9,.]*[0-9]|[^,]*)', 1) end as title,
             'Excluded by rule ''' || reason || '''. ' || factors as method, 'High' as volume_risk from k where rank <= 3""",
)
def exploits(t: Tables) -> DataFrame:
    return risk.exploit_texts(scored_p(t))


@query(
    "g13_excluded_risk",
    scored_g_sql(1, "select * from named where excluded", "exclusion_reason") + REPORT,
)
def excluded_risk(t: Tables) -> DataFrame:
    rows = risk.excluded_candidates(named(t))
    return risk.gap_report(risk.score_grouped(rows, t.profile, t.entities, "u1")).drop("sample_exploits")


@query(
    "g14_run_list",
    """with l as (select run_id, unnest(scenarios_run) as scenario_id, generate_subscripts(scenarios_run, 1) as place from run),
       n as (select l.run_id, string_agg(coalesce(scenario_name, l.scenario_id), '|' order by place) as names from l left join scenario s on l.scenario_id = s.scenario_id group by 1)
       select run.run_id, row_number() over (order by created_at, run.run_id) as run_number, total_alerts, status, names from run join n on run.run_id = n.run_id""",
)
def runs(t: Tables) -> DataFrame:
    done = run_list(t.run, t.scenario)
    return done.select("run_id", "run_number", "total_alerts", "status", F.array_join("scenario_names", "|").alias("names"))


@query("g14_run_alerts", "select alert_id, customer_id, risk_score from alert where run_id = 'RUN1998'")
def alerts_of_run(t: Tables) -> DataFrame:
    return run_alerts(t.alert, "RUN1998").select("alert_id", "customer_id", "risk_score")


@query("g14_run_detail", "select run_id, created_at, total_alerts, status from run where run_id = 'RUN1998'")
def detail(t: Tables) -> DataFrame:
    return run_detail(t.run, "RUN1998")


@query("g14_recent_numbers", "select run_id, run_number from (select run_id, row_number() over (order by created_at, run_id) as run_number from run) order by run_number desc limit 3")
def recent(t: Tables) -> DataFrame:
    return recent_runs(t.run, t.scenario, 3).select("run_id", "run_number")


ALERT_DIFF = """with b as (select customer_id, scenario_id, cast(alert_date as date) as alert_day, min(cast(excluded as int)) as x from old group by all),
    r as (select customer_id, scenario_id, cast(alert_date as date) as alert_day, min(cast(excluded as int)) as x from new group by all),
    d as (select coalesce(b.customer_id, r.customer_id) as customer_id, coalesce(b.scenario_id, r.scenario_id) as scenario_id,
                 coalesce(b.alert_day, r.alert_day) as alert_day,
                 case when r.x is null then 'DROPPED_SILENTLY' when r.x = 1 then 'EXCLUDED' when b.x is null then 'NEW_ALERT' else 'RETAINED' end as status
          from b full outer join r on b.customer_id = r.customer_id and b.scenario_id = r.scenario_id and b.alert_day = r.alert_day)
    """


@query("g15_alert_diff", ALERT_DIFF + "select customer_id, scenario_id, cast(alert_day as varchar) as alert_day, status from d")
def alert_diff(t: Tables) -> DataFrame:
    return compare.alert_diff(t.old, t.new).withColumn("alert_day", F.col("alert_day").cast("string"))


@query("g15_alert_diff_counts", ALERT_DIFF + "select status, count(*) as alerts from d group by status")
def alert_diff_counts(t: Tables) -> DataFrame:
    return compare.alert_diff_counts(compare.alert_diff(t.old, t.new))


@query(
    "g16_customer_counts",
    """select customer_id, sum(b) as baseline_alerts, sum(r) as refined_alerts, sum(r) - sum(b) as net_change
       from (select customer_id, 1 as b, 0 as r from old union all select customer_id, 0, 1 from new) group by customer_id""",
)
def counts(t: Tables) -> DataFrame:
    return compare.customer_counts(t.old, t.new)


@query(
    "g6_compare_runs",
    f"""with r as (select run_id from run where status = 'completed' and list_contains(scenarios_run, 'S1') order by created_at desc, run_id desc limit 1),
        b as (select * from alert where run_id = 'RUN1997'), n as (select * from alert where run_id in (select run_id from r)),
        lb as (select customer_id, arg_max(risk_score, (alert_date, alert_id)) as s from b group by 1),
        ln as (select customer_id, arg_max(risk_score, (alert_date, alert_id)) as s from n group by 1)
        select coalesce(lb.customer_id, ln.customer_id) as customer_id, coalesce(ln.s, lb.s) as risk_score,
               case when ln.customer_id is null then 'removed' when lb.customer_id is null then 'added' else 'maintained' end as status,
               (select count(*) from b) - (select count(*) from n) as net_change, (select count(*) from n) as overlap_count,
               {half_up("((select count(*) from b) - (select count(*) from n)) * 100.0 / (select count(*) from b)", 2)} as reduction_rate
        from lb full join ln on lb.customer_id = ln.customer_id""",
)
def compared(t: Tables) -> DataFrame:
    """A run named by its id against the latest run of a rule."""
    done = compare_runs(t.alert, t.run, "RUN1997", "S1")
    parts = done.summary.select("net_change", "reduction_rate").withColumn("k", F.lit(1)).join(
        done.efficiency.select("overlap_count").withColumn("k", F.lit(1)), "k"
    )
    rows = done.diff.select("customer_id", "risk_score", "status").withColumn("k", F.lit(1))
    return rows.join(F.broadcast(parts), "k").drop("k")
