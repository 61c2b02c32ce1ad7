"""Suppression of alerts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import Tables, query
from txnwatch.operators.refine import event_context, event_type, exclusion_log, keyword_hit, refine
from txnwatch.rules import GROUPED, Refinement

EDUCATION = "university|tuition|education|school|college|student fee|semester"
LOAN = "loan|emi|mortgage|repayment|installment|financing"
DEPOSIT = "fixed deposit|fd|term deposit|investment|fd maturity"


def event_sql(column: str) -> str:
    return f"""case when regexp_matches(lower({column}), '{EDUCATION}') then 'education'
                    when regexp_matches(lower({column}), '{LOAN}') then 'loan'
                    when regexp_matches(lower({column}), '{DEPOSIT}') then 'fixed_deposit' end"""


CONTEXT = f"""with c as (
    select *, {event_sql("transaction_narrative")} as event_type from evt),
  names as (select distinct beneficiary_name from evt where beneficiary_name <> ''),
  known as (select distinct b.beneficiary_name, e.entity_type from names b
            join entities e on e.is_active and contains(lower(e.entity_name), lower(b.beneficiary_name))),
  x as (select c.*, k.entity_type is not null as is_verified,
               not (event_type = 'education' and transaction_amount > 50000) as amount_reasonable
        from c left join known k on c.beneficiary_name = k.beneficiary_name
             and k.entity_type = case event_type when 'education' then 'University' when 'loan' then 'FinancialInstitution' end
        where event_type is not null)
  """


@query("f1_event_type", f"select transaction_id, {event_sql('transaction_narrative')} as event_type from evt")
def classified(t: Tables) -> DataFrame:
    return t.evt.select("transaction_id", event_type("transaction_narrative").alias("event_type"))


@query("f1_event_type_documents", f"select doc_id, {event_sql('text')} as event_type from documents")
def classified_documents(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", event_type("text").alias("event_type"))


@query(
    "f1_whole_words",
    r"""select doc_id, case when regexp_matches(lower(text), '\b(?:university|tuition|education|school|college|student fee|semester)\b') then 'education'
                       when regexp_matches(lower(text), '\b(?:loan|emi|mortgage|repayment|installment|financing)\b') then 'loan'
                       when regexp_matches(lower(text), '\b(?:fixed deposit|fd|term deposit|investment|fd maturity)\b') then 'fixed_deposit' end as event_type
        from documents""",
)
def whole_words(t: Tables) -> DataFrame:
    return t.read("documents").select("doc_id", event_type("text", whole_words=True).alias("event_type"))


@query("f2_context", CONTEXT + "select transaction_id, event_type, is_verified, amount_reasonable from x")
def context(t: Tables) -> DataFrame:
    return event_context(t.evt, t.entities).select("transaction_id", "event_type", "is_verified", "amount_reasonable")


@query(
    "f2_amount_limit",
    """select transaction_id, transaction_type <> 'purchase' or transaction_amount * 150 <= 50000 as amount_reasonable from evt
       where transaction_type in ('purchase', 'signup', 'click')""",
)
def amount_limit(t: Tables) -> DataFrame:
    rows = t.evt.withColumn("transaction_amount", F.col("transaction_amount") * 150)
    return event_context(rows, t.entities).select("transaction_id", "amount_reasonable")


@query(
    "f3_keyword_prefilter",
    "select transaction_id, coalesce(regexp_matches(lower(transaction_narrative), 'tuition|university|college|school'), false) as hit from evt",
)
def prefilter(t: Tables) -> DataFrame:
    return t.evt.select("transaction_id", keyword_hit("transaction_narrative", ["education", "fixed_deposit"]).alias("hit"))


@query(
    "f3_credit_and_crypto",
    """select transaction_id, regexp_matches(lower(n), 'loan|mortgage|credit|crypto|bitcoin|binance|coinbase') as hit
       from (select transaction_id, case transaction_id::bigint % 4 when 0 then 'Credit card bill' when 1 then 'Loan EMI'
                                       when 2 then 'Binance top-up' else 'emi of the semester' end as n from evt)""",
)
def other_prefilter(t: Tables) -> DataFrame:
    k = F.col("transaction_id").cast("long") % 4
    text = F.when(k == 0, "Credit card bill").when(k == 1, "Loan EMI").when(k == 2, "Binance top-up").otherwise("emi of the semester")
    return t.evt.withColumn("n", text).select("transaction_id", keyword_hit("n", ["loan", "crypto"]).alias("hit"))


RULES = [
    Refinement("edu", ("education",)),
    Refinement("off", ("fixed_deposit",), enabled=False),
    Refinement("other", ("loan",), kind="behavioral"),
    Refinement("loans", ("loan", "education")),
]
# Alerts: the last click of each customer and day.
CLICKS = """clicks as (select 'K' || customer_id || '-' || cast(cast(transaction_date as date) as varchar) as alert_id, customer_id,
    max(transaction_date) as alert_date from evt where transaction_type = 'click' group by customer_id, cast(transaction_date as date))"""
DECIDED = (
    CONTEXT
    + ", "
    + CLICKS
    + """, q as (select *, case when event_type = 'education' then 0 end as r0, case when event_type in ('loan', 'education') then 1 end as r1
                 from x where event_type <> 'education' or (is_verified and amount_reasonable)),
  u as (select *, unnest([0, 1]) as r from q),
  m as (select k.alert_id, u.r, u.event_type, u.beneficiary_name, u.is_verified, u.amount_reasonable, u.transaction_amount,
               row_number() over (partition by k.alert_id order by u.r, u.transaction_date, u.transaction_id) as place
        from clicks k join u on k.customer_id = u.customer_id and (u.r0 = u.r or u.r1 = u.r)
             and u.transaction_date between k.alert_date - interval 2 day and k.alert_date),
  d as (select k.alert_id, k.customer_id, m.alert_id is not null as excluded,
               case when m.event_type = 'education' then 'Verified education transaction to ' || m.beneficiary_name
                    when m.event_type is not null then 'Legitimate ' || m.event_type || ' transaction' end as exclusion_reason,
               case m.r when 0 then 'edu' when 1 then 'loans' end as rule_id, m.event_type, m.is_verified, m.amount_reasonable,
               m.beneficiary_name as beneficiary, m.transaction_amount as amount
        from clicks k left join m on k.alert_id = m.alert_id and m.place = 1)
  """
)


def clicks(t: Tables) -> DataFrame:
    day = F.to_date("transaction_date")
    return (
        t.evt.filter(F.col("transaction_type") == "click")
        .groupBy("customer_id", day.alias("_day"))
        .agg(F.max("transaction_date").alias("alert_date"))
        .select(F.concat(F.lit("K"), "customer_id", F.lit("-"), F.col("_day").cast("string")).alias("alert_id"), "customer_id", "alert_date")
    )


def decided(t: Tables) -> DataFrame:
    return refine(clicks(t), t.evt, t.entities, RULES, lookback_days=2)


@query("f4_f6_decision", DECIDED + "select alert_id, customer_id, excluded, rule_id as exclusion_rule_id from d")
def decision(t: Tables) -> DataFrame:
    return decided(t).select("alert_id", "customer_id", "excluded", "exclusion_rule_id")


@query("f5_reason", DECIDED + "select alert_id, exclusion_reason from d")
def reason(t: Tables) -> DataFrame:
    return decided(t).select("alert_id", "exclusion_reason")


@query(
    "f7_exclusion_log",
    DECIDED + """select sha256(alert_id || '/' || rule_id) as log_id, alert_id, rule_id, exclusion_reason, event_type, is_verified, amount_reasonable,
                        beneficiary, amount from d where excluded""",
)
def log(t: Tables) -> DataFrame:
    return exclusion_log(decided(t)).select("log_id", "alert_id", "rule_id", "exclusion_reason", "risk_flags.*")


GATED = DECIDED.replace("clicks k join u on", "clicks k join u on u.r = 1 and k.customer_id in (select customer_id from evt where regexp_matches(lower(transaction_narrative), 'loan|mortgage|credit')) and")


@query("f4_grouped_gate", GATED.replace("('loan', 'education')", "('loan', 'x')") + "select alert_id, excluded, rule_id as exclusion_rule_id from d")
def gated(t: Tables) -> DataFrame:
    """Of two grouped rules the one on deposits has no gate words, so it excludes nothing."""
    rules = (
        Refinement(rule_id="deposits", kind="event_based", enabled=True, events=("fixed_deposit",)),
        Refinement(rule_id="loans", kind="event_based", enabled=True, events=("loan",)),
    )
    return refine(clicks(t), t.evt, t.entities, rules, lookback_days=2, profile=GROUPED).select("alert_id", "excluded", "exclusion_rule_id")
