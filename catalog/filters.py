"""Mappings, filters and previews."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import Tables, query
from txnwatch.operators.filters import apply_filters, in_date_range, preview_grouped, preview_peak, split_filters
from txnwatch.operators.mapping import map_columns, map_run
from txnwatch.plans.grouped import prepared
from txnwatch.rules import make_rule, map_rule

SHOWN = ["transaction_id", "customer_id", "transaction_amount"]


def _filter(t: Tables, filters: object, profile: str = "grouped", mapping: dict | None = None) -> DataFrame:
    return apply_filters(t.txn, t.cust, filters, profile, mapping).select(*SHOWN)


def one(name: str, field: str, operator: str, value: object, where: str, profile: str = "grouped") -> None:
    """Register a single-filter query; customer fields are joined in the SQL."""
    sql = f"""select transaction_id, t.customer_id, transaction_amount from txn t join cust c on t.customer_id = c.customer_id
              where {where}"""
    query(name, sql)(lambda t: _filter(t, [{"field": field, "operator": operator, "value": value}], profile))


@query("b1_map_columns", "select transaction_id, customer_id, transaction_amount as amount, channel as transaction_type from txn")
def mapped(t: Tables) -> DataFrame:
    rows = t.txn.select("transaction_id", "customer_id", "transaction_amount", "channel", "transaction_type")
    return map_columns(rows, {"transaction_type": "channel", "amount": "transaction_amount", "gone": "absent"})


@query("b2_map_rule", "select transaction_id, t.customer_id, transaction_amount from txn t where transaction_amount > 300000 and channel = '5-LOW'")
def mapped_rule(t: Tables) -> DataFrame:
    rule = make_rule("S", {"filters": [{"field": "amt", "operator": ">", "value": 300000}, {"field": "lane", "operator": "==", "value": "5-LOW"}],
                           "aggregation": {"method": "sum", "field": "amt", "group_by": ["who"]}})
    rewritten = map_rule(rule, {"amt": "transaction_amount", "lane": "channel", "who": "customer_id"})
    assert (rewritten.value_field, rewritten.group_by) == ("transaction_amount", ("customer_id",))
    return prepared(t.txn, t.cust, rewritten).select(*SHOWN)


@query("b3_resolve_at_use", "select transaction_id, t.customer_id, transaction_amount from txn t where channel in ('1-URGENT', '2-HIGH')")
def resolved(t: Tables) -> DataFrame:
    return _filter(t, [{"field": "lane", "operator": "in", "value": "1-URGENT, 2-HIGH"}], "peak", {"lane": "channel"})


@query("b4_mapping_order", "select transaction_id, transaction_amount as value, channel as kind from txn")
def mapping_order(t: Tables) -> DataFrame:
    rows = t.txn.select("transaction_id", "transaction_amount", "channel")
    return map_run(rows, {"money": "transaction_amount", "kind": "channel"}, {"value": "money"})


one("b5_equals_g", "channel", "equals", "3-MEDIUM", "channel = '3-MEDIUM'")
one("b5_equals_number_p", "risk_score", "==", "7", "risk_score = 7", "peak")
one("b6_not_equals_g", "occupation", "!=", "BUILDING", "occupation <> 'BUILDING'")
one("b7_greater", "transaction_amount", "greater_than", "250000", "transaction_amount > 250000", "peak")
one("b8_less", "transaction_amount", "lessthan", 50000, "transaction_amount < 50000")
one("b9_greater_equal", "transaction_date", ">=", "1999-01-01", "transaction_date >= timestamp '1999-01-01'", "peak")
one("b10_less_equal", "customer.annual_income", "<=", 0, "annual_income <= 0", "peak")
one("b11_in_g", "channel", "in", ["1-URGENT", "5-LOW"], "channel in ('1-URGENT', '5-LOW')")
one("b11_in_numbers_p", "risk_score", "in", "3, 4,11", "risk_score in (3, 4, 11)", "peak")
one("b12_not_in", "channel", "not_in", ["1-URGENT", "5-LOW"], "channel not in ('1-URGENT', '5-LOW')")
one("b13_contains", "channel", "contains", "iUm", "lower(channel) like '%ium%'")
one("b14_text_number", "transaction_amount", "==", "many", "cast(transaction_amount as varchar) = 'many'")
one("b15_first_of_list", "channel", "equals", ["4-NOT SPECIFIED", "x"], "channel = '4-NOT SPECIFIED'")
one("b18_customer_prefix", "customer.occupation", "==", "MACHINERY", "occupation = 'MACHINERY'", "peak")
one("b18_only_in_customer", "region", "==", "ASIA", "region = 'ASIA'", "peak")
one("b22_between", "transaction_amount", "between", [100000, 120000], "transaction_amount between 100000 and 120000")
one("b22_starts_with", "channel", "starts_with", "4-n", "lower(channel) like '4-n%'")
one("b22_ends_with", "channel", "ends_with", "HIGH", "lower(channel) like '%high'")
one("b22_less_or_equal", "transaction_amount", "less_or_equal", 20000, "transaction_amount <= 20000")
one("b22_greater_or_equal", "transaction_amount", "greater_or_equal", 400000, "transaction_amount >= 400000")


@query(
    "b6_not_equals_keeps_null",
    """select transaction_id, customer_id, transaction_amount from evt where transaction_narrative is distinct from 'Loan EMI payment'""",
)
def not_equal_null(t: Tables) -> DataFrame:
    test = [{"field": "transaction_narrative", "operator": "not_equals", "value": "Loan EMI payment"}]
    return apply_filters(t.evt, None, test, "grouped").select(*SHOWN)


@query(
    "b6_not_equals_p",
    """select transaction_id, customer_id, transaction_amount from evt where transaction_narrative <> 'Loan EMI payment'""",
)
def not_equal_peak(t: Tables) -> DataFrame:
    test = [{"field": "transaction_narrative", "operator": "!=", "value": "Loan EMI payment"}]
    return apply_filters(t.evt, None, test, "peak").select(*SHOWN)


@query("b16_no_op_g", "select transaction_id, customer_id, transaction_amount from txn")
def no_op(t: Tables) -> DataFrame:
    ignored = [
        {"field": "nowhere", "operator": "==", "value": 1},
        {"field": "channel", "operator": "resembles", "value": "x"},
        {"field": "channel", "operator": "=="},
        {"operator": "==", "value": 1},
    ]
    _, _, skipped = split_filters(ignored, t.txn.schema, t.cust.schema, "skip")
    assert len(skipped) == 4
    return _filter(t, ignored)


@query("b16_unknown_field_p", "select transaction_id, customer_id, transaction_amount from txn where false")
def unknown_field(t: Tables) -> DataFrame:
    return _filter(t, [{"field": "nowhere", "operator": "==", "value": 1}], "peak")


@query(
    "b17_typed_filter",
    """select transaction_id, t.customer_id, transaction_amount from txn t join cust c on t.customer_id = c.customer_id
       where transaction_type in ('F', 'O') and channel in ('1-URGENT', '2-HIGH') and debit_credit_indicator = 'D'
         and transaction_amount between 50000 and 300000 and customer_type in ('Retail') and occupation <> 'FURNITURE'""",
)
def typed(t: Tables) -> DataFrame:
    return _filter(t, {
        "transaction_type": ["F", "O"], "channel": ["1-URGENT", "2-HIGH"], "direction": "debit", "customer_type": ["Retail"],
        "amount_range": {"min": 50000, "max": 300000},
        "custom_field_filters": [{"field": "occupation", "operator": "!=", "value": "FURNITURE"}],
    })


@query(
    "b19_date_range",
    """select transaction_id, customer_id, transaction_amount from txn
       where transaction_date between timestamp '1997-01-01' and timestamp '1997-12-31'""",
)
def date_range(t: Tables) -> DataFrame:
    return in_date_range(t.txn, "1997-01-01", "1997-12-31").select(*SHOWN)


@query("b19_open_range", "select transaction_id, customer_id, transaction_amount from txn where transaction_date <= timestamp '1997-12-31'")
def open_range(t: Tables) -> DataFrame:
    return in_date_range(t.txn, None, "1997-12-31").select(*SHOWN)


PREVIEW = [
    {"field": "occupation", "operator": "equals", "value": "AUTOMOBILE"},
    {"field": "transaction_amount", "operator": "greater_then_equal", "value": 200000},
    {"field": "channel", "operator": "not in list", "value": ["5-LOW"]},
]


@query(
    "b20_preview_g",
    """with m as (select t.* from txn t join cust c on t.customer_id = c.customer_id
                  where occupation = 'AUTOMOBILE' and transaction_amount >= 200000 and channel not in ('5-LOW'))
       select count(*) as matched_transactions, count(distinct customer_id) as matched_customers,
              (select count(*) from txn) as total_transactions, (select count(*) from cust) as total_customers,
              round(count(*) * 100.0 / (select count(*) from txn), 2) as match_percentage from m""",
)
def preview_g(t: Tables) -> DataFrame:
    return preview_grouped(t.txn, t.cust, PREVIEW)


@query(
    "b21_preview_p",
    """select (select count(*) from txn t join cust c on t.customer_id = c.customer_id
               where occupation = 'AUTOMOBILE' and transaction_amount >= 200000 and channel not in ('5-LOW')) as match_count,
              (select count(*) from txn) as total_records""",
)
def preview_p(t: Tables) -> DataFrame:
    return preview_peak(t.txn, t.cust, PREVIEW)


@query("b21_preview_no_filter_p", "select 0 as match_count, 0 as total_records from (select count(*) from txn)")
def preview_none(t: Tables) -> DataFrame:
    return preview_peak(t.txn, t.cust, [])


@query(
    "b_filter_chain",
    """select transaction_id, t.customer_id, transaction_amount from txn t join cust c on t.customer_id = c.customer_id
       where channel <> '5-LOW' and transaction_amount > 100000 and annual_income > 1000 and region = 'EUROPE'""",
)
def chain(t: Tables) -> DataFrame:
    return _filter(t, [
        {"field": "channel", "operator": "!=", "value": "5-LOW"},
        {"field": "transaction_amount", "operator": ">", "value": 100000},
        {"field": "annual_income", "operator": ">", "value": "1000"},
        {"field": "customer.region", "operator": "==", "value": "EUROPE"},
    ]).withColumn("transaction_amount", F.col("transaction_amount"))
