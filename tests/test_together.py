"""Many rules in one pass give what each gives alone, with scans and exchanges that do not follow their number."""

import contextlib
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from txnwatch.plans import run as run_module
from txnwatch.plans.run import run_rules

START = 1_700_000_000


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(4)
    rows = []
    for k in range(900):
        customer = rng.choice(["a", "a", "a", *"bcdefghij"]) if k % 40 else None
        when = START + rng.choice([0, rng.randrange(0, 120 * 86_400), 3600 * rng.randrange(0, 50)])
        amount = rng.choice([str(rng.randrange(1, 900)), f"{rng.randrange(0, 9999) / 100}", "-50", "x", None])
        words = rng.choice(["tuition fee", "loan emi", "gift", None, "fd maturity", "school bus", "credit card"])
        rows.append((f"t{k}", customer, when if k % 55 else None, amount, rng.choice(["cash", "wire", "card", None]), words, rng.choice(["oxford", "acme", None]), f"u{k % 2}"))
    schema = "transaction_id string, customer_id string, s long, transaction_amount string, channel string, transaction_narrative string, beneficiary_name string, upload_id string"
    txns = spark.createDataFrame(rows, schema).withColumn("transaction_date", F.timestamp_seconds("s")).drop("s")
    people = [(c, f"Name {c}", rng.choice(["clerk", "chef"]), rng.randrange(1, 50) * 10.0, rng.choice(["Savings", "Business"]), rng.randrange(20), "x") for c in "aabcdefgh"]
    customers = spark.createDataFrame(people, "customer_id string, customer_name string, occupation string, annual_income double, account_type string, risk_score int, country string")
    names = spark.createDataFrame([("University of Oxford", "University", True), ("Acme Bank", "FinancialInstitution", True)], "entity_name string, entity_type string, is_active boolean")
    return txns, customers, names


def peak(function="sum", days=30, threshold=None, **more):
    return {"scenario_name": f"{function} {days}", "aggregation": {"function": function, "field": "transaction_amount", "rolling_window_days": days}, "threshold": threshold or {"type": "fixed", "fixed_value": 300}, **more}


def grouped(method="sum", by=("customer_id",), window=None, threshold=None, **more):
    inner = {"method": method, "field": "transaction_amount", "group_by": list(by)}
    return {"profile": "grouped", "aggregation": {**inner, **({"time_window": window} if window else {})}, "threshold": threshold or {"type": "fixed", "fixed_value": 100}, **more}


CASH = [{"field": "channel", "operator": "in", "value": "cash, wire"}]
CLERKS = [{"field": "customer.occupation", "operator": "==", "value": "clerk"}]
LOANS = [{"type": "event_based", "rule_id": "loans", "excluded_events": ["loan"]}]
STUDY = [{"type": "event_based", "rule_id": "study", "excluded_events": ["education", "fixed_deposit"]}, *LOANS]
DYNAMIC = {"type": "dynamic", "dynamic": {"reference_field": "annual_income", "formula": "reference_field * 2", "min_threshold": 10, "max_threshold": 500}}
SEGMENT = {"type": "segment", "segment": {"field": "occupation", "values": [{"segment": "Clerk", "threshold": 40}, {"segment": "chef", "threshold": 900}]}}
ROLLING = {"value": 2, "unit": "days", "type": "rolling"}
RULES = {
    "P1": peak(filters=CASH, refinements=STUDY, enrichment={"include_customer_profile": True, "calculate_velocity_metrics": True}),
    "P2": peak("avg", 7, DYNAMIC, filters=CLERKS, alert_metadata={"severity": "HIGH", "regulatory_tags": ["a"]}),
    "P3": peak("min", 3, SEGMENT),
    "P4": peak("max", 30, refinements=LOANS),
    "P5": peak("count", 10, {"type": "fixed", "fixed_value": 5}, filters=[{"field": "no_such", "operator": "==", "value": 1}]),
    "P6": peak("count", 1, {"type": "fixed", "fixed_value": 3}, aggregation={"function": "count", "rolling_window_days": 1, "count_threshold": {"enabled": True, "min_transactions": 4}}),
    "P7": peak("sum", 30, {"type": "fixed", "fixed_value": 0}, filters=[{"field": "transaction_amount", "operator": "==", "value": "-50"}]),
    "G1": grouped(refinements=STUDY),
    "G2": grouped("avg", ["customer_id", "channel"], {"value": 7, "unit": "days", "type": "calendar"}),
    "G3": grouped("count", ["channel"], None, {"type": "fixed", "fixed_value": 2}, filters=CLERKS),
    "G4": grouped("max", ["occupation", "channel"], {"value": 1, "unit": "months", "type": "calendar"}, DYNAMIC, alert_condition={"expression": "aggregated_value > threshold and txn_count > 1"}),
    "G5": grouped("sum", ["customer_id"], ROLLING, refinements=LOANS),
    "G6": grouped("avg", ["channel"], {"value": 12, "unit": "hours", "type": "rolling"}),
    "G7": grouped("min", ["customer_id", "channel"], ROLLING, {"type": "segment_based", "segment_based": {"segment_field": "account_type", "values": {"Savings": 20}, "default": 5}}),
    "G8": grouped("sum", ["customer_id"], {"value": 1, "unit": "days", "type": "calendar"}, alert_condition={"expression": "risk_score > 3", "additional_conditions": [{"field": "transaction_count", "operator": ">", "value": 1}]}),
    "G9": {**grouped(), "threshold": None, "alert_condition": {"expression": "annual_income > 100"}},
    "M1": grouped("sum", ["way"], field_mappings={"way": "channel"}),
    "bad": grouped("median"),
    "lost": grouped("sum", ["nowhere"]),
}


def rows_of(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


@pytest.mark.parametrize("hot", ["1000000", "60"])
def test_same_as_alone(spark, tables, hot):
    txns, customers, names = tables
    spark.conf.set("spark.txnwatch.hotRows", hot)
    try:
        # Hot customers take other plans; a few rules of each kind show it.
        rules = RULES if hot == "1000000" else {k: RULES[k] for k in ("P1", "P2", "P3", "G1", "G3", "G5", "G7", "bad", "lost")}
        shared = run_rules(rules, txns, customers, "R", names)
        alone = run_rules(rules, txns, customers, "R", names, together=False)
        assert sorted(shared.rejected) == sorted(alone.rejected) == ["bad", "lost"]
        assert rows_of(shared.alerts) == rows_of(alone.alerts)
        assert rows_of(shared.alert_transactions.select(sorted(shared.alert_transactions.columns))) == rows_of(alone.alert_transactions.select(sorted(alone.alert_transactions.columns)))
        assert rows_of(shared.exclusion_logs) == rows_of(alone.exclusion_logs)
        seen = {r.scenario_id: r.n for r in shared.alerts.groupBy("scenario_id").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert set(rules) - seen.keys() == {"bad", "lost", "P5"} & set(rules) and shared.exclusion_logs.count() > 3
    finally:
        spark.conf.unset("spark.txnwatch.hotRows")


def test_every_rule_took_the_shared_pass(spark, tables, monkeypatch):
    taken = []
    alone = run_module._alone
    monkeypatch.setattr(run_module, "_alone", lambda *a: taken.append(a[2].scenario_id) or alone(*a))
    run_rules(RULES, *tables[:2], "R", tables[2], with_links=False)
    assert taken == ["M1", "lost"]


def steps(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode="simple")
    return len(re.findall(r"FileScan", text.getvalue())), len(re.findall(r"Exchange hashpartitioning", text.getvalue()))


def test_scans_and_exchanges_do_not_follow_the_rules(spark, tables, tmp_path):
    for name, df in zip(("t", "c"), tables, strict=False):
        df.write.parquet(str(tmp_path / name))
    txns, customers = (spark.read.parquet(str(tmp_path / name)) for name in ("t", "c"))
    many = {f"P{k}": peak(("sum", "avg", "max")[k % 3], 5 + k, filters=CASH if k % 2 else ()) for k in range(12)}
    many |= {f"G{k}": grouped(("sum", "count")[k % 2], ("customer_id", "channel")[: 1 + k % 2], {"value": 1 + k, "unit": "days", "type": "calendar"}) for k in range(12)}
    many |= {f"T{k}": grouped("sum", ["customer_id"], {"value": 1 + k, "unit": "days", "type": "rolling"}) for k in range(6)}
    few = {k: many[k] for k in ("P0", "G0", "T0")}
    two = {k: many[k] for k in ("P0", "P1", "G0", "G1", "T0", "T1")}
    counts = [steps(run_rules(rules, txns, customers, "R", with_links=False).alerts) for rules in (few, two, many)]
    assert counts[0] == counts[1] == counts[2]
    assert counts[0][0] <= 6


def test_a_failing_shared_pass_falls_back(spark, tables, monkeypatch):
    monkeypatch.setattr(run_module, "_together", lambda *a: (_ for _ in ()).throw(ValueError("no")))
    result = run_rules({k: RULES[k] for k in ("P1", "G1")}, *tables[:2], "R", tables[2], with_links=False)
    assert not result.rejected and {r.scenario_id for r in result.alerts.select("scenario_id").distinct().collect()} == {"P1", "G1"}


def test_empty_tables(spark, tables):
    txns, customers, names = tables
    result = run_rules({k: RULES[k] for k in ("P1", "P2", "G1", "G5")}, txns.limit(0), customers.limit(0), "R", names)
    assert not result.rejected and result.alerts.count() == 0 and result.alert_transactions.count() == 0
