"""A known rule on a small wire-transfer fixture, from transactions to suppressed alert."""

from datetime import datetime

import pytest

from txnwatch.plans.run import dry_run_grouped, dry_run_peak, run_rules
from txnwatch.rules import make_rule

WIRE, DOMESTIC = "International_Wire", "Domestic"
ROWS = [
    ("TX001", "CUST001", "2024-01-05", 5800, WIRE, "Tuition Payment Semester 1", "University of Oxford"),
    ("TX024", "CUST001", "2024-01-14", 4500, WIRE, "Education Material Purchase", "Academic Books Ltd"),
    ("TX045", "CUST001", "2024-01-25", 16, DOMESTIC, "Tutoring Income", "Private Student"),
    ("TX078", "CUST001", "2024-02-17", 6100, WIRE, "Second Semester Tuition", "University of Oxford"),
    ("TX005", "CUST005", "2024-01-06", 2100, WIRE, "Tuition Fee", "Cambridge University"),
    ("TX079", "CUST005", "2024-02-18", 2200, WIRE, "Course Registration Fee", "Cambridge University"),
    ("TX034", "CUST010", "2024-01-19", 2800, WIRE, "Online Course Fee", "Coursera Platform"),
    ("TX055", "CUST010", "2024-01-30", 3100, WIRE, "Research Software License", "Microsoft Education"),
    ("TX080", "CUST010", "2024-02-19", 3600, WIRE, "Lab Equipment Fee", "Imperial College"),
    ("TX019", "CUST016", "2024-01-11", 6200, WIRE, "University Accommodation", "Student Housing Ltd"),
    ("TX040", "CUST016", "2024-01-22", 5900, WIRE, "Study Materials", "Educational Publisher"),
    ("TX061", "CUST016", "2024-02-02", 7200, WIRE, "Semester Fee Payment", "Imperial College London"),
]
PEOPLE = [
    ("CUST001", "John Mitchell", "Student", 8000),
    ("CUST005", "David Kumar", "Student", 5000),
    ("CUST010", "Jennifer Lee", "Student", 6000),
    ("CUST016", "Karen Martinez", "Student", 7500),
    ("CUST099", "Nobody", "Retired", 100),
]
# The verified universities.
UNIVERSITIES = [
    "University of Oxford", "University of Cambridge", "Imperial College London", "UCL", "University of Edinburgh",
    "King's College London", "University of Manchester", "University of Bristol",
]
RULE = {
    "scenario_name": "Complex International Wire Structuring Detection",
    "filters": [
        {"field": "channel", "operator": "equals", "value": "International_Wire"},
        {"field": "customer.occupation", "operator": "==", "value": "Student"},
    ],
    "aggregation": {"function": "sum", "field": "transaction_amount", "rolling_window_days": 30},
    "threshold": {
        "type": "dynamic",
        "dynamic": {"reference_field": "annual_income", "formula": "customer.annual_income * 0.5", "min_threshold": 15000},
    },
    "enrichment": {"include_customer_profile": True, "calculate_velocity_metrics": True},
}


@pytest.fixture
def data(spark):
    transactions = spark.createDataFrame(
        [(t, c, datetime.fromisoformat(d), float(a), ch, n, b) for t, c, d, a, ch, n, b in ROWS],
        "transaction_id string, customer_id string, transaction_date timestamp, transaction_amount double, "
        "channel string, transaction_narrative string, beneficiary_name string",
    )
    customers = spark.createDataFrame(PEOPLE, "customer_id string, customer_name string, occupation string, annual_income long")
    whitelist = spark.createDataFrame([(u, "University", True) for u in UNIVERSITIES], "entity_name string, entity_type string, is_active boolean")
    return transactions, customers, whitelist


def test_alert_matches_known_export(data):
    result = run_rules({"S1": RULE, "broken": {"threshold": {"type": "fixed", "fixed_value": "x"}}}, *data[:2], "R1", data[2])
    assert list(result.rejected) == ["broken"]
    (alert,) = result.alerts.collect()
    assert (alert.customer_id, alert.risk_score, alert.alert_date) == ("CUST016", 64, datetime(2024, 2, 2))
    assert (alert.aggregated_value, alert.threshold, alert.transaction_count) == (19300.0, 15000.0, 3)
    assert alert.trigger_reason == (
        "Customer Karen Martinez (Student, Income: 7500) triggered 'Complex International Wire Structuring Detection'. "
        "SUM(transaction_amount): 19,300.00 across 3 transactions in 30-day window. Dynamic threshold of 15,000.00 used "
        "(formula: customer.annual_income * 0.5, based on annual_income). "
    )
    links = sorted((r.transaction_id, r.sequence_order, float(r.contribution_percentage)) for r in result.alert_transactions.collect())
    assert links == [("TX019", 1, 32.12), ("TX040", 2, 30.57), ("TX061", 3, 37.31)]
    assert not alert.excluded and result.exclusion_logs.count() == 0


def test_refinement_excludes_verified_tuition(data, tiny_hot):
    config = {**RULE, "refinements": [
        {"type": "event_based", "rule_id": "off", "enabled": False, "config": {"excluded_events": ["loan"]}},
        {"type": "event_based", "rule_id": "edu", "excluded_events": ["education"]},
    ]}
    result = run_rules({"S1": config}, *data[:2], "R1", data[2], with_links=False)
    (alert,) = result.alerts.collect()
    assert alert.excluded and alert.exclusion_reason == "Verified education transaction to Imperial College London"
    (log,) = result.exclusion_logs.collect()
    assert (log.rule_id, log.risk_flags.event_type, log.risk_flags.amount) == ("edu", "education", 7200.0)


def test_date_range_and_segment(data):
    segment = {**RULE, "threshold": {"type": "segment", "segment": {"field": "occupation", "values": [{"segment": " student ", "threshold": 6000}]}}}
    result = run_rules({"S1": segment}, *data[:2], "R1", start="2024-01-15", end=None, with_links=False)
    got = {r.customer_id: (r.aggregated_value, r.risk_score) for r in result.alerts.collect()}
    assert got == {"CUST001": (6100.0, 50), "CUST010": (6700.0, 55), "CUST016": (13100.0, 100)}


def test_grouped_rule_and_dry_runs(data):
    config = {
        "filters": {"channel": [WIRE], "amount_range": {"min": 1000}},
        "aggregation": {"method": "sum", "field": "transaction_amount", "group_by": ["customer_id"],
                        "time_window": {"value": 1, "unit": "months", "type": "calendar"}},
        "threshold": {"type": "fixed", "fixed_value": 6100},
    }
    result = run_rules({"G": config}, *data[:2], "R1")
    got = sorted((r.customer_id, r.aggregated_value, r.risk_score, r.risk_classification) for r in result.alerts.collect())
    assert got == [("CUST001", 10300.0, 40, "MEDIUM"), ("CUST016", 7200.0, 25, "LOW"), ("CUST016", 12100.0, 40, "MEDIUM")]
    assert result.alert_transactions.count() == 5
    report, shown = dry_run_grouped(*data[:2], make_rule("G", config))
    assert tuple(report.first()) == (3, 5, 4) and shown.count() == 3
    count, first = dry_run_peak(*data[:2], make_rule("S1", RULE))
    assert count.first()[0] == 1 and first.count() == 1


def test_rolling_rule_links(data):
    config = {
        "aggregation": {"method": "sum", "field": "transaction_amount", "group_by": ["customer_id"],
                        "time_window": {"value": 30, "unit": "days", "type": "rolling"}},
        "threshold": {"type": "segment_based", "segment_based": {"segment_field": "occupation", "values": {"Student": 12000}, "default": 99}},
        "alert_condition": {"expression": "aggregated_value > threshold and txn_count >= 2"},
    }
    result = run_rules({"G": config}, *data[:2], "R1")
    got = sorted((r.customer_id, r.alert_date.day, r.aggregated_value, r.customer_name) for r in result.alerts.collect())
    assert got == [("CUST016", 2, 19300.0, "Karen Martinez"), ("CUST016", 22, 12100.0, "Karen Martinez")]
    assert result.alert_transactions.count() == 5


def test_rule_mapping_reaches_keys_and_thresholds(data):
    transactions = data[0].withColumnsRenamed({"transaction_amount": "amt", "customer_id": "who"})
    customers = data[1].withColumnRenamed("customer_id", "who")
    config = {
        "filters": [{"field": "transaction_amount", "operator": ">", "value": 5000}],
        "aggregation": {"method": "sum", "field": "transaction_amount", "group_by": ["customer_id"]},
        "threshold": {"type": "fixed", "fixed_value": 12000},
        "field_mappings": {"transaction_amount": "amt"},
    }
    result = run_rules({"G": config}, transactions, customers, "R1", mapping={"customer_id": "who"})
    assert [(r.customer_id, r.aggregated_value) for r in result.alerts.collect()] == [("CUST016", 19300.0)]
    assert result.alert_transactions.count() == 3


def test_gap_reads_details_of_stored_alerts(data):
    from txnwatch.operators.risk import excluded_candidates, gap_candidates, gap_report, score_peak
    from txnwatch.rules import Refinement

    config = {**RULE, "scenario_name": "University wires", "refinements": [{"type": "event_based", "rule_id": "edu", "excluded_events": ["education"]}]}
    alerts = run_rules({"S1": config}, *data[:2], "R1", data[2], with_links=False).alerts
    people = data[1].selectExpr("customer_id", "'1' as is_pep", "'high' as risk_rating")
    report = gap_report(score_peak(gap_candidates(alerts, [Refinement("e", ("education",))]), people)).first()
    assert (report.risk_score, report.risk_level, report.excluded_count) == (35.0, "DANGEROUS", 1)
    assert report.sample_exploits == ["Exploit: Customer is PEP"]
    row = excluded_candidates(alerts).first()
    assert (row.reason, row.amount) == ("Verified education transaction to Imperial College London", 19300.0)
