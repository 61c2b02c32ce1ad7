"""Choices that differ from a naive reading, and edge cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from txnwatch.functions.text import display_id, plain
from txnwatch.operators import compare, filters, lifecycle, profile, quality
from txnwatch.operators.refine import event_type, verified_names
from txnwatch.operators.threshold import threshold_column
from txnwatch.plans.grouped import grouped_alerts
from txnwatch.plans.peak import peak_alerts
from txnwatch.rules import Threshold, make_rule


@pytest.fixture
def people(spark):
    return spark.createDataFrame(
        [("1", " Student ", 100.0, "x"), ("2", None, None, "7"), ("3", "Retired", -5.0, None)],
        "customer_id string, occupation string, annual_income double, code string",
    )


@pytest.fixture
def txns(spark):
    return spark.createDataFrame(
        [("a", "1", datetime(2024, 1, 1), -5.0, None), ("b", "1", datetime(2024, 1, 2), -1.0, "W"), ("c", "2", datetime(2024, 1, 3), None, "w1")],
        "transaction_id string, customer_id string, transaction_date timestamp, transaction_amount double, channel string",
    )


def values(df, config):
    return [r[0] for r in df.orderBy("customer_id").select(threshold_column(config, df.columns)).collect()]


def test_thresholds(people):
    inf = float("inf")
    assert values(people, Threshold("segment", segment_field="occupation", segments=(("student", 5.0), ("", 9.0)))) == [5.0, 9.0, inf]
    assert values(people, Threshold("segment", segment_field="occupation")) == [inf] * 3
    assert values(people, Threshold("dynamic", reference_field="code", formula="reference_field * 2", fallback=1.0)) == [1.0, 14.0, 0.0]
    assert values(people, Threshold("dynamic", reference_field="annual_income", formula="100 / reference_field", fallback=8.0)) == [1.0, 8.0, 0.0]
    assert values(people, Threshold("dynamic", reference_field="annual_income", formula="bad(", fallback=8.0)) == [8.0] * 3
    assert values(people, Threshold("dynamic", formula="1")) == [50000.0] * 3
    assert values(people, Threshold("field_based", reference_field="annual_income", formula="reference_field + 1")) == [101.0, 0.0, -4.0]


def test_zero_threshold_alerts_customers_without_gain(txns, people):
    """A peak of at most zero counts as 0, dated by the customer's last transaction, score 50."""
    rule = make_rule("S", {"threshold": {"type": "fixed", "fixed_value": 0}})
    got = {r.customer_id: (r.aggregated_value, r.transaction_count, r.risk_score, r.alert_date) for r in peak_alerts(txns, people, rule, "R").collect()}
    assert got == {"1": (0.0, 0, 50, datetime(2024, 1, 2)), "2": (0.0, 0, 50, datetime(2024, 1, 3))}


def test_infinite_threshold_never_alerts(txns, people):
    rule = make_rule("S", {"aggregation": {"function": "count"}, "threshold": {"type": "segment", "segment": {"field": "occupation", "values": []}}})
    assert peak_alerts(txns, people, rule, "R").count() == 0


def test_grouped_needs_strictly_more(txns, people):
    config = {"aggregation": {"method": "count", "field": "transaction_id", "group_by": ["customer_id"]}, "threshold": {"type": "fixed", "fixed_value": 2}}
    assert grouped_alerts(txns, people, make_rule("G", config), "R").count() == 0
    config["threshold"]["fixed_value"] = 1
    assert [r.customer_id for r in grouped_alerts(txns, people, make_rule("G", config), "R").collect()] == ["1"]


def test_group_by_customer_attribute(txns, people):
    config = {"aggregation": {"method": "count", "field": "transaction_id", "group_by": ["occupation"]}, "threshold": {"type": "fixed", "fixed_value": 1}}
    (alert,) = grouped_alerts(txns, people, make_rule("G", config), "R").collect()
    assert (alert.occupation, alert.customer_id, alert.aggregated_value) == (" Student ", "1", 2.0)


def test_not_equal_and_contains(txns):
    ids = lambda rules, p: sorted(r.transaction_id for r in filters.apply_filters(txns, None, rules, p).collect())
    assert ids([{"field": "channel", "operator": "!=", "value": "W"}], "grouped") == ["a", "c"]
    assert ids([{"field": "channel", "operator": "!=", "value": "W"}], "peak") == ["c"]
    assert ids([{"field": "channel", "operator": "contains", "value": "W"}], "grouped") == ["b", "c"]
    assert ids([{"field": "channel", "operator": "contains", "value": "."}], "grouped") == []
    assert ids([{"field": "gone", "operator": "==", "value": 1}], "peak") == []
    assert ids([{"field": "transaction_amount", "operator": "in", "value": "-5, x"}], "peak") == ["a"]
    assert ids([{"field": "transaction_amount", "operator": "between", "value": [-2, 0]}], "peak") == ["b"]


def test_words_inside_words_and_literal_percent(spark):
    df = spark.createDataFrame([("Academic emit",), ("Insurance premium",), ("Loan and school",)], "n string")
    kinds = {r.n: (r.any, r.whole) for r in df.select("n", event_type("n").alias("any"), event_type("n", whole_words=True).alias("whole")).collect()}
    assert kinds == {"Academic emit": ("loan", None), "Insurance premium": ("loan", None), "Loan and school": ("education", "education")}
    names = spark.createDataFrame([("%",), ("oxford",), ("",), (None,)], "beneficiary_name string")
    listed = spark.createDataFrame([("University of Oxford", "University", True)], "entity_name string, entity_type string, is_active boolean")
    assert [r._key for r in verified_names(names, listed).collect()] == ["oxford"]


def test_empty_comparison_and_quality(spark):
    alerts = spark.createDataFrame([], "alert_id string, customer_id string, excluded boolean, risk_score int, alert_date timestamp, scenario_name string, aggregated_value double, trigger_reason string")
    assert tuple(compare.summary_peak(alerts, alerts).first()) == (0, 0, 0, 0.0, 0, 0, 0)
    safe = compare.exposure(compare.diff_peak(alerts, alerts)).first()
    assert (safe.risk_score, safe.risk_level, safe.sample_exploits, safe.total_suppressions) == (0.0, "SAFE", [], 0)
    nobody = spark.createDataFrame([], "transaction_id string, customer_id string, transaction_date timestamp, transaction_amount double")
    report = quality.quality_report(nobody, quality.transaction_issues(nobody, "2024-01-01")).first()
    assert (report.valid, report.quality_score, report.total_rows, report.clean_rows) == (True, 100, 0, 0)


def test_types_and_display(spark):
    df = spark.createDataFrame([("1", "2024-01-05", "Yes", "x", None), ("0", "13/01/2024", "no", "1", None)], "n string, d string, b string, t string, e string")
    got = {r.field_name: (r.field_type, r.null_count) for r in profile.field_metadata(df).collect()}
    assert got == {"n": ("numeric", 0), "d": ("date", 0), "b": ("boolean", 0), "t": ("text", 0), "e": ("text", 2)}
    shown = spark.createDataFrame([("ab12_c_d", 12345678.5), ("plain", 7.0)], "i string, v double").select(display_id("i"), plain("v")).collect()
    assert [tuple(r) for r in shown] == [("c_d", "12345678.5"), ("plain", "7.0")]


def test_sample_types_and_labels(txns):
    got = {f["name"]: (f["type"], f["label"]) for f in profile.sample_types(txns.schema)}
    assert got["transaction_amount"] == ("number", "Transaction Amount") and got["channel"] == ("string", "Channel")


def test_extension_is_capped_and_passed_on(spark):
    uploads = spark.createDataFrame([("u", datetime(2024, 1, 1), "active"), ("v", datetime(2024, 1, 1), "active")], "upload_id string, expires_at timestamp, status string")
    later = lifecycle.extend_expiry(uploads, "u", 500, "2024-01-01")
    rows = spark.createDataFrame([("u", None), ("w", datetime(2023, 1, 1))], "upload_id string, expires_at timestamp")
    got = {r.upload_id: r.expires_at for r in lifecycle.propagate_expiry(rows, later).collect()}
    assert got == {"u": datetime(2024, 1, 8), "w": datetime(2023, 1, 1)}
    assert later.filter(F.col("upload_id") == "v").first().expires_at == datetime(2024, 1, 1)
