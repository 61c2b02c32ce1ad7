"""Rule objects and formula text; no data is read."""

import pytest

from txnwatch.functions.expressions import FormulaError, formula, names_in, parse
from txnwatch.operators.mapping import map_columns
from txnwatch.rules import GROUPED, PEAK, RuleError, make_rule, map_rule, mapping_gaps, required_fields, schema_check


def test_both_spellings():
    peak = make_rule("P", {"aggregation": {"function": "avg", "rolling_window_days": 0}, "threshold": {"type": "fixed"}})
    assert (peak.profile, peak.function, peak.window_days, peak.threshold.fixed) == (PEAK, "avg", 30, 0.0)
    grouped = make_rule("G", {"aggregation": {"method": "mean", "group_by": ["a"], "time_window": {"value": 6, "unit": "hours", "type": "rolling"}}})
    assert (grouped.profile, grouped.function, grouped.group_by) == (GROUPED, "avg", ("a",))
    assert grouped.time_window.micros == 6 * 3_600_000_000


def test_refinement_events_from_either_place():
    rule = make_rule("P", {"refinements": [{"type": "event_based", "excluded_events": ["loan"]},
                                           {"type": "event_based", "config": {"excluded_events": ["education"], "rule_id": "x"}, "enabled": False}]})
    assert [r.events for r in rule.refinements] == [("loan",), ("education",)]
    assert rule.refinements[1].rule_id == "x" and not rule.refinements[1].enabled


@pytest.mark.parametrize("config", [
    {"aggregation": {"method": "median", "group_by": ["a"]}},
    {"aggregation": {"method": "sum"}, "threshold": {"type": "fixed"}},
    {"aggregation": {"method": "sum"}, "threshold": {"type": "customer_based"}},
    {"aggregation": {"method": "sum", "time_window": {"value": 1, "unit": "weeks", "type": "rolling"}}},
    {"threshold": {"type": "dynamic", "dynamic": {"fallback_value": "much"}}},
])
def test_unusable_rules(config):
    with pytest.raises(RuleError):
        make_rule("X", config)


def test_map_rule_and_required_fields():
    rule = make_rule("G", {
        "filters": [{"field": "customer.job", "operator": "==", "value": 1}, {"field": "amt", "operator": ">", "value": 1}],
        "aggregation": {"method": "sum", "field": "amt", "group_by": ["who"]},
        "threshold": {"type": "segment_based", "segment_based": {"segment_field": "seg", "values": {}, "default": 1}},
    })
    assert required_fields([rule]) == {"job", "amt", "who", "seg"}
    renamed = map_rule(rule, {"amt": "amount", "who": "customer_id", "seg": "occupation"})
    assert required_fields([renamed]) == {"job", "amount", "customer_id", "occupation"}
    check = {c["field"]: (c["source"], c["missing"]) for c in schema_check([renamed], ["amount", "customer_id"], ["occupation"])}
    assert check == {"amount": ("transaction", False), "customer_id": ("transaction", False), "job": (None, True), "occupation": ("customer", False)}
    assert mapping_gaps({"transaction_id": "id", "customer_id": "c"}, "transaction") == ["transaction_date", "transaction_amount"]
    assert mapping_gaps({}, "unknown") == []


def test_map_columns_drops_existing_target(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert map_columns(df, {"b": "a", "x": "nowhere"}).columns == ["b", "c"]
    swapped = map_columns(df, {"a": "b", "b": "a"}).first().asDict()
    assert swapped == {"b": 1, "a": 2, "c": 3}


@pytest.mark.parametrize("text", [
    "__import__('os').system('x')", "a.b.c", "[x for x in (1,)]", "lambda: 1", "open('f')", "reference_field if 1 else 2", "1 +", "a[0]", "f(x=1)",
])
def test_text_outside_the_notation_is_refused(spark, text):
    with pytest.raises(FormulaError):
        formula(text, {})


def test_formula_values(spark):
    from pyspark.sql import functions as F

    names = {"x": F.col("x"), "y": F.col("y"), "s": F.col("s")}
    cases = {
        "x * 2 + 1": 9.0, "x ** 2 / 8": 2.0, "x / y": None, "-x % 3": -1.0, "max(x, 10) - min(x, 1)": 9.0, "abs(-x)": 4.0, "int(x / 3)": 1.0,
        "x > 3 and not s == 'a'": True, "1 < x <= 4": True, "s in ['b', 'c']": True, "s > 3": None, "s == 3": None, "s + 1": None, "s >= 'a'": True, "s not in ('b',)": False, "x < 1 or y == 0": True,
    }
    df = spark.createDataFrame([(4.0, 0.0, "b")], "x double, y double, s string")
    row = df.select(*[formula(text, names).alias(f"c{i}") for i, text in enumerate(cases)]).first()
    assert list(row) == [v if v is None or isinstance(v, bool) else pytest.approx(v) for v in cases.values()]
    assert names_in("customer.annual_income * 2 > max(a, b)") == {"annual_income", "a", "b"}
    assert parse(" 1 ").value == 1
