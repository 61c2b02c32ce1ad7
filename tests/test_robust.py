"""Extreme amounts, equal rows, bad cells and bad rules."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from txnwatch.operators import lifecycle, skew
from txnwatch.operators.aggregate import contributions
from txnwatch.operators.quality import transaction_issues
from txnwatch.operators.refine import refine, verified_names
from txnwatch.operators.windows import amount_of, in_peak_window, number, peak_windows, trailing_windows
from txnwatch.plans.run import run_rules
from txnwatch.rules import GROUPED, Refinement
from txnwatch.sources.ingest import fill_missing_ids, read_delimited

TXN = "transaction_id string, customer_id string, transaction_date string, transaction_amount string, transaction_narrative string, beneficiary_name string"


def test_amounts_of_any_size(spark):
    cells = ["1e20", "4e-7", "2e18", "1e300", "-1e300", "NaN", "Infinity", "abc", None, "12.50"]
    df = spark.createDataFrame([(c,) for c in cells], "a string")
    assert [r[0] for r in df.select(number("a").cast("double")).collect()] == [1e20, 4e-7, 2e18, 1e21, -1e21, 0.0, 1e21, 0.0, 0.0, 12.5]
    assert [r[0] is None for r in df.select(amount_of("a")).collect()] == [c in ("NaN", "abc", None) for c in cells]


def test_windows_take_unreadable_cells(spark):
    rows = [("1", "c", "2024-01-01", "5", None, None), ("2", "c", "some day", "7", None, None), ("3", "c", "2024-01-02", "x", None, None)]
    df = spark.createDataFrame(rows, TXN)
    best = peak_windows(df).first()
    assert (best.aggregated_value, best.transaction_count) == (5.0, 2)
    assert trailing_windows(df, 86_400_000_000).count() == 2
    assert {r.transaction_id for r in in_peak_window(df, peak_windows(df)).collect()} == {"1", "3"}
    assert {(r.field, r["count"]) for r in transaction_issues(df, "2025-01-01").collect()} == {("transaction_amount", 1), ("transaction_date", 1)}


def test_equal_rows_keep_their_own_ids(spark):
    df = spark.createDataFrame([(None, "c", "5"), (None, "c", "5"), (" ", "c", "5"), ("t", "c", "5"), (None, "d", "5")], "transaction_id string, customer_id string, x string")
    ids = [r.transaction_id for r in fill_missing_ids(df).collect()]
    assert len(ids) == 5 and len(set(ids)) == 5 and "t" in ids
    assert set(ids) == {r.transaction_id for r in fill_missing_ids(df.repartition(3)).collect()}


@pytest.mark.parametrize("hot", ["1000000", "2"])
def test_refunds_leave_shares(spark, hot):
    spark.conf.set("spark.txnwatch.hotRows", hot)
    df = spark.createDataFrame([("a", "1", "2024-01-01", "1000"), ("a", "2", "2024-01-02", "-999")], "alert_id string, transaction_id string, transaction_date string, transaction_amount string")
    out = [(r.transaction_id, float(r.contribution_percentage), r.sequence_order) for r in contributions(df).collect()]
    spark.conf.unset("spark.txnwatch.hotRows")
    assert sorted(out) == [("1", 100000.0, 1), ("2", -99900.0, 2)]


def test_long_lists_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "LISTED_KEYS", 1)
    df = spark.createDataFrame([(str(k % 3), k) for k in range(30)], "c string, v int")
    hot = skew.hot_groups(df, ["c"], 5)
    assert sorted(r.c for r in hot.collect()) == ["0", "1", "2"]
    assert skew.skew_join(df, df.groupBy("c").count(), ["c"], hot=hot).count() == 30


RULE = {
    "scenario_name": "sum", "aggregation": {"method": "sum", "field": "transaction_amount", "group_by": ["customer_id"]},
    "threshold": {"type": "fixed", "fixed_value": 1}, "refinements": [{"type": "event_based", "rule_id": "r", "excluded_events": ["loan"]}],
}


def test_a_bad_rule_costs_the_others_nothing(spark):
    rows = [("1", "c", "2024-01-01", "5", "Loan EMI", "x"), ("2", "d", "2024-01-01", "7", "gift", "y")]
    df, people = spark.createDataFrame(rows, TXN), spark.createDataFrame([("c", "Ann"), ("d", "Bob")], "customer_id string, customer_name string")
    lost = {**RULE, "aggregation": {**RULE["aggregation"], "group_by": ["nowhere"]}}
    result = run_rules({"good": RULE, "lost": lost}, df, people, "R")
    assert list(result.rejected) == ["lost"]
    # No whitelist: loans are still excluded.
    assert {(r.customer_id, r.excluded) for r in result.alerts.collect()} == {("c", True), ("d", False)}
    assert result.exclusion_logs.count() == 1 and result.alert_transactions.count() == 2
    record = result.record("2024-02-01").first()
    assert (record.status, record.total_alerts, record.excluded_alerts, record.scenarios_rejected) == ("completed", 2, 1, ["lost"])
    assert run_rules({"lost": lost}, df, people, "R").record("2024-02-01").first().status == "failed"


def test_run_over_chosen_uploads(spark):
    rows = [("1", "c", "2024-01-01", "5", None, None, "u1"), ("2", "c", "2024-01-01", "7", None, None, "u2")]
    df = spark.createDataFrame(rows, TXN + ", upload_id string")
    people = spark.createDataFrame([("c", "Ann", "u1")], "customer_id string, customer_name string, upload_id string")
    some = spark.createDataFrame([("u1",)], "upload_id string")
    assert [r.aggregated_value for r in run_rules({"a": RULE}, df, people, "R", uploads=some).alerts.collect()] == [5.0]


def test_grouped_gate(spark):
    rows = [("1", "a", "2024-01-05", "5", "fd maturity", "x"), ("2", "b", "2024-01-05", "5", "semester emi", "x"), ("3", "c", "2024-01-05", "5", "emi", "x"), ("4", "c", "2020-01-05", "5", "credit card", "x")]
    alerts = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c")], "alert_id string, customer_id string").withColumn("alert_date", F.lit("2024-01-06").cast("timestamp"))
    entities = spark.createDataFrame([], "entity_name string, entity_type string, is_active boolean")
    rules = [Refinement("deposits", ("fixed_deposit",)), Refinement("loans", ("loan",))]
    df = spark.createDataFrame(rows, TXN)
    marks = lambda profile: {r.alert_id: r.exclusion_rule_id for r in refine(alerts, df, entities, rules, profile=profile).collect()}
    assert marks(GROUPED) == {"A": None, "B": None, "C": "loans"}
    assert marks("peak") == {"A": "deposits", "B": None, "C": "loans"}


def test_cleanup_of_json_details(spark):
    uploads = spark.createDataFrame([("u", "active", "2024-01-01")], "upload_id string, status string, e string").withColumn("expires_at", F.col("e").cast("timestamp"))
    people = spark.createDataFrame([("c", "u")], "customer_id string, upload_id string")
    details = ['{"n":1,"customer_name":"Ann Lee"}', "{}", None]
    alerts = spark.createDataFrame([(str(k), "c", "Ann Lee", False, d) for k, d in enumerate(details)], "alert_id string, customer_id string, customer_name string, is_anonymized boolean, trigger_details string")
    out = lifecycle.cleanup(uploads, people.withColumn("transaction_id", F.lit("1")), people, alerts, "2024-06-01")["alerts"].orderBy("alert_id").collect()
    assert [r.trigger_details for r in out] == ['{"n":1,"customer_name":"ANONYMIZED","pii_removed":"true"}', '{"pii_removed":"true"}', '{"pii_removed":"true"}']
    assert all(r.is_anonymized and r.customer_name == "ANONYMIZED-c" for r in out)


def test_whitelist_with_long_and_many_names(spark):
    many = spark.range(100_000).select(F.concat(F.lit("Entity number "), "id").alias("entity_name"), F.lit("University").alias("entity_type"), F.lit(True).alias("is_active"))
    names = many.union(spark.createDataFrame([("x" * 1990 + "needle" + "y" * 10, "University", True)], many.schema))
    keys = spark.createDataFrame([("Needle",), ("number 99999",), ("nobody",), ("z" * 3000,)], "beneficiary_name string")
    assert sorted(r._key for r in verified_names(keys, names).collect()) == ["needle", "number 99999"]


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"two\nlines"\n2,x\n')
    assert [(r.id, r.text) for r in read_delimited(spark, str(tmp_path / "a.csv"), multi_line=True).collect()] == [("1", "two\nlines"), ("2", "x")]


def test_windows_share_one_exchange(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").selectExpr(
        "cast(o_custkey as string) customer_id", "o_orderkey transaction_id", "o_orderdate transaction_date", "o_totalprice transaction_amount"
    )
    for df in (peak_windows(orders), trailing_windows(orders, 30 * 86_400_000_000)):
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            df.explain(mode="simple")
        assert text.getvalue().count("Exchange hashpartitioning") == 1
