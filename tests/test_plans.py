"""Plans keep the properties that matter on large data."""

import contextlib
import io

import pytest

from catalog import QUERIES, SQL
from txnwatch.operators.windows import peak_windows
from txnwatch.sources.datasets import last_wins

SMALL = "/root/testdata/sf0.001"


def plan(df, mode="formatted"):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode=mode)
    return text.getvalue()


@pytest.mark.parametrize("name", ["e12_peak_alerts", "f4_f6_decision", "g8_gap_g", "e17_rolling_links", "c6_whitelist"])
def test_no_pairwise_joins_or_python(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas"):
        assert word not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["b7_greater"](spark, SMALL))
    assert "GreaterThan(o_totalprice,250000.0)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in text


def test_duplicates_are_limited_before_the_shuffle(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    assert "WindowGroupLimit" in plan(last_wins(orders, ["o_custkey"], "o_orderkey"))


def test_window_nodes_are_merged_by_hash(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").selectExpr(
        "cast(o_custkey as string) customer_id", "o_orderkey transaction_id", "o_orderdate transaction_date", "o_totalprice transaction_amount"
    )
    lines = plan(peak_windows(orders), "simple").splitlines()
    merged = [line for line in lines if "Aggregate(key" in line and ", at#" in line.split("functions")[0]]
    assert len(merged) == 2 and all("HashAggregate" in line for line in merged)


def test_every_query_has_a_twin():
    assert set(SQL) == set(QUERIES)
    assert len(QUERIES) > 130
