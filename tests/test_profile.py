"""Value lists of fields with few values."""

from pyspark.sql import functions as F

from txnwatch.operators import profile
from txnwatch.operators.profile import field_value_index


def test_the_limit_is_exact(spark):
    rows = spark.range(6000).select(
        *[(F.col("id") % n).cast("string").alias(f"v{n}") for n in (3, 999, 1000, 1001, 1990, 5000)], F.lit("").alias("blank"), F.lit(None).cast("string").alias("none")
    )
    got = {r.field_name: r.n for r in field_value_index(rows).groupBy("field_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"v3": 3, "v999": 999}
    assert field_value_index(rows, below=1001).select("field_name").distinct().count() == 3


def test_ids_are_not_counted_by_value(spark, monkeypatch):
    seen = []
    counted = profile.value_counts
    monkeypatch.setattr(profile, "value_counts", lambda df, fields=None: seen.append(list(fields)) or counted(df, fields))
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    assert {r.field_name for r in field_value_index(orders).collect()} == {"o_orderstatus", "o_orderpriority"}
    assert seen == [["o_orderstatus", "o_orderpriority"]]
    assert field_value_index(orders, ["o_orderkey"]).collect() == [] and len(seen) == 1


def test_empty_table(spark):
    assert field_value_index(spark.createDataFrame([], "a string, b long")).collect() == []
