"""Files from header to typed rows, and datasets."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from txnwatch.sources import datasets, ingest, sinks

CSV = "\n".join(
    [
        "\ufefftransaction_id,Cust_ID,Date,Amount,Note",
        'T1,C1,2024-03-04,10,"a, ""b"""',
        "T2,C2,03/04/2024,11.5,",
        ",C3,04/13/2024,-2,x",
        "T4,,2024-01-01,5,no customer",
        "T5,C1,someday,5,bad date",
        "T1,C1,2024-03-05T10:00:00,12,again",
    ]
)


@pytest.fixture
def upload(spark, tmp_path):
    path = tmp_path / "file.csv"
    path.write_text(CSV, encoding="utf-8")
    return ingest.read_delimited(spark, str(path))


def test_read_and_kind(upload):
    assert upload.columns[0] == "transaction_id" and upload.first().Note == 'a, "b"'
    assert ingest.kind_of(upload.columns) == ingest.TRANSACTIONS
    assert ingest.kind_of([" Cust_ID ", "x"]) == ingest.CUSTOMERS
    with pytest.raises(ingest.UnknownFile):
        ingest.kind_of(["a", "b"])


def test_peak_ingest(upload):
    kind, good, rejects = ingest.ingest(upload, "peak", "U-123456789")
    rows = {(r.customer_id, r.transaction_date, r.amount) for r in good.collect()}
    assert kind == ingest.TRANSACTIONS and dict(good.dtypes)["amount"] == "double"
    assert rows == {
        ("C1", datetime(2024, 3, 4), 10.0), ("C2", datetime(2024, 4, 3), 11.5), ("C3", datetime(2024, 4, 13), -2.0),
        ("C1", datetime(2024, 3, 5, 10), 12.0),
    }
    assert sorted(r.error for r in rejects.collect()) == ["Missing required fields: customer_id", "Unreadable date: someday"]
    generated = good.filter(F.col("customer_id") == "C3").first().transaction_id
    assert len(generated) == 64


def test_grouped_ingest_prefixes_customers(upload):
    _, good, rejects = ingest.ingest(upload, "grouped", "U-123456789")
    assert {r.customer_id for r in good.collect()} == {"U-123456_C1", "U-123456_C2"}
    assert rejects.count() == 3


def test_last_wins_and_stubs(spark):
    rows = spark.createDataFrame([("T1", "C1", 1), ("T1", "C2", 2), ("T2", "C3", 3)], "transaction_id string, customer_id string, seq int")
    assert {(r.transaction_id, r.customer_id) for r in datasets.last_wins(rows, ["transaction_id"], "seq").collect()} == {("T1", "C2"), ("T2", "C3")}
    known = spark.createDataFrame([("C1", "x")], "customer_id string, occupation string")
    stubs = {(r.customer_id, r.auto_created) for r in datasets.with_stubs(rows, known).collect()}
    assert stubs == {("C1", False), ("C2", True), ("C3", True)}


def test_empty_and_all_null_columns(spark):
    df = spark.createDataFrame([(" ", None), ("", "7")], "a string, b string")
    assert ingest.column_types(df, ["a", "b"]) == {"a": "string", "b": "bigint"}
    assert ingest.cast_cells(df, {"a": "string", "b": "bigint"}).collect()[0].a is None


def test_csv_of_nested_columns(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"])], "id string, tags array<string>")
    sinks.write_csv(df, str(tmp_path / "out"))
    assert ingest.read_delimited(spark, str(tmp_path / "out")).first().tags == '["x","y"]'
