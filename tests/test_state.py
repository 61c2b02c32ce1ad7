"""Stored state: whole steps or nothing."""

import os

import pytest
from pyspark.sql import functions as F

from txnwatch.sources import state


def rows(spark, folder, table, *columns, only=None):
    return sorted(tuple(r) for r in state.read_table(spark, folder, table, only).select(*columns).collect())


def alerts(spark, *pairs):
    return spark.createDataFrame(list(pairs), "alert_id string, run_id string")


def bytes_in(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def test_a_run_is_replaced_as_a_whole(spark, tmp_path):
    folder = str(tmp_path)
    state.write_run({"alerts": alerts(spark, ("a", "R1"), ("b", "R2")), "alert_transactions": spark.createDataFrame([("a", "t")], "alert_id string, transaction_id string")}, folder, "R1")
    assert rows(spark, folder, "alerts", "alert_id", "run_id") == [("a", "R1"), ("b", "R2")]
    state.write_run({"alerts": alerts(spark, ("c", "R2"))}, folder, "R2")
    assert rows(spark, folder, "alerts", "alert_id", "run_id") == [("a", "R1"), ("c", "R2")]
    # A rerun without alerts leaves none, also in tables that it does not bring.
    state.write_run({"alerts": alerts(spark, ("x", "x")).limit(0)}, folder, "R1")
    assert rows(spark, folder, "alerts", "alert_id", "run_id") == [("c", "R2")]
    assert rows(spark, folder, "alert_transactions", "alert_id") == []
    state.write_run({}, folder, "R2")
    assert rows(spark, folder, "alerts", "alert_id") == []


def test_a_lost_write_changes_nothing(spark, tmp_path):
    folder = str(tmp_path)
    state.write_run({"alerts": alerts(spark, ("a", "R1"))}, folder, "R1")
    bad = alerts(spark, ("b", "R1")).withColumn("x", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        state.write_run({"alert_exclusion_logs": alerts(spark, ("z", "R1")), "alerts": bad}, folder, "R1")
    assert rows(spark, folder, "alerts", "alert_id") == [("a",)]
    assert state.manifest(spark, folder).version == 1
    # What was left behind goes with the next vacuum, and old versions stay readable until then.
    state.write_run({"alerts": alerts(spark, ("c", "R1"))}, folder, "R1")
    old = state.manifest(spark, folder, 1)
    assert [r.alert_id for r in state.read_table(spark, folder, "alerts", at=old).collect()] == ["a"]
    assert state.vacuum(spark, folder) >= 2
    assert rows(spark, folder, "alerts", "alert_id") == [("c",)]


def test_two_writers(spark, tmp_path):
    folder = str(tmp_path)
    state.write_run({"alerts": alerts(spark, ("a", "R1"))}, folder, "R1")
    seen = state.manifest(spark, folder)
    state.write_run({"alerts": alerts(spark, ("b", "R2"))}, folder, "R2")
    with pytest.raises(state.ConflictError):
        state.commit(spark, folder, {"alerts": alerts(spark, ("c", "R1"))}, {}, seen)
    assert rows(spark, folder, "alerts", "alert_id") == [("a",), ("b",)]


def test_odd_keys(spark, tmp_path):
    folder = str(tmp_path)
    keys = ["a b", "x/y=z:%", "é#?", "{q}", None]
    df = spark.createDataFrame([(str(k), key) for k, key in enumerate(keys)], "alert_id string, run_id string")
    state.commit(spark, folder, {"alerts": df}, {})
    assert set(state.manifest(spark, folder).parts["alerts"]) == set(keys)
    assert sorted(r.run_id or "" for r in state.read_table(spark, folder, "alerts").collect()) == sorted(k or "" for k in keys)
    assert rows(spark, folder, "alerts", "alert_id", only=["x/y=z:%"]) == [("1",)]
    state.commit(spark, folder, {}, {"alerts": {"x/y=z:%", None, "é#?"}})
    assert rows(spark, folder, "alerts", "alert_id") == [("0",), ("3",)]
    with pytest.raises(KeyError):
        state.read_table(spark, folder, "nothing")


@pytest.fixture
def dataset(spark, tmp_path):
    folder = str(tmp_path / "state")
    txns = spark.range(4000).select(F.col("id").cast("string").alias("transaction_id"), F.concat(F.lit("c"), F.col("id") % 7).alias("customer_id"), F.concat(F.lit("u"), F.col("id") % 4).alias("upload_id"), F.lit(1.0).alias("amount"), F.lit(0).alias("seq"))
    people = spark.createDataFrame([(f"c{k}", f"Name {k}", f"u{k % 4}") for k in range(7)], "customer_id string, customer_name string, upload_id string")
    uploads = spark.createDataFrame([("u0", "active", "2024-01-01"), ("u1", "active", "2030-01-01")], "upload_id string, status string, e string").select("upload_id", "status", F.col("e").cast("timestamp").alias("expires_at"))
    runs = spark.createDataFrame([("R0", "u0"), ("R1", "u1"), ("R2", "u1")], "run_id string, upload_id string")
    found = spark.createDataFrame([("A0", "c0", "Name 0", "R0", "{}"), ("A1", "c1", "Name 1", "R1", "{}"), ("A2", "c4", "Name 4", "R2", '{"n":1}')], "alert_id string, customer_id string, customer_name string, run_id string, trigger_details string")
    links = spark.createDataFrame([("A0", "0", "R0"), ("A2", "4", "R2")], "alert_id string, transaction_id string, run_id string")
    state.commit(spark, folder, {"transactions": txns, "customers": people, "uploads": uploads, "runs": runs, "alerts": found, "alert_transactions": links}, {})
    return folder


def test_dropping_an_upload_writes_no_data(spark, dataset):
    before = bytes_in(dataset)
    state.drop_upload(spark, dataset, "u1", keep=["customers", "uploads"])
    assert bytes_in(dataset) == before
    assert {r.upload_id for r in state.read_table(spark, dataset, "transactions").select("upload_id").distinct().collect()} == {"u0", "u2", "u3"}
    assert rows(spark, dataset, "alerts", "alert_id") == [("A0",)] and rows(spark, dataset, "alert_transactions", "alert_id") == [("A0",)]
    assert rows(spark, dataset, "runs", "run_id") == [("R0",)] and state.read_table(spark, dataset, "customers").count() == 7


def test_new_rows_of_an_upload(spark, dataset):
    fresh = spark.createDataFrame([("n", "c1", 2.0, 0)], "transaction_id string, customer_id string, amount double, seq int")
    state.put_upload(spark, dataset, "u1", {"transactions": fresh})
    assert rows(spark, dataset, "transactions", "transaction_id", only=["u1"]) == [("n",)]
    assert state.read_table(spark, dataset, "transactions").count() == 3001
    assert rows(spark, dataset, "alerts", "alert_id") == [("A0",)] and state.read_table(spark, dataset, "customers").count() == 7


def test_a_small_batch_writes_few_bytes(spark, dataset):
    before = bytes_in(dataset)
    batch = spark.createDataFrame([("1", "c1", "u1", 9.0, 1), ("1", "c1", "u1", 8.0, 2), ("new", "c1", "u9", 7.0, 1)], "transaction_id string, customer_id string, upload_id string, amount double, seq int")
    state.upsert_rows(spark, dataset, "transactions", batch, ["transaction_id"], "seq")
    table = state.read_table(spark, dataset, "transactions")
    assert table.count() == 4001 and [r.amount for r in table.filter("transaction_id = '1'").collect()] == [8.0]
    assert bytes_in(dataset) - before < before / 2
    # A row keeps its place even if the batch names another partition; then it moves.
    state.upsert_rows(spark, dataset, "transactions", batch.filter("seq = 2").withColumn("upload_id", F.lit("u2")), ["transaction_id"], "seq")
    assert [r.upload_id for r in state.read_table(spark, dataset, "transactions").filter("transaction_id = '1'").collect()] == ["u2"]


def test_cleanup_in_one_step(spark, dataset):
    state.apply_cleanup(spark, dataset, "2024-06-01")
    assert state.manifest(spark, dataset).version == 2
    got = {r.alert_id: (r.customer_name, r.is_anonymized) for r in state.read_table(spark, dataset, "alerts").collect()}
    assert got == {"A0": ("ANONYMIZED-c0", True), "A1": ("Name 1", None), "A2": ("ANONYMIZED-c4", True)}
    assert rows(spark, dataset, "uploads", "upload_id", "status") == [("u0", "expired"), ("u1", "active")]
    assert "u0" not in state.manifest(spark, dataset).parts["transactions"]
    assert rows(spark, dataset, "customers", "customer_id", only=["u0"]) == []
    assert state.apply_cleanup(spark, dataset, "2024-06-01").version == 2
