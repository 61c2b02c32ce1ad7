"""Peak and trailing windows against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from txnwatch.operators.windows import DAY, in_peak_window, peak_windows, trailing_rows, trailing_windows

FUNCTIONS = ["sum", "count", "avg", "max", "min"]


def sample(seed, customers=12, coarse=True):
    rng = random.Random(seed)
    rows = []
    for c in range(customers):
        size = 60 if c == 0 else rng.randint(1, 12)
        for i in range(size):
            day = rng.randint(0, 40)
            extra = 0 if coarse else rng.randint(0, 86_399_999_999)
            when = datetime(2024, 1, 1) + timedelta(days=day, microseconds=extra)
            amount = rng.choice([0, 5, 10, 10, 25, -5, -20, 100, 7.5, None]) if c % 3 else rng.randint(-50, 3)
            rows.append((f"T{c}_{i:03d}", f"C{c}", when, amount))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(
        [(t, c, w, None if a is None else float(a)) for t, c, w, a in rows],
        "transaction_id string, customer_id string, transaction_date timestamp, transaction_amount double",
    ).repartition(3)


def apply(function, values):
    return {
        "sum": lambda v: sum(v), "count": lambda v: float(len(v)), "avg": lambda v: sum(v) / len(v),
        "max": max, "min": min,
    }[function](values)


def loop_peak(rows, days, function):
    out = {}
    for customer in {r[1] for r in rows}:
        items = sorted((w, float(a or 0), t) for t, c, w, a in rows if c == customer)
        best, chosen = 0.0, []
        for i, start in enumerate(items):
            window = [it for it in items[i:] if it[0] <= start[0] + timedelta(days=days)]
            got = apply(function, [it[1] for it in window])
            if got > best:
                best, chosen = got, window
        out[customer] = (
            round(best, 6), len(chosen), (chosen or items)[-1][0], {it[2] for it in chosen}, len(items)
        )
    return out


@pytest.mark.parametrize("function", FUNCTIONS)
@pytest.mark.parametrize("seed,coarse", [(1, True), (3, False)])
def test_peak_equals_loop(spark, tiny_hot, function, seed, coarse):
    rows = sample(seed, coarse=coarse)
    data = frame(spark, rows)
    windows = peak_windows(data, 7, function)
    linked = {}
    for r in in_peak_window(data, windows).select("customer_id", "transaction_id").collect():
        linked.setdefault(r.customer_id, set()).add(r.transaction_id)
    got = {
        r.customer_id: (
            round(r.aggregated_value, 6), r.transaction_count, r.alert_date,
            linked.get(r.customer_id, set()), r.customer_transactions,
        )
        for r in windows.collect()
    }
    assert got == loop_peak(rows, 7, function)


@pytest.mark.parametrize("function", ["sum", "avg"])
def test_peak_without_hot_keys_is_the_same(spark, function):
    rows = sample(5)
    got = {r.customer_id: (round(r.aggregated_value, 6), r.transaction_count) for r in peak_windows(frame(spark, rows), 3, function).collect()}
    assert got == {c: v[:2] for c, v in loop_peak(rows, 3, function).items()}


@pytest.mark.parametrize("function", FUNCTIONS)
def test_trailing_equals_loop(spark, tiny_hot, function):
    rows = sample(9, coarse=function in ("sum", "min"))
    got = {
        r.transaction_id: (None if r.aggregated_value is None else round(r.aggregated_value, 6), r.transaction_count)
        for r in trailing_rows(frame(spark, rows), 5 * DAY, function).collect()
    }
    want = {}
    for t, c, w, _ in rows:
        window = [a for _, c2, w2, a in rows if c2 == c and w - timedelta(days=5) <= w2 <= w]
        filled = [float(a) for a in window if a is not None]
        if function == "count":
            value = float(len(window))
        elif function == "sum":
            value = sum(filled)
        else:
            value = apply(function, filled) if filled else None
        want[t] = (None if value is None else round(value, 6), len(window))
    assert got == want


def test_one_customer_one_instant(spark, tiny_hot):
    rows = [(f"T{i}", "C", datetime(2024, 1, 1), v) for i, v in enumerate([-3, -1, -1, 4, 0, 4])]
    row = peak_windows(frame(spark, rows), 30, "sum").collect()[0]
    assert (row.aggregated_value, row.transaction_count, float(row.start_value)) == (8.0, 3, 0.0)


def test_empty_input(spark):
    data = frame(spark, sample(1)).filter(F.lit(False))
    assert peak_windows(data, 30, "sum").count() == 0
    assert trailing_windows(data, DAY, "avg").count() == 0


@pytest.mark.parametrize("bound", ["3", "1000000"])
def test_window_may_start_at_a_loss(spark, bound):
    """Only the last of equal losses starts a window, when a later start would reach a larger loss."""
    spark.conf.set("spark.txnwatch.hotRows", bound)
    days = [("T1", 0, -1), ("T2", 0, -1), ("T3", 1, 50), ("T4", 7, 100), ("T5", 8, -1000)]
    data = frame(spark, [(t, "C", datetime(2024, 1, 1) + timedelta(days=d), v) for t, d, v in days])
    windows = peak_windows(data, 7, "sum")
    row = windows.first()
    assert (row.aggregated_value, row.transaction_count, row.starts_at_last) == (149.0, 3, True)
    assert {r.transaction_id for r in in_peak_window(data, windows).collect()} == {"T2", "T3", "T4"}
    spark.conf.unset("spark.txnwatch.hotRows")
