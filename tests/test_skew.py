"""Skew-safe building blocks against their plain counterparts."""

import random

import pytest
from pyspark.sql import functions as F

from txnwatch.operators.refine import lookback, refine
from txnwatch.operators.skew import hot_groups, list_join, next_after, numbered, skew_join
from txnwatch.operators.windows import micros
from txnwatch.rules import Refinement


def pairs(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def sides(spark):
    rng = random.Random(4)
    big = [(i, None if i % 17 == 0 else "hot" if i % 3 == 0 else f"k{rng.randint(0, 6)}") for i in range(120)]
    small = [("hot", 1), ("k1", 2), ("k2", 3), ("k9", 4), (None, 5)]
    return spark.createDataFrame(big, "id int, k string").repartition(3), spark.createDataFrame(small, "k string, w int")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_join(spark, tiny_hot, sides, how):
    big, small = sides
    assert hot_groups(big, ["k"]).count() > 1
    assert pairs(skew_join(big, small, ["k"], how, salt_on=["id"])) == pairs(big.join(small, "k", how))


def test_no_hot_keys_and_short_list(spark, sides):
    big, small = sides
    assert hot_groups(big, ["k"]) is None
    assert pairs(list_join(big, small, ["k"], "left_anti")) == pairs(big.join(small, "k", "left_anti"))


def test_numbered_numbers_each_group(spark):
    rows = [("a" if i % 3 else "b", i % 7, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, o int, id int").repartition(5)
    got = {(r.g, r.id): (r.n, r.t) for r in numbered(df, ["g"], ["o", "id"], "n", {"t": "o"}).collect()}
    for g in "ab":
        members = sorted((o, i) for gg, o, i in rows if gg == g)
        total = sum(o for o, _ in members)
        for place, (_, i) in enumerate(members, 1):
            assert got[(g, i)] == (place, total)


def test_next_after(spark, tiny_hot):
    rng = random.Random(8)
    items = [("g" if i % 2 else "h", rng.randint(0, 60) * 10**9, f"i{i}") for i in range(60)]
    probes = [("g" if i % 3 else "h", rng.randint(0, 70) * 10**9, i) for i in range(40)]
    left = spark.createDataFrame(probes, "g string, p long, id int").repartition(3)
    right = spark.createDataFrame(items, "g string, t long, name string").withColumn("item", F.struct("t", "name"))
    found = next_after(left, right, ["g"], "p", "t", "item", "hit", hot_groups(right, ["g"]))
    got = {(r.g, r.id): None if r.hit is None else (r.hit.t, r.hit.name) for r in found.collect()}
    want = {(g, i): min(((t, n) for gg, t, n in items if gg == g and t >= p), default=None) for g, p, i in probes}
    assert got == want


def test_refine_and_lookback_equal_loop(spark, tiny_hot):
    rng = random.Random(11)
    words = ["University fee", "Semester rent", "Car loan", "Fixed deposit", "Groceries", None, "Premium cinema"]
    names = ["oxford", "Cambridge", "", None, "Nowhere"]
    txns = [
        (f"T{i:03d}", f"C{rng.randint(0, 3)}", f"2024-01-{rng.randint(1, 28):02d}", rng.choice([10.0, 60000.0]), rng.choice(words), rng.choice(names))
        for i in range(90)
    ]
    alerts = [(f"A{c}{d}", f"C{c}", f"2024-01-{d:02d}") for c in range(5) for d in range(1, 29, 3)]
    types = "transaction_id string, customer_id string, d string, transaction_amount double, transaction_narrative string, beneficiary_name string"
    frame = spark.createDataFrame(txns, types).withColumn("transaction_date", F.to_timestamp("d"))
    marks = spark.createDataFrame(alerts, "alert_id string, customer_id string, d string").select(
        "alert_id", "customer_id", F.to_timestamp("d").alias("alert_date")
    )
    entities = spark.createDataFrame(
        [("University of Oxford", "University", True), ("Cambridge College", "University", False), ("Oxford Bank", "FinancialInstitution", True)],
        "entity_name string, entity_type string, is_active boolean",
    )
    rules = [Refinement("fd", ("fixed_deposit",)), Refinement("all", ("education", "loan"))]
    got = {r.alert_id: (r.excluded, r.exclusion_reason, r.exclusion_rule_id) for r in refine(marks, frame, entities, rules, 6).collect()}
    seen = {r.alert_id: (r.lookback_transactions, r.lookback_amount) for r in lookback(marks, frame, 6).collect()}

    def kind(text):
        low = (text or "").lower()
        for name, keys in (("education", ["university", "semester"]), ("loan", ["loan", "emi"]), ("fixed_deposit", ["fixed deposit"])):
            if any(k in low for k in keys):
                return name
        return None

    for alert, customer, day in alerts:
        window = sorted((d, t, a, n, b) for t, c, d, a, n, b in txns if c == customer and int(day[-2:]) - 6 <= int(d[-2:]) <= int(day[-2:]))
        want = (False, None, None)
        for rule in rules:
            for _, _, a, n, b in window:
                k = kind(n)
                if k not in rule.events:
                    continue
                if k == "education" and not (b and b.lower() in "university of oxford" and a <= 50000):
                    continue
                reason = f"Verified education transaction to {b}" if k == "education" else f"Legitimate {k} transaction"
                want = (True, reason, rule.rule_id)
                break
            if want[0]:
                break
        assert got[alert] == want
        assert seen[alert] == (len(window), sum(w[2] for w in window))
    assert marks.select(micros("alert_date")).count() == len(alerts)
