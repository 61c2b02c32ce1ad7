"""Alert rows: condition, reason, details, identity and duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnwatch.functions.expressions import FormulaError, formula
from txnwatch.functions.text import money
from txnwatch.operators.enrich import first_per_key
from txnwatch.operators.filters import all_of, complete, predicate
from txnwatch.rules import Rule


def alert_id(run_id: str, scenario_id: str, owner: Sequence[str], end: str, value: str) -> Column:
    """A stable id: the same run, rule, owner, window and value always give the same alert."""
    return F.sha2(
        F.concat_ws(
            "/",
            F.lit(run_id),
            F.lit(scenario_id),
            *[F.coalesce(F.col(name).cast("string"), F.lit("")) for name in owner],
            F.coalesce(F.unix_micros(F.col(end).try_cast("timestamp")).cast("string"), F.lit("")),
            F.coalesce(F.col(value).try_cast("decimal(24,6)").cast("string"), F.col(value).cast("string"), F.lit("")),
        ),
        256,
    )


def condition(columns: Sequence[str], schema: T.StructType, rule: Rule) -> Column:
    """Strictly above the threshold when there is no expression; else rows where it holds.

    Without threshold and expression nothing alerts. An expression that cannot be read, or names a
    column that is not among ``columns``, holds for no row. Additional conditions narrow the result further.
    """
    if rule.expression is None:
        test = F.col("aggregated_value") > F.col("threshold") if "threshold" in columns else F.lit(False)
    else:
        numeric = {"txn_count": F.col("transaction_count")} if "transaction_count" in columns else {}
        try:
            test = formula(rule.expression, {**{name: F.col(name) for name in columns}, **numeric})
        except FormulaError:
            test = F.lit(False)
    extra = [
        predicate(F.col(item["field"]), schema[item["field"]].dataType, item["operator"], item["value"])
        for item in rule.conditions
        if complete(item) and item["field"] in columns
    ]
    return F.coalesce(test.cast("boolean"), F.lit(False)) & all_of(extra)


def alert_condition(rows: DataFrame, rule: Rule) -> DataFrame:
    """The rows on which a rule alerts."""
    return rows.filter(condition(rows.columns, rows.schema, rule))


def attribute(columns: Sequence[str], names: Sequence[str], default: Column) -> Column:
    """The first filled column among ``names``, as text."""
    present = [F.col(name).cast("string") for name in names if name in columns]
    return F.coalesce(*present, default)


def trigger_reason(rule: Rule, columns: Sequence[str], window_days: int) -> Column:
    """The sentence shown with a peak alert."""
    threshold = rule.threshold
    name = attribute(columns, ("customer_name", "name"), F.col("customer_id"))
    occupation = attribute(columns, ("occupation",), F.lit("Unknown"))
    income = attribute(columns, ("annual_income",), F.lit("0"))
    value, bound, count = money("aggregated_value"), money("threshold"), F.col("transaction_count").cast("string")
    field = rule.resolve(rule.value_field)
    parts = [
        F.lit("Customer "), name, F.lit(" ("), occupation, F.lit(", Income: "), income,
        F.lit(f") triggered '{rule.scenario_name}'. {rule.function.upper()}({field}): "), value,
        F.lit(" across "), count, F.lit(f" transactions in {window_days}-day window. "),
    ]
    if threshold.kind == "dynamic":
        formula_text, reference = threshold.formula or "?", threshold.reference_field or "?"
        parts += [F.lit("Dynamic threshold of "), bound, F.lit(f" used (formula: {formula_text}, based on {reference}). ")]
    elif threshold.kind == "segment":
        segment = attribute(columns, (threshold.segment_field,), F.lit("Unknown"))
        parts += [
            F.lit("Segment-based threshold of "), bound,
            F.lit(f" used (segment: {threshold.segment_field}="), segment, F.lit("). "),
        ]
    else:
        parts += [F.lit("Fixed threshold of "), bound, F.lit(" used. ")]
    return F.concat(*parts)


def peak_details(rule: Rule, window_days: int) -> Column:
    """What triggered a peak alert."""
    return F.struct(
        F.col("aggregated_value"),
        F.lit(rule.function.upper()).alias("aggregation_function"),
        F.lit(rule.resolve(rule.value_field)).alias("aggregation_field"),
        F.lit(window_days).alias("rolling_window_days"),
        F.col("threshold").alias("threshold_used"),
        F.lit(rule.threshold.kind).alias("threshold_type"),
        F.col("transaction_count"),
    )


def metadata_block(metadata: Mapping[str, object]) -> Column:
    """Metadata of the rule with its defaults."""
    tags = [F.lit(str(tag)) for tag in metadata.get("regulatory_tags") or ()]
    return F.struct(
        F.lit(metadata.get("severity", "MEDIUM")).alias("severity"),
        F.lit(metadata.get("category", "")).alias("category"),
        F.lit(metadata.get("sub_category", "")).alias("sub_category"),
        (F.array(*tags) if tags else F.array().cast("array<string>")).alias("regulatory_tags"),
        F.lit(int(metadata.get("investigation_priority", 3))).alias("investigation_priority"),
        F.lit(bool(metadata.get("auto_escalate", False))).alias("auto_escalate"),
    )


def velocity(columns: Sequence[str]) -> Column:
    """Pace of the customer's filtered transactions; null with fewer than two."""
    count = F.col("customer_transactions")
    # Whole days between first and last transaction; a span below one day counts as one.
    span = (F.unix_micros("last_date") - F.unix_micros("first_date")) / F.lit(86_400_000_000.0)
    days = F.greatest(F.floor(span), F.lit(1)).cast("long")
    return F.when(
        count > 1,
        F.struct(
            F.round(count / days.cast("double"), 2).alias("transactions_per_day"),
            F.round(F.col("aggregated_value") / count, 2).alias("avg_amount_per_transaction"),
            days.alias("date_range_days"),
        ),
    )


def enrichment_block(flags: Mapping[str, bool], columns: Sequence[str]) -> Column:
    """The optional context of a peak alert, each part null unless switched on."""
    text = lambda *names: attribute(columns, names, F.lit("Unknown"))
    profile = F.struct(
        text("customer_name", "name").alias("name"),
        text("occupation").alias("occupation"),
        attribute(columns, ("annual_income",), F.lit("0")).alias("annual_income"),
        text("account_type").alias("account_type"),
        text("customer_type").alias("customer_type"),
        attribute(columns, ("risk_score",), F.lit("0")).alias("risk_score"),
    )
    place = F.struct(text("country").alias("country"), text("region").alias("region"))
    chosen = [
        ("customer_profile", "include_customer_profile", profile),
        ("velocity_metrics", "calculate_velocity_metrics", velocity(columns)),
        ("geographic_risk", "include_geographic_risk", place),
    ]
    return F.struct(*[F.when(F.lit(bool(flags.get(flag))), block).alias(name) for name, flag, block in chosen])


def details_map(columns: Sequence[str]) -> Column:
    """Every output column of a grouped alert as text."""
    pairs = [item for name in columns for item in (F.lit(name), F.col(name).cast("string"))]
    return F.create_map(*pairs)


def dedup_alerts(alerts: DataFrame) -> DataFrame:
    """One alert per customer, day and scenario, the earliest."""
    return first_per_key(
        alerts.withColumn("_day", F.to_date("alert_date")),
        ["customer_id", "_day", "scenario_id"],
        [F.col("alert_date"), F.col("window_end"), F.col("alert_id")],
    ).drop("_day")


def union_alerts(parts: Sequence[DataFrame]) -> DataFrame:
    """Alerts of several rules in one table."""
    return reduce(lambda left, right: left.unionByName(right), parts)
