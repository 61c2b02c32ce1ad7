"""Data quality of transactions and customers."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.functions.rows import one_row
from txnwatch.functions.text import to_number
from txnwatch.operators.profile import parsed_date

LARGE_AMOUNT = 10_000_000
ERROR_POINTS, WARNING_POINTS = 15, 5


def _duplicates(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first per id; rows without id count as one id, as they look the same.

    Ids are counted per id first, which combines before the shuffle and leaves no id in one task.
    """
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("count"))


def _counts(df: DataFrame, checks: Sequence[tuple[str, str, Column, str]], key: str) -> DataFrame:
    """One row per check: severity, field, count, message."""
    aggregates = [F.count_if(test).alias(f"_{i}") for i, (_, _, test, _) in enumerate(checks)]
    counted = df.agg(*aggregates)
    rows = counted.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(severity).alias("severity"),
                        F.lit(field).alias("field"),
                        F.concat(F.col(f"_{i}").cast("string"), F.lit(f" {text}")).alias("message"),
                        F.col(f"_{i}").alias("count"),
                    )
                    for i, (severity, field, _, text) in enumerate(checks)
                ]
            )
        ).alias("c")
    ).select("c.*")
    what = "transaction IDs" if key == "transaction_id" else "customer IDs"
    repeated = _duplicates(df, key).select(
        F.lit("error").alias("severity"),
        F.lit(key).alias("field"),
        F.concat(F.col("count").cast("string"), F.lit(f" duplicate {what} found")).alias("message"),
        "count",
    )
    return rows.unionByName(repeated)


def transaction_issues(df: DataFrame, now: Any) -> DataFrame:
    """H8: the findings on transactions, those with a count only. Cells that cannot be read are counted, never an end."""
    raw, date = F.col("transaction_amount"), F.col("transaction_date")
    amount, at = raw.try_cast("double"), date.try_cast("timestamp")
    checks = [
        ("error", "transaction_amount", amount < 0, "transactions have negative amounts"),
        ("warning", "transaction_date", at > F.lit(now).cast("timestamp"), "transactions are future-dated"),
        ("error", "customer_id", F.col("customer_id").isNull(), "transactions missing customer_id"),
        ("error", "transaction_amount", raw.isNull(), "transactions missing amount"),
        ("error", "transaction_amount", raw.isNotNull() & amount.isNull(), "transactions with unreadable amount"),
        ("error", "transaction_date", date.isNotNull() & at.isNull(), "transactions with unreadable date"),
        ("warning", "transaction_amount", amount > LARGE_AMOUNT, "transactions exceed 10M (potential data entry errors)"),
        ("warning", "transaction_amount", amount == 0, "transactions have zero amount"),
    ]
    return _counts(df, checks, "transaction_id").filter(F.col("count") > 0)


def customer_issues(df: DataFrame) -> DataFrame:
    """H9: the findings on customers, those with a count only."""
    checks = [("error", "customer_id", F.col("customer_id").isNull(), "customers missing customer_id")]
    if "customer_name" in df.columns:
        checks.append(("warning", "customer_name", F.col("customer_name").isNull(), "customers missing name"))
    return _counts(df, checks, "customer_id").filter(F.col("count") > 0)


def quality_report(df: DataFrame, issues: DataFrame) -> DataFrame:
    """H8, H9: validity, score, row count and clean rows in one row; issue counts may overlap."""
    found = issues.agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("_affected"),
    )
    both = one_row([found, df.agg(F.count(F.lit(1)).alias("total_rows"))])
    score = F.greatest(F.lit(0), 100 - F.col("errors") * ERROR_POINTS - F.col("warnings") * WARNING_POINTS)
    return both.select(
        (F.col("errors") == 0).alias("valid"),
        score.alias("quality_score"),
        "total_rows",
        "errors",
        "warnings",
        (F.col("total_rows") - F.col("_affected")).alias("clean_rows"),
    )


def upload_scores(
    df: DataFrame, required: Sequence[str], key: str, numbers: Sequence[str] = (), dates: Sequence[str] = ()
) -> DataFrame:
    """Percent of required cells filled, of filled typed cells readable, and of ids unique."""
    text = {name: F.col(name).cast("string") for name in {*required, *numbers, *dates}}
    filled = {name: F.coalesce(F.trim(value) != "", F.lit(False)) for name, value in text.items()}

    def total(tests: Sequence[Column]) -> Column:
        summed = F.lit(0).cast("long")
        for test in tests:
            summed = summed + F.count_if(test)
        return summed

    typed = [(name, to_number(F.trim(text[name])).isNotNull()) for name in numbers]
    typed += [
        (name, F.coalesce(parsed_date(text[name]), text[name].try_cast("timestamp")).isNotNull()) for name in dates
    ]
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        total([filled[name] for name in required]).alias("_filled"),
        total([filled[name] for name, _ in typed]).alias("_typed"),
        total([filled[name] & test for name, test in typed]).alias("_valid"),
    )
    ids = df.groupBy(key).agg(F.lit(1).alias("_one")).filter(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("_ids"))
    both = one_row([counted, ids])

    def percent(part: Column, whole: Column) -> Column:
        return F.coalesce(F.round(F.try_divide(part * 100.0, whole), 2), F.lit(100.0))

    return both.select(
        percent(F.col("_filled"), F.col("_rows") * len(required)).alias("completeness_score"),
        percent(F.col("_valid"), F.col("_typed")).alias("validity_score"),
        percent(F.col("_ids"), F.col("_rows")).alias("uniqueness_score"),
    )
