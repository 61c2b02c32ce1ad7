"""Customer, profile and scenario attributes joined onto rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnwatch.operators.skew import UNKNOWN, Hot, hot_groups, skew_join


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence = ()) -> DataFrame:
    """Keep one row per key, the first along ``order`` (all other columns when none is given).

    Spark limits each task to one row per key before the shuffle, so repeated keys stay cheap. Select
    the columns you need first: ordering by all columns reads all of them.
    """
    rest = [f.name for f in df.schema.fields if f.name not in keys and not isinstance(f.dataType, T.MapType)]
    chosen = list(order) or [F.col(c) for c in rest] or [F.lit(1)]
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*chosen))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def enrich_with_customers(
    transactions: DataFrame,
    customers: DataFrame,
    fields: Sequence[str],
    order: Sequence = (),
    how: str = "left",
    hot: Hot = UNKNOWN,
) -> DataFrame:
    """Transactions with the named customer columns.

    Customers are reduced to one row each; a column the transactions already have gets ``_cust``.
    """
    source = customers if order else customers.select("customer_id", *fields)
    single = first_per_key(source, ["customer_id"], order).select(
        "customer_id",
        *[F.col(name).alias(f"{name}_cust" if name in transactions.columns else name) for name in fields],
    )
    return skew_join(transactions, single, ["customer_id"], how, salt_on=["transaction_id"], hot=hot)


def add_customer_fields(
    results: DataFrame,
    customers: DataFrame,
    fields: Sequence[str],
    order: Sequence = (),
    hot: Hot = UNKNOWN,
) -> DataFrame:
    """Customer attributes on aggregates or alerts that lack them.

    ``hot`` may hand over the customers with many rows; None says there are none.
    """
    wanted = [name for name in fields if name not in results.columns and name in customers.columns]
    if not wanted:
        return results
    source = customers if order else customers.select("customer_id", *wanted)
    single = first_per_key(source, ["customer_id"], order).select("customer_id", *wanted)
    return skew_join(results, single, ["customer_id"], "left", salt_on=results.columns, hot=hot)


def scenario_names(runs: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Names of the scenarios of each run in list order; the id where the scenario is unknown.

    A run lists a handful of scenarios, so gathering them again per run is bounded by that list.
    """
    listed = runs.select("run_id", F.posexplode("scenarios_run").alias("_place", "scenario_id"))
    named = skew_join(listed, scenarios.select("scenario_id", "scenario_name"), ["scenario_id"], "left", salt_on=["run_id"])
    gathered = named.groupBy("run_id").agg(
        F.array_sort(
            F.collect_list(F.struct("_place", F.coalesce("scenario_name", "scenario_id").alias("name")))
        ).alias("_list")
    )
    return runs.join(gathered, "run_id", "left").select(
        *runs.columns, F.coalesce(F.col("_list.name"), F.array().cast("array<string>")).alias("scenario_names")
    )


def linked_transactions(alerts: DataFrame, links: DataFrame, transactions: DataFrame) -> DataFrame:
    """C14: alerts with the transactions linked to them.

    One transaction is linked by few alerts (rules times overlapping windows); one alert may link very
    many, so alerts are counted on the links and salted.
    """
    hot = hot_groups(links, ["alert_id"])
    with_rows = links.join(transactions, "transaction_id", "inner")
    return skew_join(with_rows, alerts, ["alert_id"], "inner", salt_on=["transaction_id"], hot=hot)
