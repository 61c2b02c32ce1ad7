"""Registered queries: each runs an operator on the given tables; most have a SQL twin.

``Tables`` maps the given tables to what the engine works on: orders and events are transactions,
customers are customers, suppliers are the whitelist. ``VIEWS`` says the same in SQL, so that a query and
its twin start from the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.operators.skew import delete_at_end
from txnwatch.session import checkpoint_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of ``Tables`` under ``name``; ``sql`` may use the views by name."""

    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            SQL[name] = with_views(sql)
        return fn

    return wrap


VIEWS = {
    "txn": """
        select cast(o_orderkey as varchar) as transaction_id, cast(o_custkey as varchar) as customer_id,
               o_orderdate as transaction_date, o_totalprice as transaction_amount, o_orderpriority as channel,
               case o_orderstatus when 'F' then 'D' else 'C' end as debit_credit_indicator,
               o_orderstatus as transaction_type, 'UP' || cast(year(o_orderdate) as varchar) as upload_id
        from orders""",
    "cust": """
        select cast(c_custkey as varchar) as customer_id, c_name as customer_name, c_mktsegment as occupation,
               c_acctbal as annual_income,
               case when c_custkey % 3 = 0 then 'Business' else 'Savings' end as account_type,
               c_custkey % 20 as risk_score, n_name as country, r_name as region, 'Retail' as customer_type,
               'UP' || cast(1995 + c_custkey % 7 as varchar) as upload_id
        from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "evt": """
        select cast(event_id as varchar) as transaction_id, cast(user_id as varchar) as customer_id,
               ts as transaction_date, value as transaction_amount, event_type as transaction_type,
               case event_type when 'purchase' then 'University tuition fee' when 'signup' then 'Loan EMI payment'
                               when 'click' then 'Fixed Deposit renewal' when 'error' then null
                               else 'Transfer to friend' end as transaction_narrative,
               case when user_id % 7 = 0 then 'supplier#00000' else s_name end as beneficiary_name
        from events left join supplier on s_suppkey = event_id % 10""",
    "entities": """
        select 'The ' || s_name || ' Trust' as entity_name,
               case s_suppkey % 3 when 0 then 'University' when 1 then 'FinancialInstitution'
                                  else 'CryptoExchange' end as entity_type,
               s_acctbal > 0 as is_active, case when s_suppkey % 2 = 1 then 'u1' end as user_id
        from supplier""",
    "line": """
        select cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) || '-' || cast(l_partkey as varchar)
                   || '-' || cast(l_suppkey as varchar) as transaction_id,
               'A' || cast(l_orderkey as varchar) as alert_id, l_extendedprice as transaction_amount,
               l_shipdate as transaction_date, s_name as beneficiary_name, p_name as transaction_narrative,
               'UP' || cast(year(l_shipdate) as varchar) as upload_id
        from lineitem left join supplier on s_suppkey = l_suppkey left join part on p_partkey = l_partkey""",
    "alert": """
        select 'A' || cast(o_orderkey as varchar) as alert_id, 'RUN' || cast(year(o_orderdate) as varchar) as run_id,
               cast(o_custkey as varchar) as customer_id, 'S' || substr(o_orderpriority, 1, 1) as scenario_id,
               'Scenario ' || o_orderpriority as scenario_name, o_orderdate as alert_date,
               o_totalprice as aggregated_value, cast(floor(o_totalprice / 5000) as integer) as risk_score,
               case when o_totalprice >= 350000 then 'HIGH' when o_totalprice >= 200000 then 'MEDIUM' else 'LOW' end
                   as risk_classification,
               case when o_orderstatus = 'P' then 'CLS' else 'OPN' end as alert_status,
               case o_orderpriority when '1-URGENT' then 'University payment' when '2-HIGH' then 'Tuition due'
                                    else 'Cash movement' end as trigger_reason,
               o_orderstatus = 'F' as excluded,
               case when o_orderstatus = 'F' then 'Verified education transaction' end as exclusion_reason,
               o_orderstatus = 'O' as is_anonymized, c_name as customer_name
        from orders left join customer on c_custkey = o_custkey""",
    "old": "select * from alert where aggregated_value >= 150000",
    "new": "select * from alert where aggregated_value >= 250000 and alert_status = 'OPN'",
    "run": """
        select run_id, 'UP' || substr(run_id, 4) as upload_id, max(alert_date) as created_at,
               count(*) as total_alerts, case when max(alert_date) < timestamp '2000-12-31' then 'completed'
                                              else 'running' end as status,
               list_sort(list(distinct scenario_id)) as scenarios_run
        from alert group by run_id""",
    "scenario": """
        select scenario_id, min(scenario_name) as scenario_name, scenario_id <> 'S4' as enabled
        from alert where scenario_id <> 'S5' group by scenario_id""",
    "upload": """
        select upload_id, 'Data ' || substr(upload_id, 3) as dataset_name,
               case when cast(substr(upload_id, 3) as integer) % 2 = 0 then 'u0' else 'u1' end as user_id,
               max(transaction_date) as upload_timestamp, max(transaction_date) + interval 48 hour as expires_at,
               case when upload_id = 'UP1996' then 'expired' else 'active' end as status,
               count(*) as record_count_transactions
        from txn group by upload_id""",
    "profile": """
        select cast(c_custkey as varchar) as customer_id, c_custkey % 5 = 0 as is_pep,
               c_custkey % 7 = 0 as has_adverse_media, c_mktsegment = 'BUILDING' as high_risk_occupation,
               c_custkey % 3 as previous_sar_count
        from customer""",
}
NEEDS = {"old": ["alert"], "new": ["alert"], "run": ["alert"], "scenario": ["alert"], "upload": ["txn"]}


def with_views(sql: str) -> str:
    """The statement with the views it names in front."""
    import re

    wanted: list[str] = []

    def add(name: str) -> None:
        for base in NEEDS.get(name, ()):
            add(base)
        if name not in wanted:
            wanted.append(name)

    for name in VIEWS:
        if re.search(rf"\b(?:from|join)\s+{name}\b", sql):
            add(name)
    parts = [f"{name} as ({VIEWS[name].strip()})" for name in wanted]
    body = sql.strip()
    if not parts:
        return body
    if body.lower().startswith("with recursive "):
        raise ValueError("recursive statements take no views")
    if body.lower().startswith("with "):
        return "with " + ", ".join(parts) + ", " + body[5:]
    return "with " + ", ".join(parts) + " " + body


def half_up(value: str, digits: int) -> str:
    """SQL for Spark's rounding of a double: half up on its shortest decimal text."""
    return f"cast(round(cast(cast({value} as varchar) as decimal(38,12)), {digits}) as double)"


def text(name: str) -> F.Column:
    return F.col(name).cast("string")


class Tables:
    """The given tables as engine tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def scratch(self, name: str) -> str:
        """A fresh folder every executor can reach, deleted when the application ends."""
        path = f"{checkpoint_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        delete_at_end(self.spark, path)
        return path

    @cached_property
    def txn(self) -> DataFrame:
        return self.read("orders").select(
            text("o_orderkey").alias("transaction_id"),
            text("o_custkey").alias("customer_id"),
            F.col("o_orderdate").cast("timestamp").alias("transaction_date"),
            F.col("o_totalprice").alias("transaction_amount"),
            F.col("o_orderpriority").alias("channel"),
            F.when(F.col("o_orderstatus") == "F", "D").otherwise("C").alias("debit_credit_indicator"),
            F.col("o_orderstatus").alias("transaction_type"),
            F.concat(F.lit("UP"), F.year("o_orderdate").cast("string")).alias("upload_id"),
        )

    @cached_property
    def cust(self) -> DataFrame:
        nations = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return (
            self.read("customer")
            .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                text("c_custkey").alias("customer_id"),
                F.col("c_name").alias("customer_name"),
                F.col("c_mktsegment").alias("occupation"),
                F.col("c_acctbal").alias("annual_income"),
                F.when(F.col("c_custkey") % 3 == 0, "Business").otherwise("Savings").alias("account_type"),
                (F.col("c_custkey") % 20).alias("risk_score"),
                F.col("n_name").alias("country"),
                F.col("r_name").alias("region"),
                F.lit("Retail").alias("customer_type"),
                F.concat(F.lit("UP"), (F.lit(1995) + F.col("c_custkey") % 7).cast("string")).alias("upload_id"),
            )
        )

    @cached_property
    def evt(self) -> DataFrame:
        kind = F.col("event_type")
        narrative = (
            F.when(kind == "purchase", "University tuition fee")
            .when(kind == "signup", "Loan EMI payment")
            .when(kind == "click", "Fixed Deposit renewal")
            .when(kind == "error", F.lit(None).cast("string"))
            .otherwise("Transfer to friend")
        )
        suppliers = self.read("supplier").select("s_suppkey", "s_name")
        return (
            self.read("events")
            .join(suppliers, F.col("s_suppkey") == F.col("event_id") % 10, "left")
            .select(
                text("event_id").alias("transaction_id"),
                text("user_id").alias("customer_id"),
                F.col("ts").cast("timestamp").alias("transaction_date"),
                F.col("value").alias("transaction_amount"),
                kind.alias("transaction_type"),
                narrative.alias("transaction_narrative"),
                F.when(F.col("user_id") % 7 == 0, "supplier#00000").otherwise(F.col("s_name")).alias("beneficiary_name"),
            )
        )

    @cached_property
    def entities(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.read("supplier").select(
            F.concat(F.lit("The "), F.col("s_name"), F.lit(" Trust")).alias("entity_name"),
            F.when(key % 3 == 0, "University").when(key % 3 == 1, "FinancialInstitution").otherwise("CryptoExchange").alias("entity_type"),
            (F.col("s_acctbal") > 0).alias("is_active"),
            F.when(key % 2 == 1, "u1").alias("user_id"),
        )

    @cached_property
    def line(self) -> DataFrame:
        suppliers = self.read("supplier").select("s_suppkey", "s_name")
        parts = self.read("part").select("p_partkey", "p_name")
        return (
            self.read("lineitem")
            .join(suppliers, F.col("s_suppkey") == F.col("l_suppkey"), "left")
            .join(parts, F.col("p_partkey") == F.col("l_partkey"), "left")
            .select(
                F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("transaction_id"),
                F.concat(F.lit("A"), text("l_orderkey")).alias("alert_id"),
                F.col("l_extendedprice").alias("transaction_amount"),
                F.col("l_shipdate").cast("timestamp").alias("transaction_date"),
                F.col("s_name").alias("beneficiary_name"),
                F.col("p_name").alias("transaction_narrative"),
                F.concat(F.lit("UP"), F.year("l_shipdate").cast("string")).alias("upload_id"),
            )
        )

    @cached_property
    def alert(self) -> DataFrame:
        price, status, priority = F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderpriority")
        names = self.read("customer").select("c_custkey", "c_name")
        return (
            self.read("orders")
            .join(names, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select(
                F.concat(F.lit("A"), text("o_orderkey")).alias("alert_id"),
                F.concat(F.lit("RUN"), F.year("o_orderdate").cast("string")).alias("run_id"),
                text("o_custkey").alias("customer_id"),
                F.concat(F.lit("S"), F.substring(priority, 1, 1)).alias("scenario_id"),
                F.concat(F.lit("Scenario "), priority).alias("scenario_name"),
                F.col("o_orderdate").cast("timestamp").alias("alert_date"),
                price.alias("aggregated_value"),
                F.floor(price / 5000).cast("int").alias("risk_score"),
                F.when(price >= 350000, "HIGH").when(price >= 200000, "MEDIUM").otherwise("LOW").alias("risk_classification"),
                F.when(status == "P", "CLS").otherwise("OPN").alias("alert_status"),
                F.when(priority == "1-URGENT", "University payment").when(priority == "2-HIGH", "Tuition due")
                .otherwise("Cash movement").alias("trigger_reason"),
                (status == "F").alias("excluded"),
                F.when(status == "F", "Verified education transaction").alias("exclusion_reason"),
                (status == "O").alias("is_anonymized"),
                F.col("c_name").alias("customer_name"),
            )
        )

    @cached_property
    def old(self) -> DataFrame:
        return self.alert.filter(F.col("aggregated_value") >= 150000)

    @cached_property
    def new(self) -> DataFrame:
        return self.alert.filter((F.col("aggregated_value") >= 250000) & (F.col("alert_status") == "OPN"))

    @cached_property
    def run(self) -> DataFrame:
        last = F.max("alert_date")
        return self.alert.groupBy("run_id").agg(
            last.alias("created_at"),
            F.count(F.lit(1)).alias("total_alerts"),
            F.when(last < F.lit("2000-12-31").cast("timestamp"), "completed").otherwise("running").alias("status"),
            F.array_sort(F.collect_set("scenario_id")).alias("scenarios_run"),
        ).withColumn("upload_id", F.concat(F.lit("UP"), F.substring("run_id", 4, 4)))

    @cached_property
    def scenario(self) -> DataFrame:
        return (
            self.alert.filter(F.col("scenario_id") != "S5")
            .groupBy("scenario_id")
            .agg(F.min("scenario_name").alias("scenario_name"))
            .withColumn("enabled", F.col("scenario_id") != "S4")
        )

    @cached_property
    def upload(self) -> DataFrame:
        year = F.substring("upload_id", 3, 4)
        return self.txn.groupBy("upload_id").agg(
            F.max("transaction_date").alias("upload_timestamp"), F.count(F.lit(1)).alias("record_count_transactions")
        ).select(
            "*",
            F.concat(F.lit("Data "), year).alias("dataset_name"),
            F.when(year.cast("int") % 2 == 0, "u0").otherwise("u1").alias("user_id"),
            (F.col("upload_timestamp") + F.expr("INTERVAL 48 HOURS")).alias("expires_at"),
            F.when(F.col("upload_id") == "UP1996", "expired").otherwise("active").alias("status"),
        )

    @cached_property
    def profile(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.read("customer").select(
            text("c_custkey").alias("customer_id"),
            (key % 5 == 0).alias("is_pep"),
            (key % 7 == 0).alias("has_adverse_media"),
            (F.col("c_mktsegment") == "BUILDING").alias("high_risk_occupation"),
            (key % 3).alias("previous_sar_count"),
        )
