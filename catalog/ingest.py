"""Sources, ingestion and sinks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import Tables, query
from txnwatch.functions.text import display_id
from txnwatch.operators.reports import export_alerts, export_comparison
from txnwatch.operators.compare import diff_peak
from txnwatch.sources import datasets, ingest, payload, sinks, state

NOW = "2001-08-02 00:00:00"


@query(
    "a1_read_delimited",
    """select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey, o_orderpriority,
              strftime(o_orderdate, '%Y-%m-%d') as o_orderdate from orders""",
)
def read_delimited(t: Tables) -> DataFrame:
    folder = t.scratch("delimited")
    source = t.read("orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))
    renamed = source.withColumnRenamed("o_orderkey", "﻿o_orderkey")
    renamed.write.csv(folder, header=True)
    return ingest.read_delimited(t.spark, folder)


@query(
    "a3_normal_header",
    "select c_custkey as customer_id, c_name as customer_name, c_acctbal as annual_income from customer",
)
def normal_header(t: Tables) -> DataFrame:
    messy = t.read("customer").select(
        F.col("c_custkey").alias(" Customer ID "), F.col("c_name").alias("CUSTOMER NAME"), F.col("c_acctbal").alias("Annual Income")
    )
    return ingest.normal_header(messy)


def _aliased(t: Tables) -> DataFrame:
    key = F.col("event_id").cast("string")
    return t.read("events").select(
        F.when(F.col("event_id") % 2 == 0, key).otherwise("").alias("id"),
        F.when(F.col("event_id") % 3 == 0, key).alias("txn_id"),
        F.when(F.col("event_id") % 4 != 1, F.concat(F.lit(" r"), key)).alias("ref"),
        F.col("user_id").cast("string").alias("cust_id"),
        F.lit("c9").alias("client_id"),
        F.col("value").alias("amount"),
    )


@query(
    "a4_aliases_g",
    """select case when event_id % 2 = 0 then cast(event_id as varchar) when event_id % 3 = 0 then cast(event_id as varchar)
                   when event_id % 4 <> 1 then 'r' || cast(event_id as varchar) end as transaction_id,
              cast(user_id as varchar) as customer_id, value as amount from events""",
)
def aliases_grouped(t: Tables) -> DataFrame:
    return ingest.apply_aliases(_aliased(t), "grouped", ingest.TRANSACTIONS)


@query(
    "a4_aliases_p",
    """select case when event_id % 3 = 0 then cast(event_id as varchar) end as transaction_id,
              cast(user_id as varchar) as customer_id, value as amount from events""",
)
def aliases_peak(t: Tables) -> DataFrame:
    return ingest.apply_aliases(_aliased(t).drop("id", "ref"), "peak", ingest.TRANSACTIONS)


@query(
    "a5_finite",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
              case when l_tax > 0 and l_tax < 0.07 then l_extendedprice end as amount from lineitem""",
)
def finite(t: Tables) -> DataFrame:
    amount = F.when(F.col("l_tax") <= 0, float("nan")).when(F.col("l_tax") >= 0.07, float("inf")).otherwise(F.col("l_extendedprice"))
    return ingest.finite(t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", amount.alias("amount")))


@query(
    "a6_cast_cells",
    """select o_orderkey as k, o_totalprice as price, o_orderstatus as status,
              case when o_custkey % 9 = 0 then null else cast(o_custkey as varchar) || case when o_custkey % 10 = 1 then 'x' else '' end end as mixed
       from orders""",
)
def cast_cells(t: Tables) -> DataFrame:
    cells = t.read("orders").select(
        F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("k"),
        F.concat(F.col("o_totalprice").cast("string"), F.lit(" ")).alias("price"),
        F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_custkey") % 9 == 0, "  ").otherwise(
            F.concat(F.col("o_custkey").cast("string"), F.when(F.col("o_custkey") % 10 == 1, "x").otherwise(""))
        ).alias("mixed"),
    )
    return ingest.cast_cells(cells, ingest.column_types(cells, cells.columns))


@query(
    "a7_parse_dates",
    """with d as (select o_orderkey, case o_orderkey % 6 when 0 then strftime(o_orderdate, '%Y-%m-%d')
                    when 1 then strftime(o_orderdate, '%d/%m/%Y') when 2 then strftime(o_orderdate, '%m/%d/%Y')
                    when 3 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') when 4 then strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
                    else 'soon' end as s from orders)
       select o_orderkey, coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%d/%m/%Y'), try_strptime(s, '%m/%d/%Y'),
                                   try_strptime(s, '%Y-%m-%dT%H:%M:%S'), try_strptime(s, '%Y-%m-%d %H:%M:%S')) as s from d""",
)
def parse_dates(t: Tables) -> DataFrame:
    shapes = ["yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss"]
    shown = F.lit("soon")
    for i, shape in enumerate(shapes):
        shown = F.when(F.col("o_orderkey") % 6 == i, F.date_format("o_orderdate", shape)).otherwise(shown)
    return ingest.parse_dates(t.read("orders").select("o_orderkey", shown.alias("s")), "s")


def _gappy(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    return t.read("orders").select(
        key.alias("seq"),
        F.when(key % 11 != 0, key.cast("string")).otherwise(" ").alias("transaction_id"),
        F.when(key % 7 != 0, F.col("o_custkey").cast("string")).otherwise("None").alias("customer_id"),
    )


@query(
    "a8_key_rejects",
    """select o_orderkey + 2 as row, case when o_orderkey % 11 <> 0 then cast(o_orderkey as varchar) else ' ' end as transaction_id,
              case when o_orderkey % 7 <> 0 then cast(o_custkey as varchar) else 'None' end as customer_id,
              'Missing required fields: ' || case when o_orderkey % 77 = 0 then 'transaction_id, customer_id'
                 when o_orderkey % 11 = 0 then 'transaction_id' else 'customer_id' end as error
       from orders where o_orderkey % 11 = 0 or o_orderkey % 7 = 0""",
)
def key_rejects(t: Tables) -> DataFrame:
    return ingest.key_check(_gappy(t), ["transaction_id", "customer_id"], "seq")[1]


@query(
    "a8_generated_ids_p",
    """select count(*) as rows, count(distinct o_orderkey) as ids, count(*) filter (o_orderkey % 11 = 0) as generated
       from orders where o_orderkey % 7 <> 0""",
)
def generated_ids(t: Tables) -> DataFrame:
    good, _ = ingest.key_check(ingest.fill_missing_ids(_gappy(t)), ["transaction_id", "customer_id"])
    return good.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("transaction_id").alias("ids"),
        F.count_if(F.length("transaction_id") == 64).alias("generated"),
    )


@query(
    "a9_tenant_ids",
    """select upload_id, substr(upload_id, 1, 8) || '_' || customer_id as customer_id, customer_id as original_customer_id from txn""",
)
def tenant_ids(t: Tables) -> DataFrame:
    return ingest.tenant_ids(t.txn.select("upload_id", "customer_id"), F.col("upload_id"))


@query(
    "a10_display_id",
    "select 'u1_' || cast(c_custkey as varchar) as id, cast(c_custkey as varchar) as shown, c_name as plain from customer",
)
def display(t: Tables) -> DataFrame:
    ids = t.read("customer").select(F.concat(F.lit("u1_"), F.col("c_custkey").cast("string")).alias("id"), "c_name")
    return ids.select("id", display_id("id").alias("shown"), display_id("c_name").alias("plain"))


@query(
    "a11_last_wins",
    """select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as o_orderkey,
              arg_max(o_totalprice, (o_orderdate, o_orderkey)) as o_totalprice from orders group by o_custkey""",
)
def last_wins(t: Tables) -> DataFrame:
    rows = t.read("orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return datasets.last_wins(rows, ["o_custkey"], F.struct("o_orderdate", "o_orderkey")).drop("o_orderdate")


@query(
    "a11_upsert",
    """select o_orderkey as transaction_id, case when o_orderkey % 4 = 0 then o_totalprice + 1 else o_totalprice end as amount,
              cast(case when o_orderkey % 4 = 0 then 2 else 0 end as bigint) as seq from orders
       union all select o_orderkey + 100000000, o_totalprice, 2 from orders where o_orderkey % 4 = 0""",
)
def upsert(t: Tables) -> DataFrame:
    stored = t.read("orders").select(
        F.col("o_orderkey").alias("transaction_id"), F.col("o_totalprice").alias("amount"), F.lit(0).cast("long").alias("seq")
    )
    some = stored.filter(F.col("transaction_id") % 4 == 0)
    first = some.withColumns({"amount": F.col("amount") - 1, "seq": F.lit(1).cast("long")})
    second = some.withColumns({"amount": F.col("amount") + 1, "seq": F.lit(2).cast("long")})
    fresh = some.withColumns({"transaction_id": F.col("transaction_id") + 100000000, "seq": F.lit(2).cast("long")})
    return datasets.upsert(stored, first.unionByName(second).unionByName(fresh), ["transaction_id"], "seq")


@query(
    "a12_stub_customers",
    """select customer_id, occupation, false as auto_created from cust where occupation <> 'BUILDING'
       union all select distinct customer_id, null, true from txn
       where customer_id not in (select customer_id from cust where occupation <> 'BUILDING')""",
)
def stubs(t: Tables) -> DataFrame:
    known = t.cust.filter(F.col("occupation") != "BUILDING").select("customer_id", "occupation")
    return datasets.with_stubs(t.txn, known)


@query(
    "a13_accounts",
    """select 'UPLOAD-7_' || case when c_custkey % 2 = 0 then 'ACC' || cast(c_custkey as varchar) else cast(c_nationkey as varchar) end as account_id,
              cast(c_custkey as varchar) as customer_id, 'UPLOAD-77' as upload_id, cast(c_nationkey as varchar) as account_number,
              'Savings' as account_type, c_mktsegment as account_status, 'GBP' as currency_code, timestamp '2001-08-02' as account_open_date,
              case when c_custkey % 3 = 0 then 'HIGH' else 'LOW' end as risk_rating, false as is_pep, c_acctbal as current_balance,
              case when c_custkey % 2 = 0 then 'ACC' || cast(c_custkey as varchar) else cast(c_nationkey as varchar) end as original_account_id
       from customer""",
)
def accounts(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    rows = t.read("customer").select(
        key.cast("string").alias("customer_id"),
        F.when(key % 2 == 0, F.concat(F.lit("ACC"), key.cast("string"))).alias("account_id"),
        F.col("c_nationkey").cast("string").alias("account_number"),
        F.col("c_mktsegment").alias("status"),
        F.col("c_acctbal").cast("string").alias("balance"),
        F.when(key % 3 == 0, "HIGH").alias("risk_rating"),
    )
    done = ingest.accounts_of(rows, "UPLOAD-77", NOW)
    return done.withColumn("current_balance", F.col("current_balance").cast("double"))


@query(
    "a14_flatten_payload",
    """select cast(event_id as varchar) as transaction_id, cast(user_id as varchar) as customer_id, event_type,
              case when event_id % 5 = 0 then null else value end as transaction_amount, date_trunc('second', ts) as transaction_date,
              json_extract_string(props, '$.k') as k
       from events""",
)
def flatten(t: Tables) -> DataFrame:
    amount = F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    payload = F.to_json(
        F.struct(
            "event_type",
            amount.alias("transaction_amount"),
            F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("transaction_date"),
            F.get_json_object("props", "$.k").alias("k"),
        )
    )
    rows = t.read("events").select(
        F.col("event_id").cast("string").alias("transaction_id"), F.col("user_id").cast("string").alias("customer_id"), payload.alias("raw_data")
    )
    return ingest.flatten_payload(rows, ["event_type", "transaction_amount", "transaction_date", "k"])


@query(
    "a15_of_user",
    """select transaction_id, upload_id from txn where upload_id in (select upload_id from upload where user_id = 'u1')""",
)
def of_user(t: Tables) -> DataFrame:
    return datasets.of_user(t.txn, t.upload, "u1").select("transaction_id", "upload_id")


@query(
    "a16_latest_upload",
    """select * from (
         select 'active' as choice, upload_id from upload where status = 'active' and expires_at > timestamp '1997-06-01' and user_id = 'u0'
           order by upload_timestamp desc, upload_id desc limit 1)
       union all select * from (select 'any', upload_id from upload order by upload_timestamp desc, upload_id desc limit 1)
       union all select * from (select 'filled', upload_id from upload where record_count_transactions > 0 and user_id = 'u0'
           order by upload_timestamp desc, upload_id desc limit 1)""",
)
def latest(t: Tables) -> DataFrame:
    choices = {
        "active": datasets.latest_upload(t.upload, "1997-06-01", active_only=True, user_id="u0"),
        "any": datasets.latest_upload(t.upload),
        "filled": datasets.latest_upload(t.upload, with_transactions=True, user_id="u0"),
    }
    rows = [df.select(F.lit(name).alias("choice"), "upload_id") for name, df in choices.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(
    "a17_without_upload",
    """select 'transactions' as name, count(*) as rows from txn where upload_id <> 'UP1997'
       union all select 'customers', count(*) from cust
       union all select 'runs', count(*) from run where upload_id <> 'UP1997'
       union all select 'alerts', count(*) from alert where run_id not in (select run_id from run where upload_id = 'UP1997')
       union all select 'alert_transactions', count(*) from line where alert_id not in
           (select alert_id from alert where run_id in (select run_id from run where upload_id = 'UP1997'))""",
)
def without_upload(t: Tables) -> DataFrame:
    tables = {
        "transactions": t.txn, "customers": t.cust, "runs": t.run, "alerts": t.alert,
        "alert_transactions": t.line.select("alert_id", "transaction_id"),
    }
    left = datasets.without_upload(tables, "UP1997", keep=["customers"])
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in left.items()]
    both = counts[0]
    for part in counts[1:]:
        both = both.unionByName(part)
    return both


@query(
    "a17_replace_upload",
    """select transaction_id, transaction_amount, upload_id from txn where upload_id <> 'UP1998'
       union all select 'new' || transaction_id, transaction_amount * 2, 'UP1998' from txn where upload_id = 'UP1999'""",
)
def replace_upload(t: Tables) -> DataFrame:
    stored = t.txn.select("transaction_id", "transaction_amount", "upload_id")
    fresh = stored.filter(F.col("upload_id") == "UP1999").select(
        F.concat(F.lit("new"), "transaction_id").alias("transaction_id"), (F.col("transaction_amount") * 2).alias("transaction_amount")
    )
    return datasets.replace_upload(stored, fresh, "UP1998")


def nested_payloads(t: Tables) -> DataFrame:
    """Events as JSON text with nested, mixed, missing and unreadable parts."""
    number, user = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    text = F.concat(
        F.lit('{"kind":"'), "event_type", F.lit('","amount":'), F.col("value").cast("string"), F.lit(',"props":'), "props",
        F.lit(',"list":['), (F.col("event_id") % 3).cast("string"), F.lit(","), (F.col("event_id") % 5).cast("string"), F.lit('],"mixed":'),
        F.when(F.col("event_id") % 2 == 0, user).otherwise(F.concat(F.lit('"u'), user, F.lit('"'))),
        F.when(F.col("event_id") % 7 == 0, F.lit(',"late":null')).when(F.col("event_id") % 7 == 1, F.lit(',"late":true')).otherwise(F.lit("")),
    )
    whole = F.when(F.col("event_id") % 11 == 0, text).otherwise(F.concat(text, F.lit("}")))
    return t.read("events").select(number.alias("transaction_id"), whole.alias("raw_data"))


@query(
    "a14_any_payload",
    """select cast(event_id as varchar) as transaction_id, case when ok then event_type end as kind, case when ok then value end as amount,
              case when ok then cast(json_extract_string(props, '$.k') as bigint) end as k, case when ok then event_id % 3 + event_id % 5 end as total,
              case when ok then case when event_id % 2 = 0 then cast(user_id as varchar) else 'u' || cast(user_id as varchar) end end as mixed,
              case when ok and event_id % 7 = 1 then true end as late
       from (select *, event_id % 11 <> 0 as ok from events)""",
)
def any_payload(t: Tables) -> DataFrame:
    rows = payload.flatten_any(nested_payloads(t))
    total = F.aggregate("list", F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select("transaction_id", "kind", F.col("amount").cast("double").alias("amount"), F.col("props.k").alias("k"), total.alias("total"), "mixed", "late")


@query(
    "h1_payload_profile",
    """with e as (select * from events where event_id % 11 <> 0)
       select 'kind' as field_name, 'STRING' as kind, count(*) as payloads, 0 as nulls from e
       union all select 'amount', 'DECIMAL', count(*), 0 from e union all select 'props', 'OBJECT<k: BIGINT>', count(*), 0 from e
       union all select 'list', 'ARRAY<BIGINT>', count(*), 0 from e union all select 'mixed', 'MIXED', count(*), 0 from e
       union all select 'late', 'BOOLEAN', count(*), count_if(event_id % 7 = 0) from e where event_id % 7 < 2""",
)
def payload_profile(t: Tables) -> DataFrame:
    found = payload.payload_profile(nested_payloads(t))
    return found.withColumn("kind", F.regexp_replace("kind", r"^DECIMAL\(.*", "DECIMAL"))


@query(
    "a14_payload_quality",
    "select 0 as missing, count_if(event_id % 11 <> 0) as readable, count_if(event_id % 11 = 0) as unreadable from events",
)
def payload_quality(t: Tables) -> DataFrame:
    return payload.payload_quality(nested_payloads(t))


@query("a1_quoted_line_breaks", "select cast(doc_id as varchar) as doc_id, text, lang, source from documents")
def quoted_line_breaks(t: Tables) -> DataFrame:
    """Texts with line breaks, written as CSV and read in several tasks per file."""
    folder = t.scratch("csv")
    sinks.write_csv(t.read("documents").select("doc_id", "text", "lang", "source"), folder)
    return ingest.read_delimited(t.spark, folder, multi_line=True)


ALERT_COLUMNS = ["alert_id", "run_id", "customer_id", "risk_score", "excluded"]


@query("a18_write_run", "select alert_id, run_id, customer_id, risk_score, excluded from alert where run_id <> 'RUN1996'")
def write_run(t: Tables) -> DataFrame:
    """Three writes: all runs, one of them again, and one again without any alerts."""
    folder = t.scratch("run")
    alerts = t.alert.select(*ALERT_COLUMNS)
    state.write_run({"alerts": alerts}, folder, "unused")
    state.write_run({"alerts": alerts.filter(F.col("run_id") == "RUN1997")}, folder, "RUN1997")
    state.write_run({"alerts": alerts.limit(0)}, folder, "RUN1996")
    return state.read_table(t.spark, folder, "alerts").select(*ALERT_COLUMNS)


def stored_state(t: Tables) -> str:
    """The given tables as a stored state."""
    folder = t.scratch("state")
    tables = {
        "transactions": t.txn, "customers": t.cust, "uploads": t.upload, "runs": t.run, "alerts": t.alert,
        "alert_transactions": t.line.select("alert_id", "transaction_id").join(t.alert.select("alert_id", "run_id"), "alert_id"),
    }
    state.commit(t.spark, folder, tables, {})
    return folder


def rows_by(t: Tables, folder: str, keys: dict[str, str]) -> DataFrame:
    parts = [
        state.read_table(t.spark, folder, name).groupBy(F.col(key).cast("string").alias("what")).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "what", "rows")
        for name, key in keys.items()
    ]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both


@query(
    "a17_drop_stored_upload",
    """select 'transactions' as name, upload_id as what, count(*) as rows from txn where upload_id <> 'UP1997' group by 2
       union all select 'customers', upload_id, count(*) from cust group by 2
       union all select 'uploads', upload_id, count(*) from upload where upload_id <> 'UP1997' group by 2
       union all select 'alerts', run_id, count(*) from alert where run_id not in (select run_id from run where upload_id = 'UP1997') group by 2
       union all select 'alert_transactions', run_id, count(*) from line join alert using (alert_id)
           where run_id not in (select run_id from run where upload_id = 'UP1997') group by 2""",
)
def drop_stored_upload(t: Tables) -> DataFrame:
    folder = stored_state(t)
    state.drop_upload(t.spark, folder, "UP1997", keep=["customers"])
    return rows_by(t, folder, {"transactions": "upload_id", "customers": "upload_id", "uploads": "upload_id", "alerts": "run_id", "alert_transactions": "run_id"})


@query(
    "a11_upsert_stored",
    """select transaction_id, customer_id, upload_id, case when upload_id = 'UP1997' and cast(transaction_id as bigint) % 3 = 0 then transaction_amount + 1 else transaction_amount end as transaction_amount from txn
       union all select 'new' || transaction_id, customer_id, 'UP2020', 5.0 from txn where upload_id = 'UP1996' and cast(transaction_id as bigint) % 50 = 0""",
)
def upsert_stored(t: Tables) -> DataFrame:
    """A batch that changes rows of one upload and brings a new one; other uploads are not written again."""
    folder = t.scratch("state")
    rows = t.txn.select("transaction_id", "customer_id", "upload_id", "transaction_amount", F.lit(0).alias("seq"))
    first = state.commit(t.spark, folder, {"transactions": rows}, {})
    number = F.col("transaction_id").cast("long")
    changed = rows.filter((F.col("upload_id") == "UP1997") & (number % 3 == 0)).withColumn("transaction_amount", F.col("transaction_amount") + 1)
    new = rows.filter((F.col("upload_id") == "UP1996") & (number % 50 == 0)).withColumns(
        {"transaction_id": F.concat(F.lit("new"), "transaction_id"), "upload_id": F.lit("UP2020"), "transaction_amount": F.lit(5.0)}
    )
    second = state.upsert_rows(t.spark, folder, "transactions", changed.unionByName(new), ["transaction_id"], "seq")
    moved = {k for k, v in second.parts["transactions"].items() if first.parts["transactions"].get(k) != v}
    assert moved == {"UP1997", "UP2020"}
    return state.read_table(t.spark, folder, "transactions").drop("seq")


EXPORT = """select a.alert_id as "Alert ID", a.scenario_name as "Scenario", a.risk_score as "Risk Score", a.customer_id as "Customer ID",
    a.customer_name as "Customer Name", coalesce(c.occupation, 'N/A') as "Occupation", coalesce(cast(c.annual_income as varchar), 'N/A') as "Annual Income",
    strftime(a.alert_date, '%Y-%m-%d %H:%M:%S') as "Date", a.trigger_reason as "Trigger Reason"
    from old a left join cust c on a.customer_id = c.customer_id"""


@query("a19_export_alerts", EXPORT)
def export_run(t: Tables) -> DataFrame:
    return export_alerts(t.old, t.cust)


@query("a19_export_csv", EXPORT.replace("a.risk_score as", "cast(a.risk_score as varchar) as"))
def export_csv(t: Tables) -> DataFrame:
    folder = t.scratch("export")
    sinks.write_csv(export_alerts(t.old, t.cust), folder)
    return ingest.read_delimited(t.spark, folder)


DIFF = """with o as (select *, row_number() over (partition by customer_id order by alert_date desc, alert_id desc) k from old),
    n as (select *, row_number() over (partition by customer_id order by alert_date desc, alert_id desc) k from new),
    j as (select coalesce(n.customer_id, o.customer_id) as customer_id,
        case when n.customer_id is null then 'removed' when o.customer_id is null then 'added' else 'maintained' end as status,
        coalesce(n.risk_score, o.risk_score) as risk_score, coalesce(n.risk_score - o.risk_score, 0) as risk_change,
        coalesce(n.scenario_name, o.scenario_name) as scenario, coalesce(n.aggregated_value, o.aggregated_value) as amount,
        coalesce(n.trigger_reason, o.trigger_reason) as reason
      from (select * from o where k = 1) o full outer join (select * from n where k = 1) n on o.customer_id = n.customer_id)
    """


@query(
    "a20_export_comparison",
    DIFF + """select customer_id as "Customer ID", status as "Status", risk_score as "Risk Score", risk_change as "Risk Change",
    scenario as "Scenario", amount as "Amount", reason as "Reason" from j order by risk_score desc, customer_id limit 100""",
)
def export_diff(t: Tables) -> DataFrame:
    return export_comparison(diff_peak(t.old, t.new))


@query(
    "a21_referential_check",
    """select count(distinct customer_id) as unknown_customers, count(*) as orphan_transactions from txn
       where customer_id not in (select customer_id from cust where occupation <> 'BUILDING')""",
)
def referential(t: Tables) -> DataFrame:
    return datasets.referential_check(t.txn, t.cust.filter(F.col("occupation") != "BUILDING"))


@query(
    "a_ingest_grouped",
    """select substr('UPLOAD-77', 1, 8) || '_' || cast(o_custkey as varchar) as customer_id, cast(o_custkey as varchar) as original_customer_id,
              cast(o_orderkey as varchar) as transaction_id, o_orderdate as transaction_date, o_totalprice as amount, 'UPLOAD-77' as upload_id
       from orders where o_orderkey % 7 <> 0 and o_orderkey % 5 <> 0""",
)
def ingest_grouped(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    rows = t.read("orders").select(
        key.cast("string").alias("Txn_ID"),
        F.when(key % 7 != 0, F.col("o_custkey").cast("string")).alias("Client ID"),
        F.when(key % 5 != 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise("later").alias("Transaction Date"),
        F.col("o_totalprice").cast("string").alias("Amount"),
    )
    return ingest.ingest(rows, "grouped", "UPLOAD-77")[1]


@query(
    "a8_twins_keep_their_rows",
    """select cast(o_custkey as varchar) as customer_id, o_orderpriority as channel, count(*) as rows from orders group by all""",
)
def twins(t: Tables) -> DataFrame:
    """Rows without id that are equal in every cell all survive the upsert by key that follows."""
    bare = t.txn.select(F.lit(" ").alias("transaction_id"), "customer_id", "channel")
    kept = datasets.last_wins(ingest.fill_missing_ids(bare), ["transaction_id"], "customer_id")
    return kept.groupBy("customer_id", "channel").agg(F.countDistinct("transaction_id").alias("rows"))
