"""Discovery and data quality."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import Tables, half_up, query
from txnwatch.operators import profile, quality

NOW = "1999-01-01 00:00:00"


@query("h1_payload_fields", "select distinct unnest(json_keys(props)) as field_name from events")
def payload(t: Tables) -> DataFrame:
    return profile.payload_fields(t.read("events"), "props")


@query(
    "h2_field_types",
    """with v as (select 'amount' as field_name, cast(o_totalprice as varchar) as x from orders union all select 'day', strftime(o_orderdate, '%d/%m/%Y') from orders
                  union all select 'flag', case when o_orderstatus = 'F' then 'Yes' else 'no' end from orders
                  union all select 'bit', case when o_orderstatus = 'F' then '1' else '0' end from orders union all select 'channel', o_orderpriority from orders)
       select field_name, case field_name when 'day' then 'date' when 'flag' then 'boolean' when 'channel' then 'text' else 'numeric' end as field_type,
              count(*) as non_null_count, count(distinct x) as distinct_count from v group by field_name""",
)
def types(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus") == "F"
    rows = t.read("orders").select(
        F.col("o_totalprice").alias("amount"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("day"),
        F.when(status, "Yes").otherwise("no").alias("flag"),
        F.when(status, "1").otherwise("0").alias("bit"),
        F.col("o_orderpriority").alias("channel"),
    )
    return profile.field_types(profile.value_counts(rows))


@query(
    "h5_autocomplete",
    """select distinct customer_name as value from cust where contains(lower(customer_name), '00012') order by value limit 20""",
)
def complete(t: Tables) -> DataFrame:
    return profile.autocomplete(t.txn, t.cust, "customer_name", "00012")


@query(
    "h5_autocomplete_tables",
    """select distinct upload_id as value from cust where contains(lower(upload_id), 'up199') and upload_id not in (select upload_id from txn where channel = 'none')
       order by value limit 50""",
)
def complete_second(t: Tables) -> DataFrame:
    return profile.autocomplete(t.txn.filter(F.col("channel") == "none"), t.cust, "upload_id", "up199", 50)


@query(
    "h6_ranked_values",
    """with c as (select upload_id as value, count(*) as count from txn group by 1 order by count desc, value limit 100)
       select value, count, round(count * 100.0 / (select count(*) from txn), 2) as percentage from c where contains(lower(value), '199') order by count desc, value limit 20""",
)
def ranked(t: Tables) -> DataFrame:
    return profile.ranked_values(t.txn, "upload_id", "199")


@query(
    "h7_operators",
    """select k as field_type, case k when 'numeric' then 'equals,not_equals,greater_than,less_than,greater_or_equal,less_or_equal,between'
              when 'date' then 'equals,greater_than,less_than,between' when 'boolean' then 'equals'
              else 'equals,not_equals,in,contains,starts_with,ends_with' end as operators
       from (select distinct case o_orderstatus when 'F' then 'numeric' when 'O' then 'date' else 'text' end as k from orders)""",
)
def operators(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    kinds = t.read("orders").select(F.when(status == "F", "numeric").when(status == "O", "date").otherwise("text").alias("field_type")).distinct()
    return kinds.select("field_type", F.array_join(profile.recommended_operators("field_type"), ",").alias("operators"))


@query(
    "h12_catalogue",
    """with v as (select 'customer_name' as f, customer_name as x from cust union all select 'annual_income', cast(annual_income as varchar) from cust
                  union all select 'region', region from cust)
       select f as name, case f when 'annual_income' then 'numeric' else 'text' end as type,
              case f when 'annual_income' then 'Annual Income' when 'region' then 'Region' else 'Customer Name' end as label,
              (select count(*) from cust) as total, count(distinct x) as "distinct", (select count(*) from cust) - count(x) as nulls from v group by f""",
)
def catalogue(t: Tables) -> DataFrame:
    return profile.field_catalogue(t.cust, ["customer_name", "annual_income", "region"]).drop("operators", "sample_values")


def dirty(t: Tables) -> DataFrame:
    """Orders with repeated ids, gaps and odd amounts."""
    key = F.col("o_orderkey")
    amount = (
        F.when(key % 13 == 0, -F.col("o_totalprice")).when(key % 17 == 0, F.lit(0.0)).when(key % 19 == 0, F.lit(None).cast("double"))
        .when(key % 23 == 0, F.lit(2e7)).otherwise(F.col("o_totalprice"))
    )
    return t.read("orders").select(
        F.floor(key / 3).alias("transaction_id"),
        F.when(key % 11 != 0, F.col("o_custkey")).alias("customer_id"),
        F.col("o_orderdate").cast("timestamp").alias("transaction_date"),
        amount.alias("transaction_amount"),
    )


DIRTY = """with d as (select o_orderkey // 3 as transaction_id, case when o_orderkey % 11 <> 0 then o_custkey end as customer_id, o_orderdate as transaction_date,
    case when o_orderkey % 13 = 0 then -o_totalprice when o_orderkey % 17 = 0 then 0 when o_orderkey % 19 = 0 then null when o_orderkey % 23 = 0 then 2e7 else o_totalprice end as a from orders),
  i as (
    select 'error' as severity, 'transaction_amount' as field, count(*) filter (a < 0) as count, 'transactions have negative amounts' as m from d
    union all select 'warning', 'transaction_date', count(*) filter (transaction_date > timestamp '1999-01-01'), 'transactions are future-dated' from d
    union all select 'error', 'customer_id', count(*) filter (customer_id is null), 'transactions missing customer_id' from d
    union all select 'error', 'transaction_amount', count(*) filter (a is null), 'transactions missing amount' from d
    union all select 'warning', 'transaction_amount', count(*) filter (a > 10000000), 'transactions exceed 10M (potential data entry errors)' from d
    union all select 'warning', 'transaction_amount', count(*) filter (a = 0), 'transactions have zero amount' from d
    union all select 'error', 'transaction_id', count(*) - count(distinct transaction_id), 'duplicate transaction IDs found' from d)
  """


@query("h8_transaction_issues", DIRTY + "select severity, field, count, cast(count as varchar) || ' ' || m as message from i where count > 0")
def issues(t: Tables) -> DataFrame:
    return quality.transaction_issues(dirty(t), NOW)


@query(
    "h8_transaction_report",
    DIRTY
    + """select count(*) filter (severity = 'error' and count > 0) = 0 as valid, count(*) filter (severity = 'error' and count > 0) as errors,
             count(*) filter (severity = 'warning' and count > 0) as warnings, (select count(*) from d) as total_rows, (select count(*) from d) - sum(count) as clean_rows,
             greatest(0, 100 - 15 * count(*) filter (severity = 'error' and count > 0) - 5 * count(*) filter (severity = 'warning' and count > 0)) as quality_score from i""",
)
def report(t: Tables) -> DataFrame:
    rows = dirty(t)
    return quality.quality_report(rows, quality.transaction_issues(rows, NOW))


@query(
    "h9_customer_issues",
    """with d as (select case when c_custkey % 5 <> 0 then c_custkey // 2 end as customer_id, case when c_custkey % 4 <> 0 then c_name end as n from customer)
       select 'error' as severity, 'customer_id' as field, count(*) filter (customer_id is null) as count, cast(count(*) filter (customer_id is null) as varchar) || ' customers missing customer_id' as message from d
       union all select 'warning', 'customer_name', count(*) filter (n is null), cast(count(*) filter (n is null) as varchar) || ' customers missing name' from d
       union all select 'error', 'customer_id', count(*) - count(distinct coalesce(customer_id, -1)), cast(count(*) - count(distinct coalesce(customer_id, -1)) as varchar) || ' duplicate customer IDs found' from d""",
)
def customer_issues(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    rows = t.read("customer").select(
        F.when(key % 5 != 0, F.floor(key / 2)).alias("customer_id"), F.when(key % 4 != 0, F.col("c_name")).alias("customer_name")
    )
    return quality.customer_issues(rows)


@query(
    "h10_upload_scores",
    f"""with d as (select case when o_orderkey % 9 <> 0 then cast(o_orderkey // 2 as varchar) else ' ' end as id,
                         case when o_orderkey % 8 = 0 then 'x' else cast(o_totalprice as varchar) end as amount,
                         case when o_orderkey % 7 = 0 then null else strftime(o_orderdate, '%Y-%m-%d') end as day from orders)
        select {half_up("(count(*) filter (trim(id) <> '') + count(amount) + count(day)) * 100.0 / (count(*) * 3)", 2)} as completeness_score,
               {half_up("(count(*) filter (amount <> 'x') + count(day)) * 100.0 / (count(amount) + count(day))", 2)} as validity_score,
               {half_up("count(distinct id) * 100.0 / count(*)", 2)} as uniqueness_score from d""",
)
def scores(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    rows = t.read("orders").select(
        F.when(key % 9 != 0, F.floor(key / 2).cast("string")).otherwise(" ").alias("id"),
        F.when(key % 8 == 0, "x").otherwise(F.col("o_totalprice").cast("string")).alias("amount"),
        F.when(key % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
    )
    return quality.upload_scores(rows, ["id", "amount", "day"], "id", numbers=["amount"], dates=["day"])


TEXTS = """with d as (select cast(o_orderkey as varchar) as transaction_id, cast(o_custkey as varchar) as customer_id,
    case when o_orderkey % 13 = 0 then 'abc' when o_orderkey % 29 <> 0 then cast(o_totalprice as varchar) end as a,
    case when o_orderkey % 17 = 0 then 'some day' else cast(o_orderdate as varchar) end as at, o_orderkey as k, o_orderdate as od from orders),
  i(severity, field, count, m) as (
    select 'error', 'transaction_amount', count(*) filter (k % 13 <> 0 and k % 29 = 0), 'transactions missing amount' from d
    union all select 'error', 'transaction_amount', count(*) filter (k % 13 = 0), 'transactions with unreadable amount' from d
    union all select 'error', 'transaction_date', count(*) filter (k % 17 = 0), 'transactions with unreadable date' from d
    union all select 'warning', 'transaction_date', count(*) filter (k % 17 <> 0 and od > timestamp '2000-01-01'), 'transactions are future-dated' from d)
  """


@query("h8_unreadable_cells", TEXTS + "select severity, field, count, cast(count as varchar) || ' ' || m as message from i where count > 0")
def unreadable(t: Tables) -> DataFrame:
    key = F.col("transaction_id").cast("long")
    price = F.when(key % 13 == 0, "abc").when(key % 29 != 0, F.col("transaction_amount").cast("string"))
    date = F.when(key % 17 == 0, "some day").otherwise(F.col("transaction_date").cast("string"))
    rows = t.txn.withColumns({"transaction_amount": price, "transaction_date": date})
    return quality.transaction_issues(rows, "2000-01-01 00:00:00")
