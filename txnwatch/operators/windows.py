"""Peak forward windows and trailing windows per customer.

Time is a whole number of microseconds and values are exact decimals, so sums do not depend on the
order in which partitions arrive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.operators.skew import UNKNOWN, Hot, hot_blocks, hot_groups, hot_within, skew_join, sliding, whole

# Twelve digits after the point, 22 before it. Readable numbers beyond LARGEST count as LARGEST.
AMOUNT = "decimal(34,12)"
LARGEST = 1e21
DAY = 86_400_000_000


def micros(ts: str | Column) -> Column:
    return F.unix_micros(instant(ts))


def instant(ts: str | Column) -> Column:
    """The time as a timestamp; null where the text cannot be read."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return column.try_cast("timestamp")


def amount_of(column: str | Column) -> Column:
    """The value as an exact number, null if it is missing or not a number.

    Digits beyond the twelfth after the point are rounded. Numbers beyond ``LARGEST`` either way, infinity
    included, count as that bound: still the largest of all, and sums of many of them stay in range.
    """
    column = F.col(column) if isinstance(column, str) else column
    rough = column.try_cast("double")
    bound = F.when(F.isnan(rough), None).when(rough >= LARGEST, LARGEST).when(rough <= -LARGEST, -LARGEST)
    return F.coalesce(bound.cast(AMOUNT), column.try_cast(AMOUNT))


def number(column: str | Column) -> Column:
    """The value as a number; missing or non-numeric text counts as zero."""
    return F.coalesce(amount_of(column), F.lit(0).cast(AMOUNT))


def _peak_nodes(rows: DataFrame, function: str) -> DataFrame:
    """Rows merged into window starts.

    Items are ordered by (time, value, id). Among items of one instant only one start can win for sum,
    count and max, so an instant is one node; avg and min need one node per instant and value. Per node:
    ``own``/``own_n`` what the window gains from its starting node, ``total``/``n``/``low``/``high`` what
    the node gives to windows that started earlier, ``v`` the value of the starting item. Items of that
    value all belong to the window, except where an instant has only losses: there a sum starts at the
    very last item (``single``). Only numbers are aggregated, so the merge runs in hash maps.
    """
    value = F.col("v")
    keys = ["customer_id", "at", "v"] if function in ("avg", "min") else ["customer_id", "at"]
    gain = value >= 0
    nodes = rows.groupBy(*keys).agg(
        F.sum(value).alias("total"),
        F.count(F.lit(1)).alias("n"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
        *(
            [
                F.sum(F.when(gain, value)).alias("gain"),
                F.count_if(gain).alias("gains"),
                F.min(F.when(gain, value)).alias("first_gain"),
            ]
            if function == "sum"
            else []
        ),
    )
    plain = [F.col(c) for c in ("customer_id", "at", "total", "n", "low", "high")]
    if function == "sum":
        return nodes.select(
            *plain,
            F.coalesce(F.col("gain"), F.col("high")).alias("own"),
            F.greatest(F.col("gains"), F.lit(1)).alias("own_n"),
            F.coalesce("first_gain", "high").alias("v"),
            (F.col("gains") == 0).alias("single"),
        )
    start = F.col("v") if "v" in keys else F.col("low")
    return nodes.select(
        *plain, F.col("total").alias("own"), F.col("n").alias("own_n"), start.alias("v"), F.lit(False).alias("single")
    )


def peak_windows(
    transactions: DataFrame,
    days: int = 30,
    function: str = "sum",
    value: str = "transaction_amount",
    ts: str = "transaction_date",
    hot: Hot = UNKNOWN,
) -> DataFrame:
    """Per customer, the window of ``days`` starting at a transaction with the largest aggregate.

    The best must be above zero and the earliest start wins ties; a customer without such a window
    gets value 0, no transactions, and the last transaction's date (L20). The alert date is the last
    transaction inside the window (L21). ``days`` of 0 means 30 (L23). ``hot`` may hand over the hot
    customers, if the caller has counted them.
    """
    if hot is UNKNOWN:
        hot = hot_groups(transactions, ["customer_id"])
    if hot is not None:
        # Customers without many rows need no chunks: all their steps share one exchange.
        few = hot.drop("_pieces")
        parts = [
            _peak_windows(transactions.join(few, "customer_id", how), days, function, value, ts, found)
            for how, found in (("left_anti", None), ("left_semi", hot))
        ]
        return parts[0].unionByName(parts[1])
    return _peak_windows(transactions, days, function, value, ts, None)


def _peak_windows(
    transactions: DataFrame, days: int, function: str, value: str, ts: str, hot: DataFrame | None
) -> DataFrame:
    width = (days or 30) * DAY
    rows = transactions.select(
        "customer_id", micros(ts).alias("at"), number(value).alias("v")
    ).filter(F.col("customer_id").isNotNull() & F.col("at").isNotNull())
    if hot is None:
        rows = rows.repartition("customer_id")
    nodes = _peak_nodes(rows, function)
    aggs = {"w_n": ("sum", "n"), "w_last": ("max", "at_seen")}
    if function in ("sum", "avg"):
        aggs["w_total"] = ("sum", "total")
    elif function == "max":
        aggs["w_high"] = ("max", "high")
    elif function == "min":
        aggs["w_low"] = ("min", "low")
    seen = sliding(
        nodes.withColumn("at_seen", F.col("at")),
        ["customer_id"],
        "at",
        width,
        aggs,
        tie="v" if function in ("avg", "min") else None,
        source=rows.select("customer_id", "at"),
        hot=hot,
    )
    count = F.col("own_n") + F.coalesce(F.col("w_n"), F.lit(0))
    total = F.col("own") + F.coalesce(F.col("w_total"), F.lit(0).cast(AMOUNT)) if "w_total" in aggs else None
    result = {
        "sum": lambda: total.cast("double"),
        "count": lambda: count.cast("double"),
        "avg": lambda: total.cast("double") / count,
        "max": lambda: F.greatest(F.col("high"), F.col("w_high")).cast("double"),
        "min": lambda: F.least(F.col("v"), F.col("w_low")).cast("double"),
    }[function]()
    candidate = F.struct(
        result.alias("agg"), (-F.col("at")).alias("neg_at"), (-F.col("v")).alias("neg_v"),
        count.alias("n"), F.greatest("at", "w_last").alias("last"), F.col("single").alias("single"),
    )
    best = seen.groupBy("customer_id").agg(
        F.max(F.when(result > 0, candidate)).alias("best"),
        F.sum("n").alias("customer_transactions"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
    )
    return best.select(
        "customer_id",
        F.coalesce(F.col("best.agg"), F.lit(0.0)).alias("aggregated_value"),
        F.coalesce(F.col("best.n"), F.lit(0)).cast("long").alias("transaction_count"),
        F.timestamp_micros(-F.col("best.neg_at")).alias("window_start"),
        F.timestamp_micros(width - F.col("best.neg_at")).alias("window_end"),
        F.timestamp_micros(F.coalesce(F.col("best.last"), F.col("last_at"))).alias("alert_date"),
        (-F.col("best.neg_v")).cast(AMOUNT).alias("start_value"),
        F.coalesce("best.single", F.lit(False)).alias("starts_at_last"),
        "customer_transactions",
        F.timestamp_micros("first_at").alias("first_date"),
        F.timestamp_micros("last_at").alias("last_date"),
    )


def trailing_windows(
    transactions: DataFrame,
    width: int,
    function: str = "sum",
    group_by: Sequence[str] = ("customer_id",),
    value: str = "transaction_amount",
    ts: str = "transaction_date",
    hot: Hot = UNKNOWN,
) -> DataFrame:
    """D6 per instant: the aggregate over ``[ts - width, ts]``, all transactions of the same instant included.

    Every transaction of one instant has the same window, so one row per (group, instant) holds them
    all; ``peers`` says how many transactions share it. Rows with a missing group key are left out.
    """
    group = list(group_by)
    if hot is UNKNOWN:
        hot = hot_groups(transactions, group)
    if hot is not None:
        few = hot.drop("_pieces")
        parts = [
            _trailing_windows(transactions.join(few, group, how), width, function, group, value, ts, found)
            for how, found in (("left_anti", None), ("left_semi", hot))
        ]
        return parts[0].unionByName(parts[1])
    return _trailing_windows(transactions, width, function, group, value, ts, None)


def _trailing_windows(
    transactions: DataFrame, width: int, function: str, group: list[str], value: str, ts: str, hot: DataFrame | None
) -> DataFrame:
    rows = transactions.select(*group, micros(ts).alias("_at"), amount_of(value).alias("_v")).dropna(subset=[*group, "_at"])
    if hot is None:
        rows = rows.repartition(*group)
    nodes = rows.groupBy(*group, "_at").agg(
        F.sum("_v").alias("total"), F.count("_v").alias("filled"), F.count(F.lit(1)).alias("peers"),
        F.min("_v").alias("low"), F.max("_v").alias("high"),
    )
    back = nodes.withColumn("_back", -F.col("_at"))
    aggs = {"w_n": ("sum", "peers")}
    if function in ("sum", "avg"):
        aggs["w_total"] = ("sum", "total")
    if function == "avg":
        aggs["w_filled"] = ("sum", "filled")
    if function == "max":
        aggs["w_high"] = ("max", "high")
    if function == "min":
        aggs["w_low"] = ("min", "low")
    seen = sliding(back, group, "_back", width, aggs, source=rows.select(*group, (-F.col("_at")).alias("_back")), hot=hot)
    zero = F.lit(0).cast(AMOUNT)
    count = F.col("peers") + F.coalesce(F.col("w_n"), F.lit(0))
    if function in ("sum", "avg"):
        total = (F.coalesce(F.col("total"), zero) + F.coalesce(F.col("w_total"), zero)).cast("double")
    result = {
        "sum": lambda: total,
        "count": lambda: count.cast("double"),
        "avg": lambda: F.try_divide(total, (F.col("filled") + F.coalesce(F.col("w_filled"), F.lit(0))).cast("double")),
        "max": lambda: F.greatest("high", "w_high").cast("double"),
        "min": lambda: F.least("low", "w_low").cast("double"),
    }[function]()
    at = F.timestamp_micros("_at")
    return seen.select(
        *group,
        at.alias("alert_date"),
        F.timestamp_micros(F.col("_at") - F.lit(width)).alias("window_start"),
        at.alias("window_end"),
        result.alias("aggregated_value"),
        count.cast("long").alias("transaction_count"),
        "peers",
    )


def trailing_rows(
    transactions: DataFrame,
    width: int,
    function: str = "sum",
    group_by: Sequence[str] = ("customer_id",),
    value: str = "transaction_amount",
    ts: str = "transaction_date",
) -> DataFrame:
    """The trailing aggregate on every transaction row."""
    group = list(group_by)
    groups = hot_groups(transactions, group)
    values = trailing_windows(transactions, width, function, group, value, ts, groups).select(
        *group, F.unix_micros("alert_date").alias("_at"), "aggregated_value", "transaction_count"
    )
    rows = transactions.withColumn("_at", micros(ts))
    hot = hot_within(rows, [*group, "_at"], group, groups)
    return skew_join(rows, values, [*group, "_at"], "inner", salt_on=["transaction_id"], hot=hot).drop("_at")


def in_peak_window(
    transactions: DataFrame,
    windows: DataFrame,
    value: str = "transaction_amount",
    ts: str = "transaction_date",
    hot: Hot = UNKNOWN,
    keys: Sequence[str] = ("customer_id",),
) -> DataFrame:
    """Transactions that belong to the peak window of their customer, one window per customer (or ``keys``).

    A window that starts at the last of several equal losses takes only the one with the greatest id. That one is
    found among the few rows at the start of such windows, so the pairs of window and transaction are formed once.
    """
    starts = windows.filter(F.col("transaction_count") > 0)
    keys = list(keys)
    joined = skew_join(transactions, starts, keys, "inner", salt_on=["transaction_id"], hot=hot)
    v, at = number(value), instant(ts)
    first = at == F.col("window_start")
    later = (at > F.col("window_start")) & (at <= F.col("window_end"))
    # The greatest id at the start of windows that hold losses only; one row per such customer.
    alone = starts.filter("starts_at_last").select(*keys, F.col("window_start").alias("_s"), F.col("start_value").alias("_start"))
    ends = transactions.select(*keys, instant(ts).alias("_s"), v.alias("_start"), "transaction_id")
    last = ends.join(alone, [*keys, "_s", "_start"], "left_semi").groupBy(*keys).agg(F.max("transaction_id").alias("_last"))
    marked = joined.join(last, keys, "left")
    begin = F.when(F.col("starts_at_last"), F.col("transaction_id") == F.col("_last")).otherwise(v >= F.col("start_value"))
    return marked.filter(later | (first & F.coalesce(begin, F.lit(False)))).drop("_last")


def in_trailing_window(
    transactions: DataFrame,
    alerts: DataFrame,
    width: int | Column,
    group_by: Sequence[str] = ("customer_id",),
    ts: str = "transaction_date",
    hot: Hot = UNKNOWN,
) -> DataFrame:
    """Transactions inside the trailing windows of their alerts; overlapping windows repeat a transaction.

    Both sides meet on the group and a time block of the window's length. After alerts are reduced to
    one per day, a block holds few alerts, so the join only forms pairs near the result.
    """
    group = list(group_by)
    block = lambda column: whole(micros(column), width)
    spans = alerts.withColumn(
        "_block", F.explode(F.array_distinct(F.array(block(F.col("window_start")), block(F.col("window_end")))))
    )
    rows = transactions.withColumn("_block", block(F.col(ts)))
    groups = hot_groups(transactions, group) if hot is UNKNOWN else hot
    blocks = hot_blocks(transactions, group, block(F.col(ts)), groups)
    joined = skew_join(rows, spans, [*group, "_block"], "inner", salt_on=["transaction_id"], hot=blocks)
    at = instant(ts)
    return joined.filter(at.between(F.col("window_start"), F.col("window_end"))).drop("_block")
