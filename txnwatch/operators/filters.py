"""Filters of a rule as predicates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnwatch.functions.rows import one_row
from txnwatch.operators.skew import UNKNOWN, Hot, list_join

# Every accepted operator spelling.
OPERATORS = {
    "==": "eq", "equals": "eq",
    "!=": "ne", "not_equals": "ne",
    ">": "gt", "greater_than": "gt", "greaterthan": "gt",
    "<": "lt", "less_than": "lt", "lessthan": "lt",
    ">=": "ge", "greater_than_or_equal": "ge", "greater_then_equal": "ge", "greater_or_equal": "ge",
    "<=": "le", "less_than_or_equal": "le", "less_than_equal": "le", "less_or_equal": "le",
    "in": "in", "in_list": "in", "not_in": "not_in", "not_in_list": "not_in",
    "contains": "contains", "between": "between",
    "starts_with": "starts_with", "ends_with": "ends_with",
}
LIST_OPERATORS = ("in", "not_in", "between")


def operator_of(name: Any) -> str | None:
    return OPERATORS.get(str(name).strip().lower().replace(" ", "_"))


def normal_value(op: str, value: Any) -> Any:
    """A list for list operators (a comma text is split), the first element otherwise."""
    if op in LIST_OPERATORS:
        if isinstance(value, str):
            return [part.strip() for part in value.split(",")]
        return list(value) if isinstance(value, (list, tuple, set)) else [value]
    if isinstance(value, (list, tuple)):
        return value[0] if value else None
    return value


def coerce(value: Any, kind: T.DataType) -> Any:
    """The literal in the type of its column; the literal itself when that fails."""
    try:
        if isinstance(kind, T.NumericType):
            return float(value)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return value if isinstance(value, (date, datetime)) else datetime.fromisoformat(str(value))
        if isinstance(kind, T.BooleanType) and isinstance(value, str):
            return {"true": True, "false": False}[value.strip().lower()]
    except (TypeError, ValueError, KeyError):
        pass
    return value


def _fits(value: Any, kind: T.DataType) -> bool:
    if isinstance(kind, T.NumericType):
        return isinstance(value, float)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return isinstance(value, (date, datetime))
    if isinstance(kind, T.BooleanType):
        return isinstance(value, bool)
    return False


def _operand(column: Column, kind: T.DataType, values: Sequence[Any]) -> tuple[Column, list[Any]]:
    """Column and literals on common ground: the column's type if every literal fits, else text."""
    typed = [coerce(value, kind) for value in values]
    if all(_fits(value, kind) for value in typed):
        return (column.cast("double") if isinstance(kind, T.DecimalType) else column), typed
    return column.cast("string"), [str(value) for value in values]


def predicate(column: Column, kind: T.DataType, operator: str, value: Any, keep_null_on_ne: bool = False) -> Column:
    """One test (B5-B13, B22). ``keep_null_on_ne`` lets ``!=`` pass rows without a value."""
    op = operator_of(operator)
    value = normal_value(op, value)
    if op in ("contains", "starts_with", "ends_with"):
        text, needle = F.lower(column.cast("string")), str(value).lower()
        if op == "contains":
            return text.contains(needle)
        return text.startswith(needle) if op == "starts_with" else text.endswith(needle)
    if op == "between":
        operand, (low, *_, high) = _operand(column, kind, [value[0], value[-1]])
        return operand.between(low, high)
    if op in LIST_OPERATORS:
        # A literal that does not fit the column's type can equal none of its values.
        fitting = [item for item in value if _fits(coerce(item, kind), kind)]
        operand, literals = _operand(column, kind, fitting or value)
        return ~operand.isin(literals) if op == "not_in" else operand.isin(literals)
    operand, (literal,) = _operand(column, kind, [value])
    if op == "ne":
        return ~operand.eqNullSafe(F.lit(literal)) if keep_null_on_ne else operand != F.lit(literal)
    tests = {"eq": "__eq__", "gt": "__gt__", "lt": "__lt__", "ge": "__ge__", "le": "__le__"}
    return getattr(operand, tests[op])(F.lit(literal))


def complete(item: Mapping[str, Any]) -> bool:
    """A filter counts only with a field, a known operator and a value."""
    return bool(item.get("field")) and operator_of(item.get("operator")) is not None and item.get("value") is not None


def route(field: str, transaction_fields: Sequence[str], customer_fields: Sequence[str], prefer: str = "transaction") -> str | None:
    """The table a filter field belongs to.

    ``customer.x`` is always the customer table. A bare name found in both goes to ``prefer``: rules
    prefer the transaction, filter previews the customer.
    """
    if field.startswith("customer."):
        return "customer" if field.removeprefix("customer.") in customer_fields else None
    tables = {"transaction": field in transaction_fields, "customer": field in customer_fields}
    other = "customer" if prefer == "transaction" else "transaction"
    return prefer if tables[prefer] else other if tables[other] else None


def split_filters(
    filters: Iterable[Mapping[str, Any]],
    transactions: T.StructType,
    customers: T.StructType,
    unknown: str,
    mapping: Mapping[str, str] | None = None,
    prefer: str = "transaction",
    keep_null_on_ne: bool = False,
) -> tuple[list[Column], list[Column], list[str]]:
    """Predicates on transactions, predicates on customers, and the filters that had no effect.

    ``unknown`` is ``skip`` (an unknown field is ignored) or ``none`` (it matches no row).
    """
    on_transactions: list[Column] = []
    on_customers: list[Column] = []
    skipped: list[str] = []
    for item in filters:
        if not complete(item):
            skipped.append(str(item.get("field")))
            continue
        field = (mapping or {}).get(item["field"], item["field"])
        table = route(field, transactions.fieldNames(), customers.fieldNames(), prefer)
        if table is None:
            skipped.append(field)
            if unknown == "none":
                on_transactions.append(F.lit(False))
            continue
        name = field.removeprefix("customer.")
        schema = transactions if table == "transaction" else customers
        test = predicate(F.col(name), schema[name].dataType, item["operator"], item["value"], keep_null_on_ne)
        (on_transactions if table == "transaction" else on_customers).append(test)
    return on_transactions, on_customers, skipped


def all_of(tests: Iterable[Column]) -> Column:
    joined = F.lit(True)
    for test in tests:
        joined = joined & test
    return joined


def typed_filter(config: Mapping[str, Any]) -> list[dict[str, Any]]:
    """The typed filter object as a list of plain filters, custom ones last."""
    items: list[dict[str, Any]] = []
    for name in ("transaction_type", "channel", "customer_type"):
        if config.get(name):
            items.append({"field": name, "operator": "in", "value": list(config[name])})
    if config.get("direction"):
        side = "D" if str(config["direction"]).lower() == "debit" else "C"
        items.append({"field": "debit_credit_indicator", "operator": "==", "value": side})
    amounts = config.get("amount_range") or {}
    if amounts.get("min") is not None:
        items.append({"field": "transaction_amount", "operator": ">=", "value": amounts["min"]})
    if amounts.get("max") is not None:
        items.append({"field": "transaction_amount", "operator": "<=", "value": amounts["max"]})
    return items + list(config.get("custom_field_filters") or ())


def apply_filters(
    transactions: DataFrame,
    customers: DataFrame | None,
    filters: Any,
    profile: str,
    mapping: Mapping[str, str] | None = None,
    hot: Hot = UNKNOWN,
) -> DataFrame:
    """Transactions passing all filters of a rule.

    Transaction tests reach the scan. Customer tests select customer keys first, and transactions are
    semi-joined to them, so no customer column travels with the rows.
    """
    items = typed_filter(filters) if isinstance(filters, Mapping) else list(filters)
    schema = customers.schema if customers is not None else T.StructType()
    tests, customer_tests, _ = split_filters(
        items,
        transactions.schema,
        schema,
        unknown="none" if profile == "peak" else "skip",
        mapping=mapping,
        keep_null_on_ne=profile == "grouped",
    )
    kept = transactions.filter(all_of(tests))
    if customer_tests:
        keys = customers.filter(all_of(customer_tests)).select("customer_id")
        kept = list_join(kept, keys, ["customer_id"], "left_semi", salt_on=["transaction_id"], hot=hot)
    return kept


def in_date_range(transactions: DataFrame, start: Any = None, end: Any = None, column: str = "transaction_date") -> DataFrame:
    """Both ends inclusive; a missing end is open."""
    if start is not None:
        transactions = transactions.filter(F.col(column) >= F.lit(start).cast("timestamp"))
    if end is not None:
        transactions = transactions.filter(F.col(column) <= F.lit(end).cast("timestamp"))
    return transactions


# Fields a grouped preview looks up in the customer table.
PREVIEW_CUSTOMER_FIELDS = ("occupation", "customer_type", "annual_income", "account_type", "risk_score", "customer_name")


def _counts_per_customer(
    transactions: DataFrame, customers: DataFrame, tests: Sequence[Column], customer_tests: Sequence[Column]
) -> DataFrame:
    """Rows and matches per customer. Rows are counted per customer before the customer test is joined."""
    counts = (
        transactions.select("customer_id", F.coalesce(all_of(tests), F.lit(False)).alias("_test"))
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("_all"), F.count_if("_test").alias("_hit"))
    )
    if not customer_tests:
        return counts
    passing = customers.filter(all_of(customer_tests)).select("customer_id", F.lit(1).alias("_passes")).distinct()
    return counts.join(passing, "customer_id", "left").withColumn(
        "_hit", F.when(F.col("_passes") == 1, F.col("_hit")).otherwise(F.lit(0))
    )


def preview_grouped(transactions: DataFrame, customers: DataFrame, filters: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Matched rows and customers, totals, and the match percentage (0 when empty)."""
    routed = T.StructType([f for f in customers.schema.fields if f.name in PREVIEW_CUSTOMER_FIELDS])
    tests, customer_tests, _ = split_filters(filters, transactions.schema, routed, unknown="skip", prefer="customer")
    counts = _counts_per_customer(transactions, customers, tests, customer_tests).agg(
        F.sum("_hit").alias("matched_transactions"),
        F.count_if((F.col("_hit") > 0) & F.col("customer_id").isNotNull()).alias("matched_customers"),
        F.sum("_all").alias("total_transactions"),
    )
    both = one_row([counts, customers.agg(F.count(F.lit(1)).alias("total_customers"))])
    summed = both.select(*[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in both.columns])
    share = F.round(F.try_divide(F.col("matched_transactions") * 100.0, F.col("total_transactions")), 2)
    return summed.withColumn("match_percentage", F.coalesce(share, F.lit(0.0)))


def preview_peak(transactions: DataFrame, customers: DataFrame, filters: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Matching and total transactions; no filter at all counts as no match and no total."""
    tests, customer_tests, _ = split_filters(
        filters, transactions.schema, customers.schema, unknown="none", prefer="customer"
    )
    counted = transactions if filters else transactions.limit(0)
    return _counts_per_customer(counted, customers, tests, customer_tests).agg(
        F.coalesce(F.sum("_hit"), F.lit(0)).alias("match_count"),
        F.coalesce(F.sum("_all"), F.lit(0)).alias("total_records"),
    )
