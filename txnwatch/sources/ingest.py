"""Reading and cleaning delimited uploads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnwatch.functions.text import to_number
from txnwatch.operators.profile import DATE_PATTERNS, parsed_date
from txnwatch.sources.quoted import read_quoted

TRANSACTIONS, CUSTOMERS = "transactions", "customers"

# Accepted spellings of the id columns per kind of file and dialect.
ID_ALIASES = {
    ("grouped", TRANSACTIONS): {
        "transaction_id": ["transaction_id", "id", "txn_id", "ref"],
        "customer_id": ["customer_id", "cust_id", "client_id"],
    },
    ("grouped", CUSTOMERS): {"customer_id": ["customer_id", "id", "cust_id", "client_id"]},
    ("peak", TRANSACTIONS): {
        "transaction_id": ["transaction_id", "txn_id"],
        "customer_id": ["customer_id", "cust_id", "client_id"],
    },
    ("peak", CUSTOMERS): {"customer_id": ["customer_id", "cust_id", "client_id"]},
}
# Payload fields typed when a payload is flattened.
PAYLOAD_DATES = ("transaction_date", "account_opening_date", "date_of_birth", "created_date")
PAYLOAD_NUMBERS = ("transaction_amount", "balance", "annual_income", "risk_score")
SYSTEM_COLUMNS = ("customer_id", "transaction_id", "upload_id", "created_at", "expires_at")


class UnknownFile(ValueError):
    """The header fits neither transactions nor customers."""


def read_delimited(spark: SparkSession, path: str, delimiter: str = ",", multi_line: bool = False) -> DataFrame:
    """A1: a delimited file with header, every cell as text; a byte-order mark is removed.

    ``multi_line`` keeps line breaks inside quoted cells; see ``quoted.read_quoted``.
    """
    if multi_line:
        return read_quoted(spark, path, delimiter)
    df = spark.read.csv(path, header=True, sep=delimiter, encoding="UTF-8", quote='"', escape='"')
    return df.toDF(*[name.lstrip("﻿") for name in df.columns])


def normal_header(df: DataFrame) -> DataFrame:
    """A3: column names in lower case, trimmed, spaces as underscores."""
    return df.toDF(*[name.strip().lower().replace(" ", "_") for name in df.columns])


def kind_of(columns: Sequence[str]) -> str:
    """A2: transactions or customers, by the id columns of the header."""
    names = {name.strip().lower() for name in columns}
    if names & {"transaction_id", "txn_id"}:
        return TRANSACTIONS
    if names & {"customer_id", "cust_id"}:
        return CUSTOMERS
    raise UnknownFile(f"neither transactions nor customers: {sorted(names)}")


def present(column: str | Column) -> Column:
    """The trimmed text, null when empty or the word None."""
    text = F.trim(F.col(column).cast("string") if isinstance(column, str) else column)
    return F.when((text != "") & (text != "None"), text)


def apply_aliases(df: DataFrame, profile: str, kind: str) -> DataFrame:
    """A4: id columns under their engine names; the first filled spelling counts. Other columns keep their names."""
    aliases = ID_ALIASES[(profile, kind)]
    lower = {name.strip().lower(): name for name in df.columns}
    found: dict[str, Column] = {}
    used: set[str] = set()
    for target, spellings in aliases.items():
        sources = [lower[s] for s in spellings if s in lower and lower[s] not in used]
        used.update(sources)
        found[target] = F.coalesce(*[present(s) for s in sources]) if sources else F.lit(None).cast("string")
    others = [F.col(name) for name in df.columns if name not in used and name.strip().lower() not in found]
    return df.select(*[column.alias(name) for name, column in found.items()], *others)


def finite(df: DataFrame) -> DataFrame:
    """A5: infinite and NaN numbers become null."""
    fixed = {
        f.name: F.when(~F.isnan(f.name) & (F.abs(f.name) != float("inf")), F.col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(fixed) if fixed else df


def column_types(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Bigint if every filled cell is a whole number, else double, else string, decided in one pass."""
    tests = []
    for i, name in enumerate(columns):
        cell = present(name)
        tests += [
            F.min(F.when(cell.isNotNull(), to_number(cell, "bigint").isNotNull())).alias(f"i{i}"),
            F.min(F.when(cell.isNotNull(), to_number(cell).isNotNull())).alias(f"d{i}"),
        ]
    if not tests:
        return {}
    row = df.agg(*tests).first()
    return {
        name: "bigint" if row[f"i{i}"] else "double" if row[f"d{i}"] else "string" for i, name in enumerate(columns)
    }


def cast_cells(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Trimmed cells in the type of their column, empty ones null."""
    return df.withColumns(
        {name: present(name) if kind == "string" else to_number(present(name), kind) for name, kind in types.items()}
    )


def parse_dates(df: DataFrame, column: str, patterns: Sequence[tuple[str, str]] = DATE_PATTERNS) -> DataFrame:
    """Day-first before month-first; a date no pattern reads is null and shows up among the rejects."""
    return df.withColumn(column, parsed_date(present(column), patterns))


def key_check(df: DataFrame, required: Sequence[str], row_number: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with all keys, and the rejects with their reason.

    ``row_number`` names a column with the position of the row in the file; the reject shows it as the
    line, counting the header.
    """
    missing = F.array_compact(F.array(*[F.when(present(name).isNull(), F.lit(name)) for name in required]))
    marked = df.withColumn("_missing", missing)
    good = marked.filter(F.size("_missing") == 0).drop("_missing")
    line = [(F.col(row_number) + 2).alias("row")] if row_number else []
    rejects = marked.filter(F.size("_missing") > 0).select(
        *line, *required, F.concat(F.lit("Missing required fields: "), F.array_join("_missing", ", ")).alias("error")
    )
    return good, rejects


def fill_missing_ids(df: DataFrame, column: str = "transaction_id") -> DataFrame:
    """A8 (peak): a row without transaction id gets one derived from its content.

    Equal rows are told apart by their number among their likes, so each keeps an id of its own. They are counted
    first and written out again, so many equal rows meet no single task.
    """
    others = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns if c != column]
    filled = df.withColumn(column, present(column))
    given = filled.filter(F.col(column).isNotNull())
    alike = filled.filter(F.col(column).isNull()).groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_likes"))
    each = alike.withColumn("_like", F.explode(F.sequence(F.lit(1), F.col("_likes").cast("int"))))
    again = F.when(F.col("_like") > 1, F.col("_like").cast("string"))
    generated = F.sha2(F.concat_ws("\u0001", *others, again), 256)
    return given.unionByName(each.withColumn(column, generated).drop("_likes", "_like"))


def tenant_ids(df: DataFrame, upload_id: str | Column, columns: Sequence[str] = ("customer_id",)) -> DataFrame:
    """Ids prefixed with the first eight characters of the upload; the originals stay as ``original_*``."""
    upload = F.lit(upload_id) if isinstance(upload_id, str) else upload_id
    prefix = F.substring(upload, 1, 8)
    originals = {f"original_{name}": F.col(name).cast("string") for name in columns}
    prefixed = {name: F.concat(prefix, F.lit("_"), F.col(name).cast("string")) for name in columns}
    return df.withColumns(originals).withColumns(prefixed)


def accounts_of(customers: DataFrame, upload_id: str | Column, now: object) -> DataFrame:
    """One account per customer row, with defaults for what the file lacks."""
    upload = F.lit(upload_id) if isinstance(upload_id, str) else upload_id
    has = set(customers.columns)

    def cell(name: str) -> Column:
        return present(name) if name in has else F.lit(None).cast("string")

    # A customer without account columns gets an id derived from the customer, so a repeated upload agrees.
    original = F.coalesce(cell("account_id"), cell("account_number"), F.sha2(F.col("customer_id").cast("string"), 256))
    opened = F.coalesce(parsed_date(cell("open_date")), cell("open_date").try_cast("timestamp"), F.lit(now).cast("timestamp"))
    return customers.select(
        F.concat(F.substring(upload, 1, 8), F.lit("_"), original).alias("account_id"),
        "customer_id",
        upload.alias("upload_id"),
        cell("account_number").alias("account_number"),
        F.coalesce(cell("account_type"), F.lit("Savings")).alias("account_type"),
        F.coalesce(cell("status"), F.lit("Active")).alias("account_status"),
        F.coalesce(cell("currency"), F.lit("GBP")).alias("currency_code"),
        opened.alias("account_open_date"),
        F.coalesce(cell("risk_rating"), F.lit("LOW")).alias("risk_rating"),
        F.lit(False).alias("is_pep"),
        F.coalesce(to_number(cell("balance"), "decimal(18,2)"), F.lit(0).cast("decimal(18,2)")).alias("current_balance"),
        original.alias("original_account_id"),
    )


def flatten_payload(df: DataFrame, fields: Sequence[str], payload: str = "raw_data") -> DataFrame:
    """Payload fields as columns beside the system columns; known dates and numbers typed, failures null."""
    parsed = F.from_json(F.col(payload), T.MapType(T.StringType(), T.StringType()))
    system = [name for name in SYSTEM_COLUMNS if name in df.columns]
    rows = df.select(*system, parsed.alias("_payload"))
    columns = []
    for name in fields:
        if name in system:
            continue
        cell = F.try_element_at("_payload", F.lit(name))
        if name in PAYLOAD_DATES:
            cell = F.coalesce(parsed_date(cell), cell.try_cast("timestamp"))
        elif name in PAYLOAD_NUMBERS:
            cell = to_number(F.trim(cell))
        columns.append(cell.alias(name))
    return rows.select(*system, *columns)


def ingest(df: DataFrame, profile: str, upload_id: str, date_column: str = "transaction_date") -> tuple[str, DataFrame, DataFrame]:
    """A file from header to typed rows: kind, good rows, rejects.

    Peak files keep their ids and header; grouped files get a normal header and tenant-unique customer ids.
    """
    kind = kind_of(df.columns)
    rows = normal_header(df) if profile == "grouped" else df.toDF(*[c.strip().lower() for c in df.columns])
    rows = apply_aliases(rows, profile, kind)
    ids = list(ID_ALIASES[(profile, kind)])
    if profile == "peak" and kind == TRANSACTIONS:
        rows = fill_missing_ids(rows)
    good, rejects = key_check(rows, ids)
    if kind == TRANSACTIONS and "date" in good.columns and date_column not in good.columns:
        good = good.withColumnRenamed("date", date_column)
    plain = [c for c in good.columns if c not in ids and c != date_column]
    good = cast_cells(good, column_types(good, plain))
    if kind == TRANSACTIONS and date_column in good.columns:
        # Peak files accept the listed notations only; grouped files any timestamp text.
        lenient = [present("_text").try_cast("timestamp")] if profile == "grouped" else []
        typed = good.withColumn("_text", F.col(date_column)).withColumn(
            date_column, F.coalesce(parsed_date(present("_text")), *lenient)
        )
        unread = typed.filter(F.col(date_column).isNull())
        rejects = rejects.unionByName(
            unread.select(*ids, F.concat(F.lit("Unreadable date: "), F.coalesce("_text", F.lit(""))).alias("error")),
            allowMissingColumns=True,
        )
        good = typed.filter(F.col(date_column).isNotNull()).drop("_text")
    if profile == "grouped":
        good = tenant_ids(good, upload_id)
    return kind, finite(good).withColumn("upload_id", F.lit(upload_id)), rejects
