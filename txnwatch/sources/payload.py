"""JSON payloads of any shape as typed columns.

A payload is read once into Spark's VARIANT, so numbers, truth values, lists and objects keep their types and fields
need not be listed beforehand. The shape of all payloads is one aggregate: a merged schema, as large as the number of
different keys, is what reaches the driver.

Defined cases: a payload that is null, not JSON, not an object, larger than a VARIANT can be, or has a key twice in one object gives
null in every field (``payload_quality`` counts them). Whole numbers and fractions under one key become a decimal, decimals
and floating numbers a double; any other mixture of kinds becomes text, JSON text for lists and objects. A key that
is always null is text. Keys that are equal but for their case, or equal to a column that is kept, get a number behind their name.
"""

from __future__ import annotations

import re
from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnwatch.functions.rows import one_row
from txnwatch.functions.text import to_number
from txnwatch.operators.profile import parsed_date
from txnwatch.sources.ingest import PAYLOAD_DATES, PAYLOAD_NUMBERS, SYSTEM_COLUMNS

# In the merged schema names are quoted where needed; only words outside of quotes are kinds.
KINDS = re.compile(r"`(?:[^`]|``)*`|\bOBJECT<|\bVARIANT\b|\bVOID\b")
AS_COLUMNS = {"OBJECT<": "STRUCT<", "VARIANT": "STRING", "VOID": "STRING"}


def _parsed(df: DataFrame, payload: str) -> DataFrame:
    """The readable payloads as column ``_v``, null where there is no object."""
    value = F.try_parse_json(F.col(payload).cast("string"))
    return df.withColumn("_v", F.when(F.substring(F.ltrim(F.col(payload).cast("string")), 1, 1) == "{", value))


def payload_schema(df: DataFrame, payload: str = "raw_data") -> T.StructType:
    """H1: every key of every payload with the kind that holds all its values, nested ones included."""
    merged = _parsed(df.select(payload), payload).agg(F.schema_of_variant_agg("_v")).first()[0]
    if not merged.startswith("OBJECT<"):
        return T.StructType([])
    return T.DataType.fromDDL(KINDS.sub(lambda m: AS_COLUMNS.get(m[0], m[0]), merged))


def payload_profile(df: DataFrame, payload: str = "raw_data") -> DataFrame:
    """H1: a row per key: field_name, kind (merged), payloads that have the key, and how many of these hold null."""
    spark = df.sparkSession
    rows = _parsed(df.select(payload), payload).filter(F.col("_v").isNotNull()).select("_v")
    each = rows.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).filter(F.col("key").isNotNull())
    kind = F.regexp_replace(F.schema_of_variant_agg("value"), "^VARIANT$", "MIXED")
    return each.groupBy(F.col("key").alias("field_name")).agg(
        kind.alias("kind"), F.count(F.lit(1)).alias("payloads"), F.count_if(F.is_variant_null("value")).alias("nulls")
    )


def payload_quality(df: DataFrame, payload: str = "raw_data") -> DataFrame:
    """One row: payloads that are null, readable as an object, and not."""
    rows = _parsed(df.select(payload), payload)
    missing = F.col(payload).isNull()
    return one_row(
        [
            rows.agg(
                F.count_if(missing).alias("missing"),
                F.count_if(F.col("_v").isNotNull()).alias("readable"),
                F.count_if(~missing & F.col("_v").isNull()).alias("unreadable"),
            )
        ]
    )


def _distinct_names(names: Collection[str], taken: Collection[str]) -> list[str]:
    """The names, with a number behind those that Spark could not tell from an earlier one."""
    seen, out = {t.lower() for t in taken}, []
    for name in names:
        new, k = name, 1
        while new.lower() in seen:
            k += 1
            new = f"{name}_{k}"
        seen.add(new.lower())
        out.append(new)
    return out


def flatten_any(df: DataFrame, payload: str = "raw_data", schema: T.StructType | None = None) -> DataFrame:
    """All payload fields as columns beside the system columns, in the types of ``payload_schema`` (found if not given).

    The payload is parsed once per row. Fields known to be dates or numbers are typed from text, failures null. A payload
    field with the name of a system column that is there gives way to it.
    """
    system = [name for name in SYSTEM_COLUMNS if name in df.columns]
    found = schema if schema is not None else payload_schema(df, payload)
    fields = [f for f in found.fields if f.name not in system]
    if not fields:
        return df.select(*system)
    known = {*PAYLOAD_DATES, *PAYLOAD_NUMBERS}
    wanted = T.StructType([T.StructField(f.name, T.StringType() if f.name in known else f.dataType) for f in fields])
    cells = F.try_variant_get("_v", F.lit("$"), _ddl(wanted))
    names = _distinct_names([f.name for f in fields], system)
    # Columns by position: keys may differ in case only.
    flat = _parsed(df.select(*system, payload), payload).select(*system, F.inline(F.array(cells))).toDF(*system, *names)
    typed = {}
    for f, name in zip(fields, names, strict=True):
        cell = F.col(f"`{name.replace('`', '``')}`")
        if f.name in PAYLOAD_DATES:
            typed[name] = F.coalesce(parsed_date(cell), cell.try_cast("timestamp"))
        elif f.name in PAYLOAD_NUMBERS:
            typed[name] = to_number(F.trim(cell))
    return flat.withColumns(typed) if typed else flat


def _ddl(kind: T.DataType) -> str:
    """A type as text, with every field name quoted."""
    if isinstance(kind, T.StructType):
        return "struct<" + ",".join(f"`{f.name.replace('`', '``')}`:{_ddl(f.dataType)}" for f in kind.fields) + ">"
    if isinstance(kind, T.ArrayType):
        return f"array<{_ddl(kind.elementType)}>"
    return kind.simpleString()
