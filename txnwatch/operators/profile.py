"""Field discovery, profiles and autocomplete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnwatch.functions.text import title, to_number

INDEX_LIMIT = 1000
SAMPLES = 10

# Operators offered per field type.
RECOMMENDED = {
    "numeric": ["equals", "not_equals", "greater_than", "less_than", "greater_or_equal", "less_or_equal", "between"],
    "date": ["equals", "greater_than", "less_than", "between"],
    "boolean": ["equals"],
    "text": ["equals", "not_equals", "in", "contains", "starts_with", "ends_with"],
}
BOOLEAN_TEXTS = ("true", "false", "1", "0", "yes", "no")
# Accepted date notations in the order they are tried, each with the shape it needs.
DATE_PATTERNS = (
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("yyyy-M-d'T'H:m:s", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"),
    ("yyyy-M-d H:m:s", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
)


def payload_fields(df: DataFrame, payload: str = "raw_data") -> DataFrame:
    """H1: the distinct keys of a JSON payload column."""
    keys = F.explode(F.json_object_keys(F.col(payload).cast("string")))
    return df.select(keys.alias("field_name")).distinct()


def sample_types(schema: T.StructType) -> list[dict[str, str]]:
    """H1, H3: fields with the type of a sample row and a title-cased label; reads only the schema."""
    kinds = []
    for field in schema.fields:
        if isinstance(field.dataType, T.BooleanType):
            kind = "boolean"
        elif isinstance(field.dataType, T.IntegralType):
            kind = "integer"
        elif isinstance(field.dataType, T.NumericType):
            kind = "number"
        else:
            kind = "string"
        kinds.append({"name": field.name, "type": kind, "label": field.name.replace("_", " ").title()})
    return kinds


def parsed_date(text: Column, patterns: Sequence[tuple[str, str]] = DATE_PATTERNS) -> Column:
    """The first pattern that reads the text, else null.

    The shape is tested first, because a parse that fails costs far more than one that succeeds.
    """
    return F.coalesce(*[F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(pattern))) for pattern, shape in patterns])


def value_counts(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Rows per field and value. Counted before the shuffle, so frequent values travel once per task."""
    names = list(fields or df.columns)
    texts = df.select(*[F.col(name).cast("string").alias(name) for name in names])
    long = texts.unpivot([], names, "field_name", "field_value").filter(F.coalesce(F.col("field_value"), F.lit("")) != "")
    return long.groupBy("field_name", "field_value").agg(F.count(F.lit(1)).alias("value_count"))


def recommended_operators(kind: str | Column) -> Column:
    """H7: operators offered for a field type."""
    column = F.col(kind) if isinstance(kind, str) else kind
    chain = None
    for name, operators in RECOMMENDED.items():
        listed = F.array(*[F.lit(op) for op in operators])
        chain = F.when(column == name, listed) if chain is None else chain.when(column == name, listed)
    return chain.otherwise(F.array(*[F.lit(op) for op in RECOMMENDED["text"]]))


def field_types(counts: DataFrame) -> DataFrame:
    """H2: numeric if every value is a number, else date, else boolean, else text; one row per field."""
    value = F.col("field_value")
    numeric = F.min(to_number(F.trim(value)).isNotNull())
    dated = F.min(F.coalesce(parsed_date(value), value.try_cast("timestamp")).isNotNull())
    boolean = F.min(F.lower(value).isin(*BOOLEAN_TEXTS))
    kind = F.when(numeric, "numeric").when(dated, "date").when(boolean, "boolean").otherwise("text")
    return counts.groupBy("field_name").agg(
        kind.alias("field_type"),
        F.sum("value_count").alias("non_null_count"),
        F.count(F.lit(1)).alias("distinct_count"),
    )


def field_metadata(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """Type, totals, nulls, distinct values, operators and the ten smallest values per field."""
    names = list(fields or df.columns)
    counts = value_counts(df, names)
    kinds = field_types(counts)
    place = F.row_number().over(W.partitionBy("field_name").orderBy("field_value"))
    # Each task passes on ten values per field, so this stays small however many values a field has.
    # Counts travel along so that both uses of ``counts`` read one and the same shuffle.
    samples = (
        counts.withColumn("_place", place)
        .filter(F.col("_place") <= SAMPLES)
        .groupBy("field_name")
        .agg(F.array_sort(F.collect_list(F.struct("field_value", "value_count")))["field_value"].alias("sample_values"))
    )
    listed = F.explode(F.array(*[F.lit(name) for name in names])).alias("field_name")
    totals = df.agg(F.count(F.lit(1)).alias("total_records")).select(listed, "total_records")
    joined = totals.join(kinds, "field_name", "left").join(samples, "field_name", "left")
    known = F.coalesce("non_null_count", F.lit(0))
    return joined.select(
        "field_name",
        F.coalesce("field_type", F.lit("text")).alias("field_type"),
        "total_records",
        known.alias("non_null_count"),
        (F.col("total_records") - known).alias("null_count"),
        F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        recommended_operators("field_type").alias("recommended_operators"),
    )


def listable_fields(df: DataFrame, fields: Sequence[str], below: int) -> list[str]:
    """The fields that may have fewer than ``below`` distinct values.

    One sketch per field in a single aggregate: no value is shuffled. A field is left out only if its estimate, off by two percent
    as a rule, is twice the bound; the others are to be counted exactly.
    """
    cells = [F.col(name).cast("string") for name in fields]
    row = df.agg(*[F.approx_count_distinct(F.when(c != "", c), 0.02).alias(f"f{k}") for k, c in enumerate(cells)]).first()
    return [name for k, name in enumerate(fields) if row[f"f{k}"] < 2 * below]


def field_value_index(df: DataFrame, fields: Sequence[str] | None = None, below: int = INDEX_LIMIT) -> DataFrame:
    """Count and share of each value, for fields with fewer than ``below`` distinct values.

    Fields with many more values, such as ids, are found by sketches first and never counted value by value.
    """
    names = listable_fields(df, list(fields or df.columns), below)
    if not names:
        return df.sparkSession.createDataFrame([], "field_name string, field_value string, value_count long, value_percentage double")
    counts = value_counts(df, names)
    listed = F.explode(F.array(*[F.lit(name) for name in names])).alias("field_name")
    totals = df.agg(F.count(F.lit(1)).alias("_total")).select(listed, "_total")
    small = (
        counts.groupBy("field_name")
        .agg(F.count(F.lit(1)).alias("_distinct"), F.sum("value_count").alias("_filled"))
        .filter((F.col("_distinct") < below) & (F.col("_filled") > 0))
        .join(totals, "field_name")
    )
    # One row per column of the table: always small enough to broadcast.
    return counts.join(F.broadcast(small), "field_name").select(
        "field_name",
        "field_value",
        "value_count",
        F.round(F.col("value_count") * 100.0 / F.col("_total"), 2).alias("value_percentage"),
    )


def field_catalogue(df: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """The profile as shown to rule authors."""
    return field_metadata(df, fields).select(
        F.col("field_name").alias("name"),
        F.col("field_type").alias("type"),
        title("field_name").alias("label"),
        F.col("total_records").alias("total"),
        F.col("distinct_count").alias("distinct"),
        F.col("null_count").alias("nulls"),
        F.col("recommended_operators").alias("operators"),
        "sample_values",
    )


def autocomplete(transactions: DataFrame, customers: DataFrame, field: str, search: str = "", limit: int = 20) -> DataFrame:
    """H5: distinct values that contain the search text, from transactions if they have any, else customers."""

    def values(df: DataFrame, place: int) -> DataFrame:
        text = F.col(field).cast("string")
        found = df.select(text.alias("value")).filter(F.lower("value").contains(search.lower())).distinct()
        return found.orderBy("value").limit(limit).withColumn("_place", F.lit(place))

    parts = [values(df, i) for i, df in enumerate((transactions, customers)) if field in df.columns]
    if not parts:
        return transactions.select(F.lit(None).cast("string").alias("value")).limit(0)
    if len(parts) == 1:
        return parts[0].drop("_place")
    # At most ``limit`` rows per table meet here; the first table with a hit wins.
    both = parts[0].unionByName(parts[1])
    first = F.min("_place").over(W.partitionBy())
    return both.withColumn("_first", first).filter(F.col("_place") == F.col("_first")).select("value")


def ranked_values(df: DataFrame, field: str, search: str = "", pool: int = 100, limit: int = 20) -> DataFrame:
    """H6: among the ``pool`` most frequent values, those that contain the search text."""
    index = field_value_index(df, [field])
    top = index.orderBy(F.desc("value_count"), "field_value").limit(pool)
    return (
        top.filter(F.lower("field_value").contains(search.lower()))
        .orderBy(F.desc("value_count"), "field_value")
        .limit(limit)
        .select(F.col("field_value").alias("value"), F.col("value_count").alias("count"), F.col("value_percentage").alias("percentage"))
    )
