"""Writing results as CSV (A19, A20); runs are written by ``state.write_run``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Struct, map and array columns as JSON text, for formats without nesting."""
    nested = (T.StructType, T.MapType, T.ArrayType)
    return df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def write_csv(df: DataFrame, folder: str) -> None:
    """A table as CSV with header, in as many parts as Spark has tasks."""
    flat(df).write.mode("overwrite").csv(folder, header=True, quote='"', escape='"', emptyValue="")
