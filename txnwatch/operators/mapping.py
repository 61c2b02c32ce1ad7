"""Column mappings between a dataset and the engine's names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def map_columns(df: DataFrame, mapping: Mapping[str, str] | None) -> DataFrame:
    """B1: rename ``{engine name: dataset column}``; an existing engine column gives way, absent columns are ignored."""
    renames = {source: target for target, source in (mapping or {}).items() if source in df.columns and source != target}
    if not renames:
        return df
    gone = [target for target in renames.values() if target in df.columns and target not in renames]
    return df.select(*[F.col(c).alias(renames.get(c, c)) for c in df.columns if c not in gone])


def map_run(df: DataFrame, run_mapping: Mapping[str, str] | None, scenario_mapping: Mapping[str, str] | None) -> DataFrame:
    """The run's mapping first, then the scenario's."""
    return map_columns(map_columns(df, run_mapping), scenario_mapping)
