"""Helpers for one-row results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row(parts: Sequence[DataFrame]) -> DataFrame:
    """One-row tables with different columns as a single row."""
    both = reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)
    return both.agg(*[F.max(name).alias(name) for name in both.columns])
