"""Scores and levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnwatch.functions.text import col

# Amount from which a grouped alert gets the score, highest first; below all of them 25.
AMOUNT_BANDS = ((100000, 85), (50000, 70), (20000, 55), (10000, 40))
LOWEST_BAND = 25


def band_score(value: str | Column) -> Column:
    """Score by aggregated amount."""
    chain = None
    for bound, score in AMOUNT_BANDS:
        test = col(value) >= bound
        chain = F.when(test, score) if chain is None else chain.when(test, score)
    return chain.otherwise(LOWEST_BAND)


def ratio_score(value: str | Column, threshold: str | Column) -> Column:
    """How far the value exceeds the threshold, 50 when equal, at most 100; 50 for a threshold of 0."""
    ratio = F.try_divide(col(value), col(threshold)) * 50
    return F.when(col(threshold) > 0, F.least(F.lit(100.0), F.floor(ratio)).cast("int")).otherwise(50)


def score_class(score: str | Column) -> Column:
    """Classification of a grouped alert."""
    return F.when(col(score) >= 70, "HIGH").when(col(score) >= 40, "MEDIUM").otherwise("LOW")


def gap_level(score: str | Column) -> Column:
    """Level of a summed suppression risk."""
    return (
        F.when(col(score) > 60, "CRITICAL").when(col(score) > 30, "DANGEROUS").when(col(score) > 0, "CAUTION").otherwise("SAFE")
    )
