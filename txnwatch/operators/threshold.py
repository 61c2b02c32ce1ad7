"""Thresholds of both dialects as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnwatch.functions.expressions import FormulaError, formula
from txnwatch.rules import Threshold

NEVER = float("inf")


def _reference(name: str, columns: Sequence[str]) -> Column:
    """The reference field as a number, 0 when the customer lacks it, null when it is not a number."""
    if name not in columns:
        return F.lit(0.0)
    return F.when(F.col(name).isNull(), F.lit(0.0)).otherwise(F.col(name).try_cast("double"))


def dynamic(config: Threshold, columns: Sequence[str]) -> Column:
    """E5: the formula within its bounds and not below 0; the fallback when it cannot be evaluated.

    The formula may name ``reference_field`` or, in the older spelling, ``customer.<field>``.
    """
    fallback = F.lit(config.fallback)
    if not config.reference_field or not config.formula:
        return fallback
    names = {name: _reference(name, columns) for name in columns}
    names["reference_field"] = _reference(config.reference_field, columns)
    names.setdefault(config.reference_field, names["reference_field"])
    try:
        value = formula(config.formula, names).cast("double")
    except FormulaError:
        return fallback
    bounded = value
    if config.minimum is not None:
        bounded = F.greatest(F.lit(config.minimum), bounded)
    if config.maximum is not None:
        bounded = F.least(F.lit(config.maximum), bounded)
    return F.when(value.isNull(), fallback).otherwise(F.greatest(F.lit(0.0), bounded))


def by_segment(config: Threshold, columns: Sequence[str]) -> Column:
    """First segment equal after trimming and lowering; a customer outside all segments never alerts."""
    if not config.segment_field or not config.segments:
        return F.lit(NEVER)
    known = config.segment_field in columns
    segment = F.lower(F.trim(F.coalesce(F.col(config.segment_field).cast("string"), F.lit("")))) if known else F.lit("")
    chain = None
    for name, value in config.segments:
        test = segment == name
        chain = F.when(test, F.lit(value)) if chain is None else chain.when(test, F.lit(value))
    return chain.otherwise(F.lit(NEVER))


def by_segment_map(config: Threshold, columns: Sequence[str]) -> Column:
    """Exact lookup of the customer's segment, the default otherwise."""
    default = F.lit(config.default or 0.0)
    if config.segment_field not in columns or not config.segments:
        return default
    pairs = [F.lit(item) for pair in config.segments for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(config.segment_field).cast("string")), default)


def by_field(config: Threshold, columns: Sequence[str]) -> Column:
    """Arithmetic over the reference field; 0 when it cannot be evaluated."""
    known = config.reference_field in columns
    reference = F.col(config.reference_field).try_cast("double") if known else F.lit(0.0)
    try:
        return F.coalesce(formula(config.formula, {"reference_field": reference}).cast("double"), F.lit(0.0))
    except FormulaError:
        return F.lit(0.0)


def threshold_column(config: Threshold | None, columns: Sequence[str]) -> Column | None:
    """The threshold of a rule, given the columns the row has; None when the rule has no threshold."""
    if config is None:
        return None
    if config.kind == "fixed":
        return F.lit(float(config.fixed))
    return {"dynamic": dynamic, "segment": by_segment, "segment_based": by_segment_map, "field_based": by_field}[
        config.kind
    ](config, columns)
