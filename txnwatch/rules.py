"""Detection rules: one normalised object for both config dialects.

``peak`` rules look for the strongest forward window of each customer; ``grouped`` rules aggregate by
keys, calendar buckets or trailing windows. The JSON spellings of the two dialects are accepted side
by side (``method``/``function``, ``segment_based``/``segment``, ``excluded_events`` inside or outside
``config``). Rules are checked on the driver before any data is read.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from txnwatch.functions.expressions import FormulaError, names_in

PEAK = "peak"
GROUPED = "grouped"
DEFAULT_WINDOW_DAYS = 30
DEFAULT_FIELD = "transaction_amount"
FUNCTIONS = ("sum", "count", "avg", "max", "min")


class RuleError(ValueError):
    """The rule cannot be run as written."""


@dataclass(frozen=True)
class TimeWindow:
    value: int
    unit: str
    kind: str

    @property
    def micros(self) -> int:
        """Length on the time axis; a month of a trailing window counts 30 days."""
        hours = {"hours": 1, "days": 24, "months": 24 * 30}[self.unit]
        return self.value * hours * 3_600_000_000


@dataclass(frozen=True)
class Threshold:
    kind: str
    fixed: float = 0.0
    segment_field: str | None = None
    segments: tuple[tuple[str, float], ...] = ()
    default: float | None = None
    reference_field: str | None = None
    formula: str | None = None
    fallback: float = 50000.0
    minimum: float | None = None
    maximum: float | None = None


@dataclass(frozen=True)
class Refinement:
    rule_id: str
    events: tuple[str, ...]
    kind: str = "event_based"
    enabled: bool = True


@dataclass(frozen=True)
class Rule:
    scenario_id: str
    scenario_name: str
    profile: str
    filters: Any = ()
    function: str = "sum"
    value_field: str = DEFAULT_FIELD
    group_by: tuple[str, ...] = ("customer_id",)
    window_days: int = DEFAULT_WINDOW_DAYS
    time_window: TimeWindow | None = None
    min_transactions: int | None = None
    threshold: Threshold | None = None
    expression: str | None = None
    conditions: tuple[Mapping[str, Any], ...] = ()
    refinements: tuple[Refinement, ...] = ()
    metadata: Mapping[str, Any] = field(default_factory=dict)
    enrichment: Mapping[str, bool] = field(default_factory=dict)
    mapping: Mapping[str, str] = field(default_factory=dict)

    def resolve(self, name: str) -> str:
        """A field name through the rule's mapping, at the time it is used."""
        return self.mapping.get(name, name)


def _floats(value: Any, what: str) -> float:
    try:
        return float(value)
    except (TypeError, ValueError) as error:
        raise RuleError(f"{what} must be a number, got {value!r}") from error


def _optional(value: Any, what: str) -> float | None:
    return None if value is None else _floats(value, what)


def _threshold(config: Mapping[str, Any] | None, profile: str) -> Threshold | None:
    if config is None:
        return None if profile == GROUPED else Threshold("fixed", 0.0)
    kind = config.get("type", "fixed")
    if kind == "dynamic":
        part = config.get("dynamic") or {}
        return Threshold(
            "dynamic",
            reference_field=part.get("reference_field") or None,
            formula=part.get("formula") or None,
            fallback=_floats(part.get("fallback_value", 50000), "fallback_value"),
            minimum=_optional(part.get("min_threshold"), "min_threshold"),
            maximum=_optional(part.get("max_threshold"), "max_threshold"),
        )
    if kind == "segment":
        part = config.get("segment") or {}
        values = tuple(
            (str(v.get("segment", "")).strip().lower(), _floats(v.get("threshold", 10000), "threshold"))
            for v in part.get("values", ())
        )
        return Threshold("segment", segment_field=part.get("field") or None, segments=values)
    if kind == "segment_based":
        part = config.get("segment_based") or {}
        values = tuple((str(k), _floats(v, "segment value")) for k, v in (part.get("values") or {}).items())
        return Threshold(
            "segment_based",
            segment_field=part.get("segment_field"),
            segments=values,
            default=_floats(part.get("default", 0), "default"),
        )
    if kind == "field_based":
        part = config.get("field_based") or {}
        return Threshold(
            "field_based",
            reference_field=part.get("reference_field"),
            formula=part.get("calculation") or "reference_field",
        )
    if kind == "fixed" or profile == PEAK:
        fixed = config.get("fixed_value", 0 if profile == PEAK else None)
        return Threshold("fixed", _floats(fixed, "fixed_value"))
    raise RuleError(f"unknown threshold type {kind!r}")


def _refinement(config: Mapping[str, Any]) -> Refinement:
    inner = config.get("config") or {}
    events = config.get("excluded_events") or inner.get("excluded_events") or ()
    return Refinement(
        rule_id=str(config.get("rule_id") or inner.get("rule_id") or "unknown"),
        events=tuple(events),
        kind=config.get("type", "event_based"),
        enabled=bool(config.get("enabled", True)),
    )


def make_rule(
    scenario_id: str,
    config: Mapping[str, Any],
    profile: str | None = None,
    scenario_name: str | None = None,
    mapping: Mapping[str, str] | None = None,
) -> Rule:
    """Read either dialect; without ``profile`` a ``method`` or ``group_by`` marks a grouped rule."""
    aggregation = config.get("aggregation") or {}
    if profile is None:
        profile = config.get("profile") or (
            GROUPED if "method" in aggregation or "group_by" in aggregation else PEAK
        )
    if profile not in (PEAK, GROUPED):
        raise RuleError(f"unknown profile {profile!r}")
    function = aggregation.get("function") or aggregation.get("method") or "sum"
    function = {"mean": "avg"}.get(function, function)
    if function not in FUNCTIONS:
        if profile == GROUPED:
            raise RuleError(f"unknown aggregation {function!r}")
        function = "sum"
    window = aggregation.get("time_window") if profile == GROUPED else None
    time_window = None
    if window:
        time_window = TimeWindow(int(window.get("value", 1)), window.get("unit", "days"), window.get("type", "rolling"))
        if time_window.unit not in ("hours", "days", "months") or time_window.kind not in ("rolling", "calendar"):
            raise RuleError(f"unknown time window {window!r}")
        if time_window.value < 1:
            raise RuleError("a time window must be positive")
    counting = aggregation.get("count_threshold") or {}
    condition = config.get("alert_condition") or {}
    rule = Rule(
        scenario_id=scenario_id,
        scenario_name=scenario_name or config.get("scenario_name") or scenario_id,
        profile=profile,
        filters=config.get("filters") or (),
        function=function,
        value_field=aggregation.get("field") or DEFAULT_FIELD,
        group_by=tuple(aggregation.get("group_by") or ("customer_id",)),
        window_days=int(aggregation.get("rolling_window_days") or DEFAULT_WINDOW_DAYS),
        time_window=time_window,
        min_transactions=int(counting.get("min_transactions", 1)) if counting.get("enabled") else None,
        threshold=_threshold(config.get("threshold"), profile),
        expression=condition.get("expression") or None,
        conditions=tuple(condition.get("additional_conditions") or ()),
        refinements=tuple(_refinement(r) for r in config.get("refinements") or ()),
        metadata=config.get("alert_metadata") or {},
        enrichment=config.get("enrichment") or {},
        mapping=mapping or config.get("field_mappings") or {},
    )
    if rule.window_days < 1:
        raise RuleError("rolling_window_days must be positive")
    return rule


def map_rule(rule: Rule, mapping: Mapping[str, str]) -> Rule:
    """B2: rewrite the field names of a rule instead of renaming the data."""

    def rename(item: Any) -> Any:
        if isinstance(item, Mapping):
            return {
                key: mapping.get(value, value) if key == "field" and isinstance(value, str) else rename(value)
                for key, value in item.items()
            }
        if isinstance(item, (list, tuple)):
            return [rename(value) for value in item]
        return item

    threshold = rule.threshold
    if threshold and threshold.segment_field:
        threshold = replace(threshold, segment_field=mapping.get(threshold.segment_field, threshold.segment_field))
    return replace(
        rule,
        filters=rename(rule.filters),
        value_field=mapping.get(rule.value_field, rule.value_field),
        group_by=tuple(mapping.get(name, name) for name in rule.group_by),
        threshold=threshold,
    )


def filter_list(rule: Rule) -> list[Mapping[str, Any]]:
    """The field filters of a rule; the typed filter object keeps its own under ``custom_field_filters``."""
    if isinstance(rule.filters, Mapping):
        return list(rule.filters.get("custom_field_filters") or ())
    return list(rule.filters)


def required_fields(rules: Iterable[Rule]) -> set[str]:
    """H4: every field the rules read, without the ``customer.`` prefix."""
    found: set[str] = set()
    for rule in rules:
        found.update(str(f["field"]) for f in filter_list(rule) if f.get("field"))
        found.add(rule.value_field)
        if rule.profile == GROUPED:
            found.update(rule.group_by)
        if rule.threshold:
            found.update(n for n in (rule.threshold.segment_field, rule.threshold.reference_field) if n)
    return {name.removeprefix("customer.") for name in found}


def schema_check(
    rules: Iterable[Rule], transaction_fields: Sequence[str], customer_fields: Sequence[str]
) -> list[dict[str, Any]]:
    """H4: required fields with the table that has them and whether a mapping is needed."""
    return [
        {
            "field": name,
            "source": "transaction" if name in transaction_fields else "customer" if name in customer_fields else None,
            "missing": name not in transaction_fields and name not in customer_fields,
        }
        for name in sorted(required_fields(rules))
    ]


# Fields an entity must have before rules can run on it.
REQUIRED_BY_ENTITY = {
    "transaction": ["transaction_id", "customer_id", "transaction_date", "transaction_amount"],
    "customer": ["customer_id", "customer_name"],
}


def mapping_gaps(mapping: Mapping[str, str], entity: str) -> list[str]:
    """Required fields of the entity the mapping does not cover."""
    return [name for name in REQUIRED_BY_ENTITY.get(entity, []) if name not in mapping]


# Customer fields always joined by grouped rules, and the names looked for in texts.
ALWAYS_JOINED = ("account_type", "annual_income", "risk_score", "occupation", "customer_name")
TEXT_NAMES = ("customer_type", "occupation", "annual_income", "risk_score")


def customer_fields_of(rule: Rule, customer_columns: Sequence[str], transaction_columns: Sequence[str]) -> list[str]:
    """Customer columns the rule reads, plus the ones alerts always show."""
    wanted = set(ALWAYS_JOINED)
    for item in filter_list(rule):
        name = rule.resolve(str(item.get("field") or ""))
        if name.startswith("customer.") or name not in transaction_columns or name.startswith("customer_"):
            wanted.add(name.removeprefix("customer."))
    wanted.update(name for name in rule.group_by if name not in transaction_columns or name.startswith("customer_"))
    if rule.threshold:
        wanted.update(n for n in (rule.threshold.segment_field, rule.threshold.reference_field) if n)
    for text in (rule.expression, rule.threshold.formula if rule.threshold else None):
        if text:
            try:
                read = names_in(text)
            except FormulaError:
                read = set()
            wanted.update(read | {name for name in TEXT_NAMES if name in text})
    if isinstance(rule.filters, Mapping) and rule.filters.get("customer_type"):
        wanted.add("customer_type")
    return [name for name in customer_columns if name in wanted and name != "customer_id"]
