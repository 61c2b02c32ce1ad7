"""A run: several rules over one dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.operators.aggregate import contributions
from txnwatch.operators.alerts import union_alerts
from txnwatch.operators.filters import in_date_range
from txnwatch.operators.mapping import map_columns
from txnwatch.operators.refine import exclusion_log, refine, refine_rules
from txnwatch.operators.skew import UNKNOWN, Hot, hot_groups, list_join, stored
from txnwatch.plans.grouped import grouped_alert_links, grouped_alerts
from txnwatch.plans.peak import peak_alerts, peak_links
from txnwatch.plans.together import fits, grouped_alerts_of, grouped_links_of, peak_alerts_of, peak_links_of
from txnwatch.rules import GROUPED, PEAK, Rule, RuleError, make_rule

COMMON = [
    "alert_id", "run_id", "scenario_id", "scenario_name", "scenario_description", "customer_id", "customer_name",
    "alert_date", "alert_status", "aggregated_value", "threshold", "transaction_count", "risk_score",
    "risk_classification", "trigger_reason", "trigger_details", "excluded", "exclusion_reason", "exclusion_rule_id",
    "risk_flags",
]

# What suppression adds to an alert.
MARKS = ("excluded", "exclusion_reason", "exclusion_rule_id", "risk_flags")


@dataclass
class RunResult:
    """Tables of a run, and the rules that could not be run with the reason."""

    alerts: DataFrame | None
    alert_transactions: DataFrame | None
    exclusion_logs: DataFrame | None
    rejected: dict[str, str] = field(default_factory=dict)
    run_id: str = ""
    scenarios: tuple[str, ...] = ()

    def record(self, now: Any, upload_id: str | None = None) -> DataFrame:
        """One row about the run: its rules, status, and how many alerts are there and excluded.

        A run without a single rule that works has status failed.
        """
        spark = SparkSession.active()
        if self.alerts is None:
            counts = spark.range(1).select(F.lit(0).cast("long").alias("total_alerts"), F.lit(0).cast("long").alias("excluded_alerts"))
        else:
            counts = self.alerts.agg(F.count(F.lit(1)).alias("total_alerts"), F.count_if("excluded").alias("excluded_alerts"))
        return counts.select(
            F.lit(self.run_id).alias("run_id"),
            F.lit(upload_id).cast("string").alias("upload_id"),
            F.lit(now).cast("timestamp").alias("created_at"),
            F.lit("failed" if self.alerts is None else "completed").alias("status"),
            F.array(*[F.lit(s) for s in self.scenarios]).cast("array<string>").alias("scenarios_run"),
            F.array(*[F.lit(s) for s in sorted(self.rejected)]).cast("array<string>").alias("scenarios_rejected"),
            "total_alerts",
            "excluded_alerts",
        )

    def tables(self) -> dict[str, DataFrame]:
        named = {
            "alerts": self.alerts,
            "alert_transactions": self.alert_transactions,
            "alert_exclusion_logs": self.exclusion_logs,
        }
        return {name: df for name, df in named.items() if df is not None}


def rule_alerts(transactions: DataFrame, customers: DataFrame, rule: Rule, run_id: str, hot: Hot = UNKNOWN) -> DataFrame:
    """Alerts of one rule before suppression."""
    make = peak_alerts if rule.profile == PEAK else grouped_alerts
    return make(transactions, customers, rule, run_id, hot)


def rule_links(
    transactions: DataFrame, customers: DataFrame, alerts: DataFrame, rule: Rule, hot: Hot = UNKNOWN
) -> DataFrame:
    """The transactions behind the alerts of one rule."""
    make = peak_links if rule.profile == PEAK else grouped_alert_links
    return make(transactions, customers, alerts, rule, hot)


def _shaped(alerts: DataFrame) -> DataFrame:
    """Alerts of either dialect in one shape: details, metadata and context as one JSON text."""
    extras = [c for c in ("alert_metadata", "enrichment_data") if c in alerts.columns]
    details = F.to_json("trigger_details")
    if extras:
        details = F.to_json(F.struct("trigger_details.*", *extras))
    return alerts.withColumns(
        {
            "trigger_details": details,
            "scenario_description": F.concat(F.lit("Generated by "), F.col("scenario_name")),
            "alert_status": F.lit("OPN"),
            "threshold": F.col("threshold").cast("double"),
        }
    )


def common_alerts(alerts: DataFrame) -> DataFrame:
    """One shape for marked alerts of both dialects."""
    return _shaped(alerts).select(*COMMON)


def _whitelist(transactions: DataFrame, whitelist: DataFrame | None) -> DataFrame:
    """Without a whitelist nothing is verified; loans and deposits need none."""
    if whitelist is None:
        return transactions.sparkSession.createDataFrame([], "entity_name string, entity_type string, is_active boolean")
    return whitelist


def _alone(
    transactions: DataFrame, customers: DataFrame, rule: Rule, run_id: str, whitelist: DataFrame, hot: Hot, with_links: bool
) -> tuple[DataFrame, DataFrame | None]:
    """Alerts and links of one rule in plans of its own."""
    alerts = rule_alerts(transactions, customers, rule, run_id, hot)
    if with_links or rule.refinements:
        # Links, suppression and the result read the alerts, so they are computed once.
        alerts = stored(alerts, "alerts")
    marked = refine(alerts, transactions, whitelist, rule.refinements, profile=rule.profile, hot=hot)
    if not with_links:
        return common_alerts(marked), None
    return common_alerts(stored(marked, "marked")), stored(contributions(rule_links(transactions, customers, alerts, rule, hot)), "links")


def _together(
    transactions: DataFrame, customers: DataFrame, rules: Sequence[Rule], run_id: str, whitelist: DataFrame, hot: DataFrame | None, with_links: bool
) -> tuple[DataFrame, DataFrame | None]:
    """Alerts and links of many rules, with scans and exchanges that do not depend on their number."""
    numbered = dict(enumerate(rules))
    refined = {i: (rule.refinements, rule.profile) for i, rule in numbered.items()}
    kept = with_links or any(rule.refinements for rule in rules)
    parts, behind = [], []
    for profile, alerts_of, links_of in ((PEAK, peak_alerts_of, peak_links_of), (GROUPED, grouped_alerts_of, grouped_links_of)):
        some = {i: rule for i, rule in numbered.items() if rule.profile == profile}
        if not some:
            continue
        alerts = alerts_of(transactions, customers, some, run_id, hot)
        if kept:
            alerts = stored(alerts, "alerts")
        parts.append(_shaped(alerts).select("_rule", *[c for c in COMMON if c not in MARKS]))
        if with_links:
            links = links_of(transactions, customers, alerts, some, hot)
            behind.append(links.select("alert_id", *[c for c in ("transaction_id", "upload_id", "transaction_date", "transaction_amount") if c in transactions.columns]))
    marked = refine_rules(union_alerts(parts), transactions, whitelist, refined, hot=hot).select(*COMMON)
    if not with_links:
        return marked, None
    return stored(marked, "marked"), stored(contributions(union_alerts(behind)), "links")


def run_rules(
    configs: Mapping[str, Mapping[str, Any]],
    transactions: DataFrame,
    customers: DataFrame,
    run_id: str,
    whitelist: DataFrame | None = None,
    mapping: Mapping[str, str] | None = None,
    start: Any = None,
    end: Any = None,
    with_links: bool = True,
    uploads: DataFrame | None = None,
    together: bool = True,
) -> RunResult:
    """Alerts of all rules, over the datasets of ``uploads`` (column upload_id) if given; a rule that cannot be read, planned or stored contributes nothing and is reported.

    The run's mapping and date range apply once (B4, B19). A peak rule's own mapping applies when it
    uses a field (B3), a grouped rule's to the data after the run's (B4). Rules share one pass over the data where they can
    (``plans.together``); the others, and all of them if the shared pass fails, run alone, so failures stay with their rule.
    With links or refinements alerts and links are stored. Without a whitelist nothing is verified.
    """
    if uploads is not None:
        # A run over chosen datasets: one upload, those of a user, or the active ones.
        chosen = uploads.select("upload_id").distinct()
        transactions, customers = (list_join(df, chosen, ["upload_id"]) for df in (transactions, customers))
    txns = in_date_range(map_columns(transactions, mapping), start, end)
    people = map_columns(customers, mapping)
    # Hot customers are counted once for all rules.
    shared = hot_groups(txns, ["customer_id"])
    known = _whitelist(transactions, whitelist)
    alerts, links, rejected, one_by_one, sharing = [], [], {}, {}, {}
    for scenario_id, config in configs.items():
        try:
            rule = make_rule(scenario_id, config)
            (sharing if together and fits(rule, txns, people) else one_by_one)[scenario_id] = rule
        except (RuleError, TypeError, ValueError, KeyError, PySparkException) as error:
            rejected[scenario_id] = str(error).split("\n")[0]
    if sharing:
        try:
            found = _together(txns, people, list(sharing.values()), run_id, known, shared, with_links)
            alerts.append(found[0])
            links += [found[1]] if with_links else []
        except (RuleError, TypeError, ValueError, KeyError, PySparkException):
            one_by_one |= sharing
    for scenario_id, rule in one_by_one.items():
        try:
            rows, owners, hot = txns, people, shared
            if rule.profile == GROUPED and rule.mapping:
                # A grouped rule's own mapping renames the data, so that keys and thresholds follow it too.
                rows, owners = map_columns(txns, rule.mapping), map_columns(people, rule.mapping)
                hot = UNKNOWN if "customer_id" in rule.mapping else shared
                rule = replace(rule, mapping={})
            # One bad rule must not cost the others their alerts.
            found = _alone(rows, owners, rule, run_id, known, hot, with_links)
        except (RuleError, TypeError, ValueError, KeyError, PySparkException) as error:
            rejected[scenario_id] = str(error).split("\n")[0]
            continue
        alerts.append(found[0])
        links += [found[1]] if with_links else []
    if not alerts:
        return RunResult(None, None, None, rejected, run_id, tuple(configs))
    everything = union_alerts(alerts)
    return RunResult(everything, union_alerts(links) if links else None, exclusion_log(everything), rejected, run_id, tuple(configs))


def sample_customers(customers: DataFrame, size: int = 20) -> DataFrame:
    """The first customers by id, for a trial run."""
    return customers.select("customer_id").distinct().orderBy("customer_id").limit(size)


def dry_run_grouped(
    transactions: DataFrame, customers: DataFrame, rule: Rule, size: int = 20, samples: int = 5
) -> tuple[DataFrame, DataFrame]:
    """A rule on the first customers only: an estimate of the volume, and sample alerts.

    The estimate scales the alerts of the sample to all customers, with half again on top.
    """
    chosen = sample_customers(customers, size)
    some = transactions.join(F.broadcast(chosen), "customer_id", "left_semi")
    alerts = rule_alerts(some, customers.join(F.broadcast(chosen), "customer_id", "left_semi"), rule, "preview_run")
    everyone = customers.agg(F.countDistinct("customer_id").alias("_all"))
    found = alerts.agg(F.count(F.lit(1)).alias("_n"))
    both = found.unionByName(everyone, allowMissingColumns=True).agg(F.max("_n").alias("_n"), F.max("_all").alias("_all"))
    estimate = F.try_divide(F.col("_n").cast("double"), F.least(F.lit(size), F.col("_all"))) * F.col("_all") * 1.5
    report = both.select(
        F.col("_n").alias("alert_count"),
        F.col("_all").alias("sample_size"),
        F.coalesce(F.floor(estimate), F.lit(0)).cast("long").alias("estimated_monthly_volume"),
    )
    shown = alerts.orderBy("alert_date", "customer_id").limit(samples).select(
        "customer_id", "alert_date", "aggregated_value", "transaction_count"
    )
    return report, shown


def dry_run_peak(transactions: DataFrame, customers: DataFrame, rule: Rule, samples: int = 10) -> tuple[DataFrame, DataFrame]:
    """A rule on all data: how many alerts, and the first ones by customer."""
    alerts = rule_alerts(transactions, customers, rule, "preview_run")
    return alerts.agg(F.count(F.lit(1)).alias("alerts_generated")), alerts.orderBy("customer_id").limit(samples)
