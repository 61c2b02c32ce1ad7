"""Two runs compared from their ids: summary, differences per customer, exposure and efficiency."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.operators.compare import diff_grouped, diff_peak, efficiency, exposure, latest_run, summary_grouped, summary_peak
from txnwatch.operators.skew import stored
from txnwatch.rules import PEAK


@dataclass
class Comparison:
    """The parts of a comparison; ``efficiency`` is one row about the grouped profile's figures."""

    summary: DataFrame
    diff: DataFrame
    risk: DataFrame
    efficiency: DataFrame


def alerts_of(alerts: DataFrame, runs: DataFrame, identifier: str) -> DataFrame:
    """The alerts of the run that the identifier names, by its id or as the latest run of a rule."""
    chosen = latest_run(runs, identifier).select("run_id")
    return alerts.join(F.broadcast(chosen), "run_id", "left_semi")  # at most one row


def compare_runs(
    alerts: DataFrame,
    runs: DataFrame,
    baseline: str,
    refined: str,
    profile: str = PEAK,
    links: DataFrame | None = None,
    transactions: DataFrame | None = None,
    limit: int | None = None,
) -> Comparison:
    """Resolve both runs and compare them; the grouped profile needs ``links`` and ``transactions``.

    The differences are stored once, as the exposure ranks them again. ``limit`` keeps the profile's top list.
    """
    old, new = alerts_of(alerts, runs, baseline), alerts_of(alerts, runs, refined)
    if profile == PEAK:
        diff = stored(diff_peak(old, new, limit), "diff")
        risk = exposure(diff)
        summary = summary_peak(old, new)
    else:
        if links is None or transactions is None:
            raise ValueError("a grouped comparison needs links and transactions")
        diff = stored(diff_grouped(old, new, links, transactions, limit), "diff")
        risk = exposure(diff, "max_risk_score", "total_amount")
        summary = summary_grouped(old, new)
    return Comparison(summary, diff, risk, efficiency(summary_grouped(old, new), risk))
