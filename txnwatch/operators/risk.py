"""Risk of what a refinement suppresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnwatch.functions.scoring import gap_level
from txnwatch.functions.text import money, plain
from txnwatch.operators.enrich import first_per_key
from txnwatch.operators.refine import with_verification
from txnwatch.operators.skew import skew_join
from txnwatch.rules import Refinement

# Points per finding.
EDUCATION_LIMIT, EDUCATION_POINTS = 50000, 15.0
CRYPTO_LIMIT, CRYPTO_POINTS = 10000, 20.0
UNVERIFIED_POINTS, VERIFIED_POINTS = 25.0, -5.0
PEP_POINTS, MEDIA_POINTS, OCCUPATION_POINTS, SAR_POINTS, HIGH_RATING_POINTS = 25.0, 20.0, 10.0, 10.0, 10.0
EDUCATION_REASON = "Education Exclusion"


def _score(findings: list[tuple[Column, Column, Column | None]]) -> tuple[Column, Column]:
    """Sum of points, not below 0, and the texts of the findings that hold."""
    total = F.lit(0.0)
    texts = []
    for test, points, text in findings:
        total = total + F.when(test, points).otherwise(F.lit(0.0))
        if text is not None:
            texts.append(F.when(test, text))
    return F.greatest(F.lit(0.0), total), F.array_compact(F.array(*texts))


def _amount_findings(grouped: bool) -> list[tuple[Column, Column, Column | None]]:
    reason, amount = F.lower("reason"), F.coalesce(F.col("amount").cast("double"), F.lit(0.0))
    shown = plain(amount) if grouped else money(amount)
    education, crypto = reason.contains("education"), reason.contains("crypto")
    return [
        (education & (amount > EDUCATION_LIMIT), F.lit(EDUCATION_POINTS), F.concat(F.lit("High amount for Education: "), shown)),
        (~education & crypto & (amount > CRYPTO_LIMIT), F.lit(CRYPTO_POINTS), F.concat(F.lit("High amount for Crypto: "), shown)),
    ]


def score_grouped(suppressed: DataFrame, profiles: DataFrame, whitelist: DataFrame, user_id: str | None = None) -> DataFrame:
    """Score and findings per suppressed alert.

    ``suppressed`` has alert_id, customer_id, reason, amount and beneficiary_name. The whitelist is
    limited to the user's own and the shared entities when a user is given.
    """
    entities = whitelist
    if user_id is not None and "user_id" in whitelist.columns:
        entities = whitelist.filter((F.col("user_id") == user_id) | F.col("user_id").isNull())
    reason = F.lower("reason")
    kind = F.when(reason.contains("education"), "University").when(reason.contains("crypto"), "CryptoExchange")
    named = F.col("beneficiary_name").isNotNull() & (F.col("beneficiary_name") != "")
    checked = with_verification(suppressed, entities, F.when(named, kind))
    flags = ["customer_id", "is_pep", "has_adverse_media", "high_risk_occupation", "previous_sar_count"]
    single = first_per_key(profiles.select(*flags), ["customer_id"])
    rows = skew_join(checked, single, ["customer_id"], "left", salt_on=["alert_id"])
    expected = F.when(named, kind)
    sars = F.coalesce(F.col("previous_sar_count"), F.lit(0))
    findings = [
        *_amount_findings(grouped=True),
        (
            expected.isNotNull() & ~F.col("is_verified"),
            F.lit(UNVERIFIED_POINTS),
            F.concat(F.lit("Unverified "), expected, F.lit(" beneficiary: "), F.col("beneficiary_name")),
        ),
        (expected.isNotNull() & F.col("is_verified"), F.lit(VERIFIED_POINTS), None),
        (F.coalesce(F.col("is_pep"), F.lit(False)), F.lit(PEP_POINTS), F.lit("Customer is PEP")),
        (F.coalesce(F.col("has_adverse_media"), F.lit(False)), F.lit(MEDIA_POINTS), F.lit("Adverse Media found")),
        (F.coalesce(F.col("high_risk_occupation"), F.lit(False)), F.lit(OCCUPATION_POINTS), F.lit("High Risk Occupation")),
        (sars > 0, sars * F.lit(SAR_POINTS), F.concat(sars.cast("string"), F.lit(" Previous SARs"))),
    ]
    score, factors = _score(findings)
    return rows.select("alert_id", "reason", score.alias("score"), factors.alias("factors"))


def _truthy(column: Column) -> Column:
    return F.coalesce(F.lower(column.cast("string")).isin("true", "1", "1.0", "yes"), F.lit(False))


def score_peak(suppressed: DataFrame, customers: DataFrame) -> DataFrame:
    """Score and findings per suppressed alert from the customer's own fields."""
    flags = [c for c in ("is_pep", "pep_flag", "adverse_media", "risk_rating") if c in customers.columns]
    single = first_per_key(customers.select("customer_id", *flags), ["customer_id"])
    rows = skew_join(suppressed, single, ["customer_id"], "left", salt_on=["alert_id"])
    pep = F.lit(False)
    for name in ("is_pep", "pep_flag"):
        if name in flags:
            pep = pep | _truthy(F.col(name))
    media = _truthy(F.col("adverse_media")) if "adverse_media" in flags else F.lit(False)
    high = F.coalesce(F.upper(F.col("risk_rating").cast("string")) == "HIGH", F.lit(False)) if "risk_rating" in flags else F.lit(False)
    findings = [
        *_amount_findings(grouped=False),
        (pep, F.lit(PEP_POINTS), F.lit("Customer is PEP")),
        (media, F.lit(MEDIA_POINTS), F.lit("Adverse Media found")),
        (high, F.lit(HIGH_RATING_POINTS), F.lit("High Risk Customer")),
    ]
    score, factors = _score(findings)
    return rows.select("alert_id", "reason", score.alias("score"), factors.alias("factors"))


def _detail(alerts: DataFrame, name: str) -> Column:
    """A field of an alert: its own column, else from its details (JSON text or map)."""
    if name in alerts.columns:
        return F.col(name).cast("string")
    kind = alerts.schema["trigger_details"].dataType if "trigger_details" in alerts.columns else None
    if isinstance(kind, T.StringType):
        return F.get_json_object("trigger_details", f"$.{name}")
    if isinstance(kind, T.MapType):
        return F.try_element_at("trigger_details", F.lit(name)).cast("string")
    return F.lit(None).cast("string")


def _amount(alerts: DataFrame) -> Column:
    """The aggregated value, or the transaction amount where that is missing or zero."""
    values = [_detail(alerts, name).try_cast("double") for name in ("aggregated_value", "transaction_amount")]
    return F.coalesce(F.nullif(values[0], F.lit(0.0)), values[1], F.lit(0.0))


def gap_candidates(alerts: DataFrame, refinements: list[Refinement], once: bool = True) -> DataFrame:
    """Baseline alerts the refinements would drop, judged by the alert's description.

    Only education is recognised, by "tuition" or "university" in the scenario description, or in name
    and reason where there is none. With ``once`` an alert counts once, else once per matching rule.
    """
    matching = [r for r in refinements if r.kind == "event_based" and "education" in r.events]
    own = F.concat_ws(" ", "scenario_name", "trigger_reason")
    text = F.lower(F.coalesce(F.col("scenario_description"), own) if "scenario_description" in alerts.columns else own)
    hit = text.contains("tuition") | text.contains("university")
    times = (1 if once else len(matching)) if matching else 0
    rows = alerts.filter(hit).select(
        "alert_id", "customer_id", F.lit(EDUCATION_REASON).alias("reason"),
        _amount(alerts).alias("amount"), _detail(alerts, "beneficiary_name").alias("beneficiary_name"),
        F.explode(F.array_repeat(F.lit(1), times)).alias("_time"),
    )
    return rows.drop("_time")


def excluded_candidates(alerts: DataFrame) -> DataFrame:
    """The alerts a run actually suppressed."""
    return alerts.filter("excluded").select(
        "alert_id", "customer_id", F.coalesce("exclusion_reason", F.lit("Unknown")).alias("reason"),
        _amount(alerts).alias("amount"), _detail(alerts, "beneficiary_name").alias("beneficiary_name"),
    )


def exploit_texts(scored: DataFrame, top: int = 3) -> DataFrame:
    """The riskiest suppressions as title and method."""
    rows = scored.orderBy(F.desc("score"), "alert_id").limit(top)
    rank = F.row_number().over(W.orderBy(F.desc("score"), "alert_id"))
    return rows.select(
        rank.alias("rank"),
        F.concat(F.lit("Exploit: "), F.coalesce(F.get("factors", F.lit(0)), F.lit("Generic Gap"))).alias("title"),
        F.concat(F.lit("Excluded by rule '"), F.col("reason"), F.lit("'. "), F.array_join("factors", ", ")).alias("method"),
        F.lit("High").alias("volume_risk"),
    )


def gap_report(scored: DataFrame) -> DataFrame:
    """Total score (at most 100), level, count and the top three exploits in one row."""
    totals = scored.agg(
        F.round(F.least(F.coalesce(F.sum("score"), F.lit(0.0)), F.lit(100.0)), 1).alias("_s"),
        F.least(F.coalesce(F.sum("score"), F.lit(0.0)), F.lit(100.0)).alias("_raw"),
        F.count(F.lit(1)).alias("_n"),
    ).select("_s", "_raw", "_n", F.lit(None).cast("int").alias("_rank"), F.lit(None).cast("string").alias("_title"))
    texts = exploit_texts(scored).select(
        F.lit(None).cast("double").alias("_s"), F.lit(None).cast("double").alias("_raw"), F.lit(None).cast("long").alias("_n"),
        F.col("rank").alias("_rank"), F.col("title").alias("_title"),
    )
    listed = F.array_sort(F.collect_list(F.when(F.col("_rank").isNotNull(), F.struct("_rank", "_title"))))
    return totals.unionByName(texts).agg(
        F.max("_s").alias("risk_score"),
        gap_level(F.max("_raw")).alias("risk_level"),
        F.max("_n").alias("excluded_count"),
        listed["_title"].alias("sample_exploits"),
    )
