"""Suppression of alerts with a legitimate context."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.functions.text import col
from txnwatch.operators.skew import UNKNOWN, Hot, hot_groups, hot_within, list_join, next_after, skew_join, sliding, stored
from txnwatch.operators.windows import AMOUNT, DAY, micros, number
from txnwatch.rules import GROUPED, PEAK, Refinement

# Words that mark a narrative; the first kind with a hit wins.
KEYWORDS = {
    "education": ["university", "tuition", "education", "school", "college", "student fee", "semester"],
    "loan": ["loan", "emi", "mortgage", "repayment", "installment", "financing"],
    "fixed_deposit": ["fixed deposit", "fd", "term deposit", "investment", "fd maturity"],
}
# Words by which a grouped rule picks the customers it looks at; other kinds have none.
GATE_KEYWORDS = {
    "education": ["tuition", "university", "college", "school"],
    "crypto": ["crypto", "bitcoin", "binance", "coinbase"],
    "loan": ["loan", "mortgage", "credit"],
}
CRYPTO_KEYWORDS = ["crypto", "bitcoin", "binance", "coinbase"]
EDUCATION_LIMIT = 50000
ENTITY_TYPE = {"education": "University", "loan": "FinancialInstitution"}
LOOKBACK_DAYS = 30
# Sizes of the grams by which names are looked up, and names per block of a frequent gram.
GRAM_SIZES = (1, 2, 4, 8, 16, 32)
NAMES_PER_BLOCK = 256


def _mentions(text: Column, words: Sequence[str], whole_words: bool) -> Column:
    pattern = "|".join(re.escape(word) for word in words)
    return text.rlike(rf"\b(?:{pattern})\b" if whole_words else pattern)


def event_type(narrative: str | Column, whole_words: bool = False, crypto: bool = False) -> Column:
    """kind of event a narrative speaks of, or null.

    Words match anywhere, also inside other words, unless ``whole_words`` is set. ``crypto`` adds a
    fourth kind that the default lists lack.
    """
    text = F.lower(col(narrative))
    kinds = {**KEYWORDS, "crypto": CRYPTO_KEYWORDS} if crypto else KEYWORDS
    chain = None
    for kind, words in kinds.items():
        test = _mentions(text, words, whole_words)
        chain = F.when(test, kind) if chain is None else chain.when(test, kind)
    return chain


def gate_words(events: Iterable[str]) -> list[str]:
    """the words of a grouped rule's events; without any, the rule excludes nothing."""
    return [word for event in events for word in GATE_KEYWORDS.get(event, ())]


def keyword_hit(narrative: str | Column, events: Iterable[str]) -> Column:
    """whether the narrative holds any gate word of the wanted events."""
    words = gate_words(events)
    return F.coalesce(_mentions(F.lower(col(narrative)), words, False), F.lit(False)) if words else F.lit(False)


def name_grams(names: DataFrame) -> DataFrame:
    """An inverted index of names: columns entity_type, _id, _gram.

    ``names`` has entity_type and ``_name``. Grams are the substrings of ``GRAM_SIZES`` characters, as hashes, each once per
    name, so a name of n characters has at most n grams per size. Ids and grams are hashes; the names are
    compared in the end, so equal hashes only cost time.
    """
    length = F.length("_name")
    sizes = F.filter(F.array(*[F.lit(n) for n in GRAM_SIZES]), lambda n: n <= length)
    parts = F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), length - n + 1), lambda at: F.xxhash64(F.substring("_name", at, n))))
    return names.select("entity_type", F.xxhash64("_name").alias("_id"), F.explode(F.array_distinct(F.flatten(parts))).alias("_gram"))


def key_grams(keys: DataFrame) -> DataFrame:
    """Grams that cover each key (column ``_key``), all of the largest size that fits, with their number ``_need``."""
    length = F.length("_key")
    size = F.lit(GRAM_SIZES[0])
    for n in GRAM_SIZES[1:]:
        size = F.when(length >= n, F.lit(n)).otherwise(size)
    # Spark may look at a key before it has dropped the empty ones.
    end = F.greatest(F.lit(1), length - size + 1)
    starts = F.array_distinct(F.concat(F.sequence(F.lit(1), end, size), F.array(end)))
    found = F.array_distinct(F.transform(starts, lambda at: F.xxhash64(F.substring("_key", at, size))))
    return keys.withColumn("_found", found).select("_key", F.size("_found").alias("_need"), F.explode("_found").alias("_gram"))


def verified_names(names: DataFrame, whitelist: DataFrame, column: str = "beneficiary_name") -> DataFrame:
    """Distinct beneficiaries (lower case, ``_key``) with the entity types that verify them.

    An active entity verifies a beneficiary that its name contains. Each key is looked up in the index of names by its
    rarest gram per entity type; a key with a gram that no name has is done. Names of a frequent gram are dealt into blocks
    of about ``NAMES_PER_BLOCK``: most keys are found in the first block, the others see all blocks.
    """
    wanted = names.select(F.lower(col(column)).alias("_key")).filter(F.col("_key") != "").distinct()
    listed = whitelist.filter("is_active").select("entity_type", F.lower("entity_name").alias("_name")).filter("_name != ''").distinct()
    grams = name_grams(listed)
    counts = grams.groupBy("entity_type", "_gram").agg(F.count(F.lit(1)).alias("_names"))
    blocks = F.ceil(F.col("_names") / F.lit(NAMES_PER_BLOCK)).cast("int")
    # Stored, the index has a known size: Spark broadcasts a small one, and then beneficiaries are not shuffled by gram.
    index = stored(grams.join(counts, ["entity_type", "_gram"]).withColumn("_blocks", blocks), "grams")
    postings = index.select("entity_type", "_gram", "_id", F.pmod("_id", "_blocks").cast("int").alias("_block"))
    asked = (
        key_grams(wanted)
        .join(index.select("entity_type", "_gram", "_names", "_blocks").distinct(), "_gram")
        .groupBy("_key", "entity_type", "_need")
        .agg(F.count(F.lit(1)).alias("_have"), F.min(F.struct("_names", "_gram", "_blocks")).alias("_rarest"))
        .filter("_have = _need")
        .select("_key", "entity_type", "_rarest._gram", "_rarest._blocks")
    )

    def found(units: DataFrame) -> DataFrame:
        near = units.join(postings, ["entity_type", "_gram", "_block"]).select("_key", "entity_type", "_id")
        known = listed.select("entity_type", F.xxhash64("_name").alias("_id"), "_name")
        return near.join(known, ["entity_type", "_id"]).filter(F.contains("_name", "_key")).select("_key", "entity_type").distinct()

    first = found(asked.withColumn("_block", F.lit(0)))
    if index.filter("_blocks > 1").isEmpty():
        return first
    left = asked.filter("_blocks > 1").join(first, ["_key", "entity_type"], "left_anti")
    rest = found(left.withColumn("_block", F.explode(F.sequence(F.lit(1), F.col("_blocks") - 1))))
    return first.unionByName(rest)


def with_verification(rows: DataFrame, whitelist: DataFrame, expected: Column, column: str = "beneficiary_name") -> DataFrame:
    """Adds ``is_verified``: the beneficiary is a known entity of the ``expected`` type.

    The names that pass are stored once. They are usually few, and then rows are matched by broadcast.
    """
    keyed = rows.withColumns({"_key": F.lower(col(column)), "entity_type": expected})
    names = verified_names(keyed.filter(F.col("entity_type").isNotNull()), whitelist, column)
    known = stored(names.withColumn("_known", F.lit(True)), "verified")
    joined = list_join(keyed, known, ["_key", "entity_type"], "left", salt_on=rows.columns)
    return joined.withColumn("is_verified", F.coalesce(F.col("_known"), F.lit(False))).drop("_key", "entity_type", "_known")


def event_context(
    transactions: DataFrame,
    whitelist: DataFrame,
    narrative: str = "transaction_narrative",
    amount: str = "transaction_amount",
    whole_words: bool = False,
    crypto: bool = False,
) -> DataFrame:
    """transactions that speak of an event, with ``is_verified`` and ``amount_reasonable``."""
    rows = transactions.withColumn("event_type", event_type(narrative, whole_words, crypto))
    return judged_events(rows.filter(F.col("event_type").isNotNull()), whitelist, amount)


def judged_events(rows: DataFrame, whitelist: DataFrame, amount: str = "transaction_amount") -> DataFrame:
    """rows with their ``event_type``, and whether beneficiary and amount fit it."""
    value = number(amount)
    reasonable = ~((F.col("event_type") == "education") & (value > EDUCATION_LIMIT))
    expected = None
    for event, entity in ENTITY_TYPE.items():
        test = F.col("event_type") == event
        expected = F.when(test, entity) if expected is None else expected.when(test, entity)
    return with_verification(rows.withColumn("amount_reasonable", reasonable), whitelist, expected)


def alerts_with_keywords(
    alerts: DataFrame, transactions: DataFrame, events: Sequence[str], narrative: str = "transaction_narrative"
) -> DataFrame:
    """Alerts whose customer has any transaction with a gate word of the events."""
    customers = transactions.filter(keyword_hit(narrative, events)).select("customer_id").distinct()
    return skew_join(alerts, customers, ["customer_id"], "left_semi", salt_on=["alert_id"])


def lookback(
    alerts: DataFrame,
    transactions: DataFrame,
    days: int = LOOKBACK_DAYS,
    amount: str = "transaction_amount",
    ts: str = "transaction_date",
) -> DataFrame:
    """What each alert's customer did in the ``days`` up to the alert, both ends included.

    Gives count, total, and first and last date of those transactions. Alerts and transactions share
    one time axis per customer and are evaluated as trailing windows, so no alert is paired with
    every transaction of its lookback.
    """
    value = number(amount)
    at = micros(ts)
    rows = transactions.select("customer_id", at.alias("_at"), value.alias("_v"), at.alias("_seen"), F.lit(1).alias("_n"))
    marks = alerts.select("customer_id", micros("alert_date").alias("_at")).withColumns(
        {"_v": F.lit(0).cast(AMOUNT), "_seen": F.lit(None).cast("long"), "_n": F.lit(0)}
    )
    both = rows.unionByName(marks).dropna(subset=["customer_id", "_at"])
    hot = hot_groups(both, ["customer_id"])
    if hot is None:
        # Without hot customers all steps share one exchange.
        both = both.repartition("customer_id")
    nodes = (
        both.groupBy("customer_id", "_at")
        .agg(F.sum("_v").alias("total"), F.sum("_n").alias("n"), F.min("_seen").alias("first"), F.max("_seen").alias("last"))
        .withColumn("_back", -F.col("_at"))
    )
    aggs = {"w_total": ("sum", "total"), "w_n": ("sum", "n"), "w_first": ("min", "first"), "w_last": ("max", "last")}
    source = both.select("customer_id", (-F.col("_at")).alias("_back"))
    seen = sliding(nodes, ["customer_id"], "_back", days * DAY, aggs, source=source, hot=hot)
    zero = F.lit(0).cast(AMOUNT)
    values = seen.select(
        "customer_id",
        "_at",
        (F.col("n") + F.coalesce("w_n", F.lit(0))).alias("lookback_transactions"),
        (F.col("total") + F.coalesce("w_total", zero)).cast("double").alias("lookback_amount"),
        F.timestamp_micros(F.least("first", "w_first")).alias("lookback_first"),
        F.timestamp_micros(F.greatest("last", "w_last")).alias("lookback_last"),
    )
    keyed = alerts.select("alert_id", "customer_id", micros("alert_date").alias("_at"))
    hot = hot_within(keyed, ["customer_id", "_at"], ["customer_id"], hot)
    return skew_join(keyed, values, ["customer_id", "_at"], "inner", salt_on=["alert_id"], hot=hot).drop("_at")


def refine(
    alerts: DataFrame,
    transactions: DataFrame,
    whitelist: DataFrame,
    refinements: Sequence[Refinement],
    lookback_days: int = LOOKBACK_DAYS,
    narrative: str = "transaction_narrative",
    amount: str = "transaction_amount",
    ts: str = "transaction_date",
    crypto: bool = False,
    profile: str = PEAK,
    hot: Hot = UNKNOWN,
) -> DataFrame:
    """Mark alerts of one rule that a refinement excludes; see ``refine_rules``."""
    marked = refine_rules(
        alerts.withColumn("_rule", F.lit(0)), transactions, whitelist, {0: (refinements, profile)}, lookback_days, narrative, amount, ts, crypto, hot
    )
    return marked.drop("_rule")


def _active(refinements: Sequence[Refinement], profile: str) -> list[Refinement]:
    found = [r for r in refinements if r.enabled and r.kind == "event_based" and r.events]
    return [r for r in found if gate_words(r.events)] if profile == GROUPED else found


def refine_rules(
    alerts: DataFrame,
    transactions: DataFrame,
    whitelist: DataFrame,
    rules: Mapping[int, tuple[Sequence[Refinement], str]],
    lookback_days: int = LOOKBACK_DAYS,
    narrative: str = "transaction_narrative",
    amount: str = "transaction_amount",
    ts: str = "transaction_date",
    crypto: bool = False,
    hot: Hot = UNKNOWN,
) -> DataFrame:
    """Mark alerts that a refinement of their rule excludes. Column ``_rule`` of an alert is its key in
    ``rules``, which hold refinements and profile.

    A refinement excludes an alert when its customer has, in the lookback before the alert, a transaction of
    an excluded event; an education transaction must also be verified and reasonable. The first such
    transaction by (date, id) is the reason, and the first refinement that applies wins. Refinements with the same events
    share their work. Transactions that speak of an event are read from ``transactions`` once and stored; they are
    reduced to one per customer, kind of refinement and instant; alerts and these are then read
    once in time order, so the work does not depend on how many transactions a lookback holds.

    With the grouped profile a refinement only looks at customers with a transaction, of any date, that holds one of
    its own gate words (F3), and one whose events have no gate words excludes nothing. ``hot`` may hand over the
    hot customers among transactions and alerts, if the caller has counted them.
    """
    active = {rule: _active(*spec) for rule, spec in rules.items()}
    active = {rule: found for rule, found in active.items() if found}
    if not active:
        return alerts.withColumns(
            {
                "excluded": F.lit(False), "exclusion_reason": F.lit(None).cast("string"),
                "exclusion_rule_id": F.lit(None).cast("string"), "risk_flags": F.lit(None).cast(FLAGS),
            }
        )
    gated = {rule: spec[1] == GROUPED for rule, spec in rules.items()}
    kinds = sorted({(r.events, gated[rule]) for rule, found in active.items() for r in found})
    gates = {k: keyword_hit(narrative, events) for k, (events, gate) in enumerate(kinds) if gate}
    kind, at = event_type(narrative, crypto=crypto), micros(ts)
    wanted = {event for events, _ in kinds for event in events}
    events = transactions.select(
        "customer_id",
        at.alias("_at"),
        "transaction_id",
        F.when(kind.isin(*sorted(wanted)) & at.isNotNull(), kind).alias("event_type"),
        "beneficiary_name",
        F.col(amount).alias("_amount"),
        F.array_compact(F.array(*[F.when(test, F.lit(k)) for k, test in gates.items()])).cast("array<int>").alias("_gates"),
    ).filter(F.col("customer_id").isNotNull() & (F.col("event_type").isNotNull() | (F.size("_gates") > 0)))
    # The few rows that matter are read again for names, items, gates and hot customers.
    events = stored(events, "events")
    spoken = events.filter(F.col("event_type").isNotNull())
    context = judged_events(spoken, whitelist, "_amount")
    sound = (F.col("event_type") != "education") | (F.col("is_verified") & F.col("amount_reasonable"))
    item = F.struct(
        F.col("_at").alias("at"),
        F.col("transaction_id").alias("transaction_id"),
        F.col("event_type").alias("event_type"),
        F.col("is_verified").alias("is_verified"),
        F.col("amount_reasonable").alias("amount_reasonable"),
        F.col("beneficiary_name").alias("beneficiary"),
        F.col("_amount").try_cast("double").alias("amount"),
    )
    fits = F.array(*[F.when(F.col("event_type").isin(list(events)), F.lit(k)) for k, (events, _) in enumerate(kinds)])
    items = (
        context.filter(sound)
        .withColumn("_kind_no", F.explode(F.array_compact(fits)))
        .groupBy("customer_id", "_kind_no", "_at")
        .agg(F.min(item).alias("_first"))
    )
    places = by_rule(
        {rule: F.array(*[F.struct(F.lit(j).alias("place"), F.lit(kinds.index((r.events, gated[rule]))).alias("kind_no")) for j, r in enumerate(found)]) for rule, found in active.items()}
    )
    probes = alerts.filter(F.col("customer_id").isNotNull() & F.col("alert_date").isNotNull()).select(
        "customer_id",
        F.explode(places).alias("_p"),
        "alert_id",
        micros("alert_date").alias("_end"),
        (micros("alert_date") - F.lit(lookback_days * DAY)).alias("_start"),
    ).select("customer_id", F.col("_p.kind_no").alias("_kind_no"), F.col("_p.place").alias("_place"), "alert_id", "_end", "_start")
    if hot is UNKNOWN:
        # Only rows that take part below count.
        hot = hot_groups(events.select("customer_id").union(alerts.select("customer_id")), ["customer_id"])
    if hot is not None:
        hot = hot.withColumn("_kind_no", F.explode(F.sequence(F.lit(0), F.lit(len(kinds) - 1))))
    if gates:
        gate = events.select("customer_id", F.explode("_gates").alias("_kind_no")).distinct().withColumn("_open", F.lit(True))
        through = skew_join(items, gate, ["customer_id", "_kind_no"], "left", salt_on=["_at"], hot=hot)
        items = through.filter(F.col("_open") | ~F.col("_kind_no").isin(list(gates))).drop("_open")
    found = next_after(probes, items, ["customer_id", "_kind_no"], "_start", "_at", "_first", "_item", hot)
    first = (
        found.filter(F.col("_item.at") <= F.col("_end"))
        .groupBy("alert_id")
        .agg(F.min(F.struct("_place", "_item")).alias("_hit"))
    )
    event, beneficiary = F.col("_hit._item.event_type"), F.col("_hit._item.beneficiary")
    reason = F.when(
        event == "education",
        F.concat(F.lit("Verified education transaction to "), F.coalesce(beneficiary, F.lit("None"))),
    ).otherwise(F.concat(F.lit("Legitimate "), event, F.lit(" transaction")))
    names = by_rule({rule: F.array(*[F.lit(r.rule_id) for r in found]) for rule, found in active.items()})
    flags = F.struct(
        event.alias("event_type"),
        F.col("_hit._item.is_verified").alias("is_verified"),
        F.col("_hit._item.amount_reasonable").alias("amount_reasonable"),
        beneficiary.alias("beneficiary"),
        F.col("_hit._item.amount").alias("amount"),
    )
    return alerts.join(first, "alert_id", "left").select(
        *alerts.columns,
        F.col("_hit").isNotNull().alias("excluded"),
        F.when(F.col("_hit").isNotNull(), reason).alias("exclusion_reason"),
        F.when(F.col("_hit").isNotNull(), names[F.col("_hit._place")]).alias("exclusion_rule_id"),
        F.when(F.col("_hit").isNotNull(), flags).alias("risk_flags"),
    )


def by_rule(values: Mapping[int, Column]) -> Column:
    """The value of the row's rule (column ``_rule``), null for rules without one."""
    chain = None
    for rule, value in values.items():
        test = F.col("_rule") == rule
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain


FLAGS = "struct<event_type:string,is_verified:boolean,amount_reasonable:boolean,beneficiary:string,amount:double>"


def exclusion_log(alerts: DataFrame) -> DataFrame:
    """one log row per excluded alert with the flags that led to it."""
    return alerts.filter("excluded").select(
        F.sha2(F.concat_ws("/", F.col("alert_id"), F.col("exclusion_rule_id")), 256).alias("log_id"),
        "alert_id",
        F.col("exclusion_rule_id").alias("rule_id"),
        "exclusion_reason",
        "risk_flags",
    )
