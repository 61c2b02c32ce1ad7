"""Many rules over one dataset in one pass.

Rules are not run one after another. Every transaction is read once per kind of rule and dealt to the rules whose
filters it passes, as rows (rule, owner, time, value). Peak windows, trailing windows and groups of all rules are then
formed in one exchange each, thresholds and texts are chosen by the row's rule, and customers are joined once. So the
scans and exchanges of a run depend on the kinds of rules in it, not on their number, and the work on the rows that pass.

``fits`` says which rules can be run this way; ``plans.run`` runs the others alone. Results are the same either way.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnwatch.functions.scoring import band_score, ratio_score, score_class
from txnwatch.operators.aggregate import calendar_bucket, grouped_links
from txnwatch.operators.alerts import alert_id, condition, dedup_alerts, details_map, enrichment_block, metadata_block, peak_details, trigger_reason
from txnwatch.operators.enrich import add_customer_fields, enrich_with_customers, first_per_key
from txnwatch.operators.filters import all_of, split_filters, typed_filter
from txnwatch.operators.refine import by_rule
from txnwatch.operators.skew import Hot, UNKNOWN, hot_groups, list_join, sliding
from txnwatch.operators.threshold import threshold_column
from txnwatch.operators.windows import AMOUNT, amount_of, in_peak_window, in_trailing_window, instant, micros, number
from txnwatch.plans.peak import SHOWN
from txnwatch.rules import GROUPED, PEAK, Rule, customer_fields_of

RESERVED = {"aggregated_value", "transaction_count", "alert_date", "threshold", "time_group", "window_start", "window_end", "peers", "customer_name"}
DAY = 86_400_000_000


def fits(rule: Rule, transactions: DataFrame, customers: DataFrame) -> bool:
    """Whether a rule can share a pass: its columns exist and do not clash with names of the result."""
    fields = {f.name: f.dataType for f in transactions.schema.fields}
    people = {f.name: f.dataType for f in customers.schema.fields}
    if not {"transaction_id", "customer_id", "transaction_date"} <= fields.keys() or any(c.startswith("_") for c in fields):
        return False
    if rule.profile == PEAK:
        return True
    if rule.mapping or rule.resolve(rule.value_field) not in fields or RESERVED & set(rule.group_by):
        return False
    keys = [fields.get(k, people.get(k)) for k in rule.group_by]
    # A key that customers have too must look the same there, as other rules may show the customers' column.
    return all(t is not None and not isinstance(t, T.MapType) for t in keys) and all(people.get(k, t) == t for k, t in zip(rule.group_by, keys, strict=True))


def _tests(rule: Rule, transactions: DataFrame, customers: DataFrame) -> tuple[Column, Column | None]:
    """What a rule asks of a transaction and of its customer."""
    items = typed_filter(rule.filters) if isinstance(rule.filters, Mapping) else list(rule.filters)
    own, theirs, _ = split_filters(
        items, transactions.schema, customers.schema, unknown="none" if rule.profile == PEAK else "skip",
        mapping=rule.mapping, keep_null_on_ne=rule.profile == GROUPED,
    )
    return all_of(own), all_of(theirs) if theirs else None


def dealt(transactions: DataFrame, customers: DataFrame, picks: Mapping[int, tuple[Rule, Sequence[Column], Column]], hot: DataFrame | None) -> DataFrame:
    """Transactions once per rule that they pass: all their columns, ``_rule`` and the fields of the rule's struct.

    ``picks`` has per rule what must not be null and a struct of what the rule takes from a transaction.
    Filters on customers are looked up for all rules at once, by (customer, rule).
    """
    tests = {i: _tests(rule, transactions, customers) for i, (rule, _, _) in picks.items()}
    passes = {
        i: reduce(lambda a, b: a & b, [F.coalesce(tests[i][0], F.lit(False)), *[c.isNotNull() for c in filled]]) for i, (_, filled, _) in picks.items()
    }
    either = reduce(lambda a, b: a | b, passes.values())
    taken = F.array_compact(F.array(*[F.when(passes[i], F.struct(F.lit(i).alias("_rule"), part.alias("_take"))) for i, (_, _, part) in picks.items()]))
    rows = transactions.filter(either).withColumn("_pick", F.explode(taken))
    rows = rows.select(*transactions.columns, "_pick._rule", "_pick._take.*")
    asked = {i: theirs for i, (_, theirs) in tests.items() if theirs is not None}
    if not asked:
        return rows
    listed = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(i)) for i, test in asked.items()]))
    keys = customers.select("customer_id", F.explode(listed).alias("_rule")).distinct().withColumn("_chosen", F.lit(True))
    joined = list_join(rows, keys, ["customer_id", "_rule"], "left", salt_on=["transaction_id"], hot=per_rule(hot, picks))
    return joined.filter(F.col("_chosen") | ~F.col("_rule").isin(list(asked))).drop("_chosen")


def per_rule(hot: DataFrame | None, rules: Mapping[int, object]) -> DataFrame | None:
    """Hot customers as hot (rule, customer) pairs."""
    return None if hot is None else hot.withColumn("_rule", F.explode(F.array(*[F.lit(i) for i in rules])))


def _number_by_rule(values: Mapping[int, int]) -> int | Column:
    return next(iter(values.values())) if len(set(values.values())) == 1 else by_rule({i: F.lit(v) for i, v in values.items()})


def _uses(rules: Mapping[int, Rule], *functions: str) -> Column:
    found = [i for i, rule in rules.items() if rule.function in functions]
    return F.col("_rule").isin(found) if found else F.lit(False)


# Peak rules


def _peak_value(rule: Rule, transactions: DataFrame) -> Column:
    name = rule.resolve(rule.value_field)
    return number(name) if name in transactions.columns else F.lit(0).cast(AMOUNT)


def _peak_rows(transactions: DataFrame, customers: DataFrame, rules: Mapping[int, Rule], hot: DataFrame | None) -> DataFrame:
    at = micros("transaction_date")
    picks = {
        i: (rule, [F.col("customer_id"), at], F.struct(_peak_value(rule, transactions).alias("_v"))) for i, rule in rules.items()
    }
    return dealt(transactions, customers, picks, hot)


def peak_windows_of(rows: DataFrame, rules: Mapping[int, Rule], hot: DataFrame | None) -> DataFrame:
    """D9 for all rules: the best window of each (rule, customer). ``rows`` has _rule, customer_id, _v and the date."""
    slim = rows.select("_rule", "customer_id", micros("transaction_date").alias("at"), F.col("_v").alias("v"))
    few = None if hot is None else hot.drop("_pieces")
    if few is None:
        return _peak_windows_of(slim, rules, None)
    parts = [_peak_windows_of(slim.join(few, ["_rule", "customer_id"], how), rules, found) for how, found in (("left_anti", None), ("left_semi", hot))]
    return parts[0].unionByName(parts[1])


def _peak_windows_of(rows: DataFrame, rules: Mapping[int, Rule], hot: DataFrame | None) -> DataFrame:
    group, width = ["_rule", "customer_id"], _number_by_rule({i: rule.window_days * DAY for i, rule in rules.items()})
    if hot is None:
        rows = rows.repartition("customer_id")
    value, gain = F.col("v"), F.col("v") >= 0
    summing, by_value = _uses(rules, "sum"), _uses(rules, "avg", "min")
    # An instant is one node, except where the value of the first item decides.
    merged = rows.withColumn("fine", F.when(by_value, value)).groupBy(*group, "at", "fine").agg(
        F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.sum(F.when(gain, value)).alias("gain"), F.count_if(gain).alias("gains"), F.min(F.when(gain, value)).alias("first_gain"),
    )
    nodes = merged.select(
        *group, "at", "total", "n", "low", "high", F.col("at").alias("at_seen"),
        F.when(summing, F.coalesce("gain", "high")).otherwise(F.col("total")).alias("own"),
        F.when(summing, F.greatest("gains", F.lit(1))).otherwise(F.col("n")).alias("own_n"),
        F.when(summing, F.coalesce("first_gain", "high")).otherwise(F.coalesce("fine", "low")).alias("v"),
        (summing & (F.col("gains") == 0)).alias("single"),
    )
    aggs = {"w_n": ("sum", "n"), "w_last": ("max", "at_seen"), "w_total": ("sum", "total"), "w_high": ("max", "high"), "w_low": ("min", "low")}
    seen = sliding(nodes, group, "at", width, aggs, tie="v", source=rows.select(*group, "at"), hot=hot)
    count = F.col("own_n") + F.coalesce("w_n", F.lit(0))
    total = (F.col("own") + F.coalesce("w_total", F.lit(0).cast(AMOUNT))).cast("double")
    results = {"sum": total, "count": count.cast("double"), "avg": total / count, "max": F.greatest("high", "w_high").cast("double"), "min": F.least("v", "w_low").cast("double")}
    result = by_rule({i: results[rule.function] for i, rule in rules.items()})
    candidate = F.struct(
        result.alias("agg"), (-F.col("at")).alias("neg_at"), (-F.col("v")).alias("neg_v"),
        count.alias("n"), F.greatest("at", "w_last").alias("last"), F.col("single").alias("single"),
    )
    best = seen.groupBy(*group).agg(
        F.max(F.when(result > 0, candidate)).alias("best"), F.sum("n").alias("customer_transactions"), F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )
    return best.select(
        *group,
        F.coalesce("best.agg", F.lit(0.0)).alias("aggregated_value"),
        F.coalesce("best.n", F.lit(0)).cast("long").alias("transaction_count"),
        F.timestamp_micros(-F.col("best.neg_at")).alias("window_start"),
        F.timestamp_micros(F.lit(width) - F.col("best.neg_at")).alias("window_end"),
        F.timestamp_micros(F.coalesce("best.last", "last_at")).alias("alert_date"),
        (-F.col("best.neg_v")).cast(AMOUNT).alias("start_value"),
        F.coalesce("best.single", F.lit(False)).alias("starts_at_last"),
        "customer_transactions",
        F.timestamp_micros("first_at").alias("first_date"),
        F.timestamp_micros("last_at").alias("last_date"),
    )


def peak_alerts_of(transactions: DataFrame, customers: DataFrame, rules: Mapping[int, Rule], run_id: str, hot: DataFrame | None) -> DataFrame:
    """E1-E16 for all peak rules: one alert per rule and customer whose best window reaches the rule's threshold."""
    windows = peak_windows_of(_peak_rows(transactions, customers, rules, hot), rules, per_rule(hot, rules))
    counted = {i: F.col("transaction_count") >= rule.min_transactions for i, rule in rules.items() if rule.min_transactions is not None}
    if counted:
        windows = windows.filter(F.coalesce(by_rule(counted), F.lit(True)))
    wanted = {*SHOWN}
    for rule in rules.values():
        wanted |= {rule.threshold.segment_field, rule.threshold.reference_field}
        if rule.threshold.formula and "customer." in rule.threshold.formula:
            wanted |= set(customers.columns)
    columns = [c for c in customers.columns if c in wanted and c != "customer_id"]
    single = first_per_key(customers.select("customer_id", *columns), ["customer_id"])
    scored = windows.join(single, "customer_id", "left").withColumn(
        "threshold", by_rule({i: threshold_column(rule.threshold, columns).cast("double") for i, rule in rules.items()})
    )
    rows = scored.filter(F.col("aggregated_value") >= F.col("threshold"))
    shown = ["customer_id", *[c for c in rows.columns if c not in ("customer_id", "_rule")]]
    each = lambda make: by_rule({i: make(rule) for i, rule in rules.items()})
    name = F.coalesce(*[F.col(c) for c in ("customer_name", "name") if c in shown], F.lit("Unknown"))
    return rows.select(
        "_rule",
        each(lambda r: alert_id(run_id, r.scenario_id, ["customer_id"], "window_end", "aggregated_value")).alias("alert_id"),
        F.lit(run_id).alias("run_id"),
        each(lambda r: F.lit(r.scenario_id)).alias("scenario_id"),
        each(lambda r: F.lit(r.scenario_name)).alias("scenario_name"),
        "customer_id",
        name.alias("customer_name"),
        "alert_date",
        "aggregated_value",
        "threshold",
        "transaction_count",
        ratio_score("aggregated_value", "threshold").alias("risk_score"),
        each(lambda r: F.lit(r.metadata.get("severity", "MEDIUM"))).alias("risk_classification"),
        each(lambda r: trigger_reason(r, shown, r.window_days)).alias("trigger_reason"),
        each(lambda r: peak_details(r, r.window_days)).alias("trigger_details"),
        each(lambda r: metadata_block(r.metadata)).alias("alert_metadata"),
        each(lambda r: enrichment_block(r.enrichment, shown)).alias("enrichment_data"),
        "window_start",
        "window_end",
        "start_value",
        "starts_at_last",
    )


def peak_links_of(transactions: DataFrame, customers: DataFrame, alerts: DataFrame, rules: Mapping[int, Rule], hot: DataFrame | None) -> DataFrame:
    """The transactions inside the windows of all peak alerts."""
    marks = alerts.select("_rule", "alert_id", "customer_id", "window_start", "window_end", "start_value", "starts_at_last", "transaction_count")
    rows = _peak_rows(transactions, customers, rules, hot)
    return in_peak_window(rows, marks, "_v", hot=per_rule(hot, rules), keys=["_rule", "customer_id"])


# Grouped rules


def _is_trailing(rule: Rule) -> bool:
    return rule.time_window is not None and rule.time_window.kind == "rolling"


def with_key_columns(transactions: DataFrame, customers: DataFrame, rules: Mapping[int, Rule], hot: DataFrame | None) -> DataFrame:
    """Transactions with the customer columns that some rule groups by."""
    keys = sorted({k for rule in rules.values() for k in rule.group_by if k not in transactions.columns and k in customers.columns})
    return enrich_with_customers(transactions, customers, keys, hot=hot) if keys else transactions


def _grouped_rows(transactions: DataFrame, customers: DataFrame, rules: Mapping[int, Rule], every: Mapping[int, Rule], hot: DataFrame | None) -> DataFrame:
    """Rows of grouped rules. ``_owner`` holds the key columns of ``every`` rule, null where a rule does not group by one."""
    source = with_key_columns(transactions, customers, every, hot)
    kinds = {f.name: f.dataType for f in source.schema.fields}
    names = sorted({k for rule in every.values() for k in rule.group_by})
    # A rule's filters see the transactions as they are, without the joined columns.
    picks = {}
    for i, rule in rules.items():
        bucket = F.lit(None).cast("timestamp")
        filled = [F.col(k) for k in rule.group_by]
        if _is_trailing(rule):
            filled.append(micros("transaction_date"))
        elif rule.time_window is not None:
            bucket = calendar_bucket("transaction_date", rule.time_window)
            filled.append(bucket)
        owner = F.struct(*[(F.col(k) if k in rule.group_by else F.lit(None).cast(kinds[k])).alias(k) for k in names], bucket.cast("timestamp").alias("time_group"))
        field = rule.resolve(rule.value_field)
        picks[i] = (rule, filled, F.struct(owner.alias("_owner"), amount_of(field).alias("_v"), F.col(field).isNotNull().alias("_filled")))
    return dealt(source, customers, picks, hot)


def _trailing_values(rows: DataFrame, rules: Mapping[int, Rule], hot: Hot) -> DataFrame:
    """D6 for all rules: the trailing aggregate of every instant of an owner."""
    group, width = ["_rule", "_owner"], _number_by_rule({i: rule.time_window.micros for i, rule in rules.items()})
    slim = rows.select(*group, micros("transaction_date").alias("_at"), "_v")
    hot = hot_groups(slim, group) if hot is UNKNOWN else hot
    if hot is None:
        slim = slim.repartition("_owner")
    nodes = slim.groupBy(*group, "_at").agg(
        F.sum("_v").alias("total"), F.count("_v").alias("filled"), F.count(F.lit(1)).alias("peers"), F.min("_v").alias("low"), F.max("_v").alias("high")
    )
    aggs = {"w_n": ("sum", "peers"), "w_total": ("sum", "total"), "w_filled": ("sum", "filled"), "w_high": ("max", "high"), "w_low": ("min", "low")}
    source = slim.select(*group, (-F.col("_at")).alias("_back"))
    seen = sliding(nodes.withColumn("_back", -F.col("_at")), group, "_back", width, aggs, source=source, hot=hot)
    zero = F.lit(0).cast(AMOUNT)
    count = F.col("peers") + F.coalesce("w_n", F.lit(0))
    total = (F.coalesce("total", zero) + F.coalesce("w_total", zero)).cast("double")
    results = {
        "sum": total, "count": count.cast("double"), "max": F.greatest("high", "w_high").cast("double"), "min": F.least("low", "w_low").cast("double"),
        "avg": F.try_divide(total, (F.col("filled") + F.coalesce("w_filled", F.lit(0))).cast("double")),
    }
    at = F.timestamp_micros("_at")
    return seen.select(
        *group,
        by_rule({i: results[rule.function] for i, rule in rules.items()}).alias("aggregated_value"),
        count.cast("long").alias("transaction_count"),
        at.alias("alert_date"),
        F.timestamp_micros(F.col("_at") - F.lit(width)).alias("window_start"),
        at.alias("window_end"),
        F.lit(None).cast("string").alias("_first_customer"),
    )


def _group_values(rows: DataFrame, rules: Mapping[int, Rule], customer_type: T.DataType) -> DataFrame:
    """D1-D5, D7, D8 for all rules: aggregates of groups and calendar buckets, formed before the exchange."""
    zero = F.lit(0).cast(AMOUNT)
    total, filled = F.sum("_v"), F.count("_v")
    results = {
        "sum": F.coalesce(total, zero).cast("double"), "count": F.count_if("_filled").cast("double"),
        "avg": F.try_divide(total.cast("double"), filled.cast("double")), "max": F.max("_v").cast("double"), "min": F.min("_v").cast("double"),
    }
    used = sorted({rule.function for rule in rules.values()})
    # Only rules that do not group by customer look for the customer of the first transaction.
    seeking = any("customer_id" not in rule.group_by for rule in rules.values())
    first = F.min(F.struct("transaction_date", "transaction_id", "customer_id"))["customer_id"] if seeking else F.lit(None).cast(customer_type)
    values = rows.groupBy("_rule", "_owner").agg(
        *[results[name].alias(f"_{name}") for name in used], F.count(F.lit(1)).alias("transaction_count"),
        F.max(instant("transaction_date")).alias("alert_date"), *([first.alias("_first_customer")] if seeking else []),
    )
    return values.select(
        "_rule", "_owner",
        by_rule({i: F.col(f"_{rule.function}") for i, rule in rules.items()}).alias("aggregated_value"),
        F.col("transaction_count").cast("long").alias("transaction_count"),
        "alert_date",
        F.col("_owner.time_group").alias("window_start"),
        F.col("alert_date").alias("window_end"),
        (F.col("_first_customer") if seeking else F.lit(None)).cast("string").alias("_first_customer"),
    )


def shown_columns(rule: Rule, fields: Sequence[str]) -> list[str]:
    """The columns of a grouped rule's results in the order in which its alerts list them."""
    keys, kind = list(rule.group_by), rule.threshold.kind if rule.threshold else None
    if _is_trailing(rule):
        columns = [*keys, "alert_date", "aggregated_value", "transaction_count"]
    else:
        columns = [*keys, *(["time_group"] if rule.time_window else []), "aggregated_value", "transaction_count", "alert_date"]
        if "customer_id" not in keys:
            columns.append("customer_id")
    columns += ["threshold"] if kind == "fixed" else []
    wanted = [c for c in fields if c not in columns]
    if "customer_id" in columns and wanted:
        # The join puts its key first.
        columns = ["customer_id", *[c for c in columns if c != "customer_id"], *wanted]
    return columns + (["threshold"] if kind not in (None, "fixed") else [])


def _sources(rules: Mapping[int, Rule]) -> dict[str, dict[int, Rule]]:
    """Grouped rules by the way their values are formed; owners without their customer need one more aggregate."""
    ways: dict[str, dict[int, Rule]] = {}
    for i, rule in rules.items():
        way = "trailing" if _is_trailing(rule) else "owned" if "customer_id" in rule.group_by else "seeking"
        ways.setdefault(way, {})[i] = rule
    return ways


def _owner_hot(rules: Mapping[int, Rule], hot: DataFrame | None) -> Hot:
    """Without hot customers, owners that include the customer are not hot either; others are counted."""
    return None if hot is None and all("customer_id" in rule.group_by for rule in rules.values()) else UNKNOWN


def grouped_alerts_of(transactions: DataFrame, customers: DataFrame, rules: Mapping[int, Rule], run_id: str, hot: DataFrame | None) -> DataFrame:
    """E1-E18 for all grouped rules: one alert per rule, customer and day."""
    parts = []
    for way, some in _sources(rules).items():
        rows = _grouped_rows(transactions, customers, some, rules, hot)
        parts.append(_trailing_values(rows, some, _owner_hot(some, hot)) if way == "trailing" else _group_values(rows, some, transactions.schema["customer_id"].dataType))
    values = reduce(lambda a, b: a.unionByName(b), parts)
    names = sorted({k for rule in rules.values() for k in rule.group_by})
    fixed = {i: F.col("aggregated_value") >= threshold_column(rule.threshold, []) for i, rule in rules.items() if rule.threshold and rule.threshold.kind == "fixed"}
    if fixed:
        values = values.filter(F.coalesce(by_rule(fixed), ~F.col("_rule").isin(list(fixed))))
    own = F.col("_owner.customer_id").cast("string") if "customer_id" in names else F.lit(None).cast("string")
    values = values.withColumn("customer_id", F.coalesce(own, "_first_customer").cast(transactions.schema["customer_id"].dataType)).drop("_first_customer")
    fields = {i: customer_fields_of(rule, customers.columns, transactions.columns) for i, rule in rules.items()}
    # In the customers' own order, by which the row of a repeated customer is chosen.
    joined = add_customer_fields(values, customers, [c for c in customers.columns if any(c in some for some in fields.values())], hot=hot)
    for name in names:
        if name == "customer_id":
            continue
        having = [i for i, rule in rules.items() if name in rule.group_by]
        key = F.col(f"_owner.{name}")
        other = F.col(name) if name in joined.columns else F.lit(None)
        joined = joined.withColumn(name, F.when(F.col("_rule").isin(having), key).otherwise(other))
    joined = joined.withColumn("time_group", F.col("_owner.time_group"))
    columns = {i: shown_columns(rule, fields[i]) for i, rule in rules.items()}
    bounds = {i: threshold_column(rule.threshold, columns[i]).cast("double") for i, rule in rules.items() if rule.threshold}
    scored = joined.withColumn("threshold", by_rule(bounds) if bounds else F.lit(None).cast("double"))
    reached = F.coalesce(F.col("aggregated_value") >= F.col("threshold"), ~F.col("_rule").isin(list(bounds)) if bounds else F.lit(True))
    scored = scored.filter(reached)
    hits = scored.filter(by_rule({i: condition([*columns[i], "window_start", "window_end"], scored.schema, rule) for i, rule in rules.items()}))
    each = lambda make: by_rule({i: make(i, rule) for i, rule in rules.items()})

    def owner_of(rule: Rule) -> list[str]:
        return [*rule.group_by, *(["time_group"] if rule.time_window and not _is_trailing(rule) else [])]

    score = band_score("aggregated_value")
    alerts = hits.select(
        "_rule",
        "_owner",
        each(lambda i, r: alert_id(run_id, r.scenario_id, owner_of(r), "window_end", "aggregated_value")).alias("alert_id"),
        F.lit(run_id).alias("run_id"),
        each(lambda i, r: F.lit(r.scenario_id)).alias("scenario_id"),
        each(lambda i, r: F.lit(r.scenario_name)).alias("scenario_name"),
        F.col("customer_id").cast("string").alias("customer_id"),
        each(lambda i, r: F.coalesce(F.col("customer_name").cast("string"), F.lit("Unknown")) if "customer_name" in columns[i] else F.lit("Unknown")).alias("customer_name"),
        "alert_date",
        "aggregated_value",
        "threshold",
        "transaction_count",
        score.alias("risk_score"),
        score_class(score).alias("risk_classification"),
        F.lit(None).cast("string").alias("trigger_reason"),
        each(lambda i, r: details_map(columns[i])).alias("trigger_details"),
        "window_start",
        "window_end",
    )
    return dedup_alerts(alerts)


def grouped_links_of(transactions: DataFrame, customers: DataFrame, alerts: DataFrame, rules: Mapping[int, Rule], hot: DataFrame | None) -> DataFrame:
    """The transactions behind the alerts of all grouped rules."""
    parts, group = [], ["_rule", "_owner"]
    ways = _sources(rules)
    for some in ([ways[w] for w in ("trailing",) if w in ways], [ways[w] for w in ("owned", "seeking") if w in ways]):
        chosen = {i: rule for part in some for i, rule in part.items()}
        if not chosen:
            continue
        rows = _grouped_rows(transactions, customers, chosen, rules, hot)
        mine = alerts.filter(F.col("_rule").isin(list(chosen)))
        if _is_trailing(next(iter(chosen.values()))):
            width = _number_by_rule({i: rule.time_window.micros for i, rule in chosen.items()})
            marks = mine.select("alert_id", *group, "window_start", "window_end")
            parts.append(in_trailing_window(rows, marks, width, group, hot=_owner_hot(chosen, hot)).drop("window_start", "window_end"))
        else:
            parts.append(grouped_links(rows, mine, group, None, hot=_owner_hot(chosen, hot)))
    return reduce(lambda a, b: a.unionByName(b), parts)
