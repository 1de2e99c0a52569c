"""Deterministic case rules: time, amount and transaction contradictions, urgency, checklist, actions, confidence caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# How many minutes two times of one event may differ, by their precision.
TOLERANCE_MINUTES = {("EXACT", "EXACT"): 2, ("APPROXIMATE", "EXACT"): 10, ("APPROXIMATE", "APPROXIMATE"): 20}
ZONE_SECONDS = 19_800
CONFIDENCE_CAPS = {"APPROXIMATE": 0.70, "INFERRED_ORDER_ONLY": 0.50}


def spread_over(rows: DataFrame, by: list[str], value: str, most: int) -> DataFrame:
    """Groups whose values lie further apart than ``most``."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), (F.max(value) - F.min(value)).alias("spread")).where(F.col("spread") > most)


def time_contradictions(times: DataFrame) -> DataFrame:
    """Pairs of times of one event that differ by strictly more than their precisions allow: ``case_id, event_key, id_a, id_b, minutes``.

    ``times``: ``case_id, event_key, id, at, precision``, and ``granularity`` if there are dates without times: these
    differ from any other time on another day (of ``temporal``'s zone). Other precisions are not compared.
    """
    times = times if "granularity" in times.columns else times.withColumn("granularity", F.lit("TIME"))
    side = lambda x: times.select("case_id", "event_key", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "at", "precision", "granularity")])
    pairs = side("a").join(side("b"), ["case_id", "event_key"]).where("id_a < id_b")
    low, high = F.least("precision_a", "precision_b"), F.greatest("precision_a", "precision_b")
    allowed = F.lit(None).cast("int")
    for (x, y), minutes in TOLERANCE_MINUTES.items():
        allowed = F.when((low == x) & (high == y), minutes).otherwise(allowed)
    apart = F.abs(F.unix_seconds("at_a") - F.unix_seconds("at_b")) / 60
    day = lambda x: F.floor((F.unix_seconds(f"at_{x}") + ZONE_SECONDS) / 86_400)
    dates = (F.col("granularity_a") == "DATE") | (F.col("granularity_b") == "DATE")
    differ = F.when(dates, allowed.isNotNull() & (day("a") != day("b"))).otherwise(apart > allowed)
    return pairs.where(differ).select("case_id", "event_key", "id_a", "id_b", apart.alias("minutes"))


def several_values(facts: DataFrame, by: list[str], field_type: str) -> DataFrame:
    """Groups that state more than one value of a type."""
    own = facts.where(F.col("field_type") == field_type).groupBy(*by).agg(F.array_sort(F.collect_set("normalized_value")).alias("found"))
    return own.where(F.size("found") > 1)


def amount_contradictions(links: DataFrame, statements: DataFrame | None = None) -> DataFrame:
    """Transactions whose amounts differ: ``case_id, transaction_id, amounts`` (canonical, sorted).

    ``links``: ``case_id, transaction_id, amount``, one for each AMOUNT_OF edge; ``statements``: the same, for amounts that a user stated.
    """
    every = links.select("case_id", "transaction_id", "amount")
    if statements is not None:
        every = every.unionByName(statements.select("case_id", "transaction_id", "amount"))
    out = every.where("amount is not null").groupBy("case_id", "transaction_id").agg(F.array_sort(F.collect_set("amount")).alias("amounts"))
    return out.where(F.size("amounts") > 1)


def transaction_contradictions(events: DataFrame) -> DataFrame:
    """Payments and debits of more than one transaction: ``case_id, event_key, transactions``. ``events``: ``case_id, event_key, event_type, transaction_id``."""
    out = events.where(F.col("event_type").isin(*MONEY_EVENTS)).groupBy("case_id", "event_key").agg(F.array_sort(F.collect_set("transaction_id")).alias("transactions"))
    return out.where(F.size("transactions") > 1)


def urgency(high: Column, medium: Column) -> Column:
    return F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW")


def urgency_violations(assessed: DataFrame, signals: DataFrame) -> DataFrame:
    """Assessments (``case_id, level``) that their signals (``case_id, signal`` U1 or U2) don't give: ``case_id, level, expected``."""
    said = signals.groupBy("case_id").agg(F.bool_or(F.col("signal") == "U1").alias("u1"), F.bool_or(F.col("signal") == "U2").alias("u2"))
    expected = urgency(F.coalesce("u1", F.lit(False)), F.coalesce("u2", F.lit(False)))
    return assessed.join(said, "case_id", "left").withColumn("expected", expected).where(~F.col("level").eqNullSafe(F.col("expected"))).select("case_id", "level", "expected")


# Fields of the checklist, the variants they belong to, and how one that is missing is asked for.
CHECKLIST = (
    ("INCIDENT_DATETIME", ("FINANCIAL", "ALL_INCIDENTS"), "QUESTION", True),
    ("INCIDENT_DETAILS", ("FINANCIAL", "ALL_INCIDENTS"), "QUESTION", False),
    ("IDENTITY_DOCUMENT", ("FINANCIAL", "ALL_INCIDENTS"), "INFORMATIONAL", False),
    ("BANK_WALLET_MERCHANT", ("FINANCIAL",), "QUESTION", True),
    ("TRANSACTION_ID_UTR", ("FINANCIAL",), "QUESTION", False),
    ("TRANSACTION_DATE", ("FINANCIAL",), "QUESTION", False),
    ("FRAUD_AMOUNT", ("FINANCIAL",), "QUESTION", False),
    ("RELEVANT_EVIDENCE", ("FINANCIAL", "ALL_INCIDENTS"), "HINT", False),
    ("SUSPECT_DETAILS", ("FINANCIAL", "ALL_INCIDENTS"), "OPTIONAL", False),
)
SUSPECT_TYPES = ("PHONE", "URL", "UPI_ID", "EMAIL", "MESSAGING_HANDLE", "SMS_SENDER_HEADER")
MONEY_EVENTS = ("PAYMENT_INITIATED", "DEBIT_NOTIFICATION")
# Actions by what calls for them, in the order of their templates.
ACTIONS = (("CONTACT_BANK", "U1", 1), ("CONTACT_BANK", "U2", 1), ("REPORT_1930_NCRP", "U1", 2), ("REPORT_CYBERCRIME_NCRP", "LABELLED_WITHOUT_LOSS", 2), ("PRESERVE_EVIDENCE", "PROCESSED_ITEM", 3), ("REPORT_SUSPECT_NCRP", "SUSPECT", 4))


def required_fields(spark: SparkSession) -> DataFrame:
    """``variant, field, ask, high_value``: the checklist as a table of 14 rows."""
    return spark.createDataFrame([(v, field, ask, high) for field, variants, ask, high in CHECKLIST for v in variants], "variant string, field string, ask string, high_value boolean")


def signals_of(entities: DataFrame, events: DataFrame, detections: DataFrame) -> DataFrame:
    """``case_id, signal``: U1 where a loss is reported, U2 where a code was asked for or found.

    ``entities``: ``case_id, field_type, tied`` (an amount tied to a transaction or payment event); ``events``: ``case_id, event_type, from_evidence``;
    ``detections``: ``case_id, kind``.
    """
    loss = entities.where("field_type = 'AMOUNT' and tied").select("case_id", F.lit("U1").alias("signal"))
    asked = events.where("event_type = 'CREDENTIAL_OTP_REQUEST' and from_evidence").select("case_id", F.lit("U2").alias("signal"))
    code = detections.where("kind = 'OTP'").select("case_id", F.lit("U2").alias("signal"))
    return loss.unionByName(asked).unionByName(code).distinct()


def present_fields(cases: DataFrame, entities: DataFrame, events: DataFrame) -> DataFrame:
    """``case_id, field`` of the checklist fields that a case has facts for; an identity document is never collected.

    ``cases``: ``case_id, summary, n_processed, incident_time, n_missing_evidence``; ``entities`` as in ``signals_of``, ``events`` with ``precision, day``.
    """
    money = F.col("event_type").isin(*MONEY_EVENTS)
    of = lambda rows, test, field: rows.where(test).select("case_id", F.lit(field).alias("field"))
    parts = [
        of(events, F.col("precision").isin("EXACT", "APPROXIMATE"), "INCIDENT_DATETIME"),
        of(cases, F.col("incident_time").isNotNull(), "INCIDENT_DATETIME"),
        of(cases, (F.coalesce(F.trim("summary"), F.lit("")) != "") | (F.col("n_processed") > 0), "INCIDENT_DETAILS"),
        of(cases, F.col("n_missing_evidence") == 0, "RELEVANT_EVIDENCE"),
        of(entities, F.col("field_type") == "BANK_OR_WALLET", "BANK_WALLET_MERCHANT"),
        of(entities, F.col("field_type") == "TRANSACTION", "TRANSACTION_ID_UTR"),
        of(events, money & F.col("day").isNotNull(), "TRANSACTION_DATE"),
        of(entities, (F.col("field_type") == "AMOUNT") & F.col("tied"), "FRAUD_AMOUNT"),
        of(entities, F.col("field_type").isin(*SUSPECT_TYPES), "SUSPECT_DETAILS"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def variants(cases: DataFrame, signals: DataFrame) -> DataFrame:
    """``case_id, variant``: FINANCIAL where a loss is reported, else ALL_INCIDENTS."""
    loss = signals.where("signal = 'U1'").select("case_id", F.lit("FINANCIAL").alias("variant")).distinct()
    return cases.select("case_id").distinct().join(loss, "case_id", "left").fillna("ALL_INCIDENTS", "variant")


def checklist(cases: DataFrame, present: DataFrame, required: DataFrame) -> DataFrame:
    """Required fields (``variant, field, ...``) that a case (``case_id, variant``) has no fact for (``case_id, field``)."""
    wanted = cases.select("case_id", "variant").join(F.broadcast(required), "variant")
    return wanted.join(present.select("case_id", "field").distinct(), ["case_id", "field"], "left_anti").select("case_id", "field", *[c for c in required.columns if c not in ("variant", "field")])


def action_triggers(signals: DataFrame, labels: DataFrame, evidence: DataFrame, entities: DataFrame) -> DataFrame:
    """``case_id, trigger`` for the actions: signals, labels other than UNKNOWN_OTHER without a loss, processed items, suspects."""
    loss = signals.where("signal = 'U1'").select("case_id").distinct()
    labelled = labels.where("label <> 'UNKNOWN_OTHER'").select("case_id").distinct().join(loss, "case_id", "left_anti")
    one = lambda rows, name: rows.select("case_id", F.lit(name).alias("trigger"))
    out = signals.select("case_id", F.col("signal").alias("trigger")).unionByName(one(labelled, "LABELLED_WITHOUT_LOSS"))
    return out.unionByName(one(evidence.where("status = 'PROCESSED'"), "PROCESSED_ITEM")).unionByName(one(entities.where(F.col("field_type").isin(*SUSPECT_TYPES)), "SUSPECT")).distinct()


def action_templates(spark: SparkSession) -> DataFrame:
    """``action, trigger, rank, template``: five actions, ties by the order of templates."""
    order = list(dict.fromkeys(a for a, _, _ in ACTIONS))
    return spark.createDataFrame([(a, t, r, order.index(a)) for a, t, r in ACTIONS], "action string, trigger string, rank int, template int")


def capped_confidence(confidence: Column, precision: Column) -> Column:
    cap = F.when(precision == "APPROXIMATE", CONFIDENCE_CAPS["APPROXIMATE"]).when(precision == "INFERRED_ORDER_ONLY", CONFIDENCE_CAPS["INFERRED_ORDER_ONLY"]).otherwise(1.0)
    return F.least(confidence, cap)


def event_key(kind: Column, ids: Column) -> Column:
    """Type and sorted distinct ids: equal for the same occurrence."""
    return F.concat_ws("|", kind, F.array_join(F.array_sort(F.array_distinct(ids)), ","))


# Our choice: cues of indicators; none are prescribed.
INDICATORS = {
    "URGENT_LANGUAGE": r"(?i)\b(?:urgent|immediately|within 24 hours|last warning)\b",
    "ACCOUNT_THREAT": r"(?i)\b(?:blocked|suspended|deactivated)\b",
    "CREDENTIAL_REQUEST": r"(?i)\b(?:otp|pin|password|cvv)\b",
    "PAYMENT_REQUEST": r"(?i)\b(?:pay|transfer|send money|upi id)\b",
}


def indicators(lines: DataFrame) -> DataFrame:
    """``doc_id, indicator, line_number`` of the first line with each cue."""
    found = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(k)) for k, p in INDICATORS.items()]))
    return lines.select("doc_id", "line_number", F.explode(found).alias("indicator")).groupBy("doc_id", "indicator").agg(F.min("line_number").alias("line_number"))


def label_violations(labels: DataFrame) -> DataFrame:
    """Cases whose labels don't fit: exactly one is primary, and UNKNOWN_OTHER stands alone. ``labels``: ``case_id, label, is_primary``."""
    out = labels.groupBy("case_id").agg(F.count_if("is_primary").alias("primaries"), F.count("*").alias("n"), F.bool_or(F.col("label") == "UNKNOWN_OTHER").alias("unknown"))
    return out.where((F.col("primaries") != 1) | (F.col("unknown") & (F.col("n") > 1))).select("case_id")


def ranked_actions(triggers: DataFrame, templates: DataFrame) -> DataFrame:
    """Actions of each case in the order of their ranks, then of ``template`` if there is one: ``case_id, action, position``."""
    ties = "template" if "template" in templates.columns else "action"
    hit = triggers.select("case_id", "trigger").distinct().join(F.broadcast(templates), "trigger").groupBy("case_id", "action").agg(F.min("rank").alias("rank"), F.min(ties).alias("tie"))
    return hit.select("case_id", "action", F.row_number().over(Window.partitionBy("case_id").orderBy("rank", "tie", "action")).alias("position"))
