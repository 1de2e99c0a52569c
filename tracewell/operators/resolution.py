"""Entities of cases from facts and their corrections.

A fact is ``case_id, fact_id, evidence_no, evidence_status, field_type, raw_value, normalized_value, status,
corrected_value``; ``corrected_value`` is null where nobody corrected it. A corrected fact counts with its corrected
value, normalised anew. Entities are grouped by case, type and value; banks compare without case and keep the spelling
of an earlier entity, or of the first fact. Facts with nulls in ``case_id`` or without a value belong to no entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

KEY = ["case_id", "field_type", "entity_key"]


def effective_value(field_type: Column, normalized: Column, corrected: Column) -> Column:
    return F.when(F.coalesce(corrected, F.lit("")) != "", T.normalize(field_type, corrected)).otherwise(normalized)


def entity_key(field_type: Column, value: Column) -> Column:
    return F.when(field_type == "BANK_OR_WALLET", F.lower(value)).otherwise(value)


def eligible(facts: DataFrame) -> DataFrame:
    """Facts that can belong to an entity, with ``value`` and ``entity_key``."""
    some = facts.where("field_type <> 'DATETIME' and evidence_status = 'PROCESSED' and status = 'NORMALIZED' and case_id is not null")
    some = some.withColumn("value", effective_value(F.col("field_type"), F.col("normalized_value"), F.col("corrected_value"))).where("value is not null")
    return some.withColumn("entity_key", entity_key(F.col("field_type"), F.col("value")))


def resolve(facts: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """``case_id, field_type, entity_key, canonical_value, masked_value, amount_minor, n_facts, created``.

    ``previous``: ``case_id, field_type, canonical_value`` of entities that are there already; those are not created.
    """
    first = F.struct("evidence_no", "field_type", "raw_value", "fact_id")
    out = eligible(facts).groupBy(*KEY).agg(F.min_by("value", first).alias("first_value"), F.count("*").alias("n_facts"))
    if previous is None:
        out = out.withColumn("old_value", F.lit(None).cast("string"))
    else:
        old = previous.withColumn("entity_key", entity_key(F.col("field_type"), F.col("canonical_value")))
        out = out.join(old.groupBy(*KEY).agg(F.min("canonical_value").alias("old_value")), KEY, "left")
    canonical = F.coalesce("old_value", "first_value")
    amount = F.when(F.col("field_type") == "AMOUNT", T.amount_minor(canonical))
    return out.select(*KEY, canonical.alias("canonical_value"), T.mask(F.col("field_type"), canonical).alias("masked_value"), amount.alias("amount_minor"), "n_facts", F.col("old_value").isNull().alias("created"))


def assign(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Every fact with its entity's canonical value; null for those that belong to none."""
    own = eligible(facts).select("fact_id", *KEY).join(entities.select(*KEY, "canonical_value"), KEY)
    return facts.select("fact_id", "case_id", "field_type").join(own.select("fact_id", "canonical_value"), "fact_id", "left")


def summary(entities: DataFrame) -> DataFrame:
    """``case_id, created, linked``: new entities and facts with an entity."""
    return entities.groupBy("case_id").agg(F.count_if("created").alias("created"), F.sum("n_facts").alias("linked"))


def unmerged(facts: DataFrame) -> DataFrame:
    """Facts other than times that no normal form could be given."""
    value = effective_value(F.col("field_type"), F.col("normalized_value"), F.col("corrected_value"))
    return facts.where("field_type <> 'DATETIME'").where(value.isNull() | (F.col("status") != "NORMALIZED")).select("case_id", "fact_id", "field_type")


def correct(facts: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections (``fact_id, new_value``) with ``outcome``: UNKNOWN_FACT, FORMAT, UNCHANGED or CHANGED, and the fact's normal value before and after."""
    before = effective_value(F.col("field_type"), F.col("normalized_value"), F.col("corrected_value"))
    known = corrections.join(facts.select("fact_id", "field_type", before.alias("before")), "fact_id", "left")
    after = F.when(F.trim("new_value") != "", T.normalize(F.col("field_type"), F.trim("new_value")))
    outcome = F.when(F.col("field_type").isNull(), "UNKNOWN_FACT").when(after.isNull(), "FORMAT").when(after.eqNullSafe(F.col("before")), "UNCHANGED").otherwise("CHANGED")
    return known.select("fact_id", outcome.alias("outcome"), "before", after.alias("after"))


def apply_corrections(facts: DataFrame, corrections: DataFrame) -> DataFrame:
    """Facts with the corrections that were accepted; the original value stays beside."""
    taken = correct(facts, corrections).where("outcome in ('CHANGED', 'UNCHANGED')").join(corrections, "fact_id").select("fact_id", F.trim("new_value").alias("_new"))
    return facts.join(taken, "fact_id", "left").withColumn("corrected_value", F.coalesce("_new", "corrected_value")).drop("_new")


def invalidate(sources: DataFrame, corrected: DataFrame) -> DataFrame:
    """Sources (``edge_id, fact_id, evidence_id``) that stay when facts (``fact_id, evidence_id``) are corrected.

    Of every edge that a corrected fact supports, the sources of that fact's item go; other items' support stays. An
    edge that has no source left is gone with them.
    """
    touched = sources.join(corrected.select("fact_id"), "fact_id", "left_semi").select("edge_id").distinct()
    hit = touched.join(sources.join(corrected.select("fact_id", F.col("evidence_id").alias("_item")), "fact_id").select("edge_id", "_item").distinct(), "edge_id")
    return sources.join(hit.select("edge_id", F.col("_item").alias("evidence_id")), ["edge_id", "evidence_id"], "left_anti")
