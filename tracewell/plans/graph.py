"""Graph read model, timelines and report snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.temporal import ZONE

# Types of events, in the order that breaks ties.
EVENT_TYPES = ("MESSAGE_RECEIVED", "MESSAGE_SENT", "CALL", "LINK_OPENED", "CREDENTIAL_OTP_REQUEST", "CREDENTIALS_OR_OTP_SHARED", "PAYMENT_REQUESTED", "PAYMENT_INITIATED", "DEBIT_NOTIFICATION", "OTHER")


def nodes(cases: DataFrame, evidence: DataFrame, entities: DataFrame) -> DataFrame:
    """``case_id, node_id, kind, label``: the case, its evidence and its entities, whose labels are masked."""
    one = lambda df, prefix, key, kind, label: df.select("case_id", F.concat(F.lit(prefix), F.col(key).cast("string")).alias("node_id"), F.lit(kind).alias("kind"), F.col(label).cast("string").alias("label"))
    return one(cases, "c:", "case_id", "CASE", "case_id").unionByName(one(evidence, "e:", "evidence_id", "EVIDENCE", "evidence_id")).unionByName(one(entities, "n:", "entity_id", "ENTITY", "masked_value"))


def edges(appears_in: DataFrame, relations: DataFrame) -> DataFrame:
    """``case_id, from_node, to_node, kind``: entities to the evidence they appear in, and to each other."""
    a = appears_in.select("case_id", F.concat(F.lit("n:"), F.col("entity_id").cast("string")).alias("from_node"), F.concat(F.lit("e:"), F.col("evidence_id").cast("string")).alias("to_node"), F.lit("APPEARS_IN").alias("kind")).distinct()
    b = relations.select("case_id", F.concat(F.lit("n:"), F.col("from_entity").cast("string")).alias("from_node"), F.concat(F.lit("n:"), F.col("to_entity").cast("string")).alias("to_node"), F.col("relation").alias("kind"))
    return a.unionByName(b)


def timeline(events: DataFrame) -> DataFrame:
    """Events of a case in order, as ``position`` from 1.

    Events with a time go by it, then by precision, place in the evidence, type and id. One whose order alone is known
    follows the event it names (``after_event``) at once, if that one is of its case and has a time; several that follow one
    event go by place in the evidence, type and id; those without such a predecessor come last. ``events``: ``case_id,
    event_id, at, precision, evidence_ref, line_number``, and ``event_type, page, after_event`` if known.
    """
    for name, kind in (("event_type", "string"), ("page", "int"), ("after_event", dict(events.dtypes)["event_id"])):
        events = events if name in events.columns else events.withColumn(name, F.lit(None).cast(kind))
    exact = F.when(F.col("precision") == "EXACT", 0).when(F.col("precision") == "APPROXIMATE", 1).otherwise(2)
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")), F.lit(0)).cast("int")
    place = ["evidence_ref", "page", "line_number", F.when(kind == 0, len(EVENT_TYPES) + 1).otherwise(kind), "event_id"]
    timed = F.col("at").isNotNull()
    dated = events.where(timed).withColumn("_anchor", F.row_number().over(Window.partitionBy("case_id").orderBy("at", exact, *place))).withColumn("_after", F.lit(0))
    anchors = dated.select("case_id", F.col("event_id").alias("after_event"), F.col("_anchor")).dropDuplicates(["case_id", "after_event"])
    rest = events.where(~timed).join(anchors, ["case_id", "after_event"], "left").withColumn("_after", F.lit(1))
    order = Window.partitionBy("case_id").orderBy(F.col("_anchor").asc_nulls_last(), "_after", exact, *place)
    return dated.unionByName(rest.select(*dated.columns)).withColumn("position", F.row_number().over(order)).drop("_anchor", "_after")


def times_of(facts: DataFrame) -> DataFrame:
    """What a case's DATETIME, DATE and TIME facts say of when: adds ``day, at, precision, granularity``.

    A full one is as exact as it says. A time takes the last date before it in its evidence and stays as exact as it says;
    else the only day that the case's dated facts name, which makes it approximate; else its order alone is known.
    A date alone is approximate and stands for the start of its day, for order only (``granularity`` DATE). ``facts``: ``case_id,
    evidence_id, line_number, start, kind, value`` with canonical values, and ``precision`` if known; the zone is ``temporal``'s.
    """
    facts = facts if "precision" in facts.columns else facts.withColumn("precision", F.lit("EXACT"))
    before = Window.partitionBy("case_id", "evidence_id").orderBy("line_number", "start").rowsBetween(Window.unboundedPreceding, -1)
    own = F.last(F.when(F.col("kind") == "DATE", F.col("value")), ignorenulls=True).over(before)
    day = F.when(F.col("kind").isin("DATE", "DATETIME"), F.substring("value", 1, 10))
    days = facts.groupBy("case_id").agg(F.count_distinct(day).alias("n_days"), F.max(day).alias("only_day"))
    out = facts.withColumn("own_day", own).join(days, "case_id")
    time, stated = F.col("kind") == "TIME", F.coalesce("precision", F.lit("EXACT"))
    precision = F.when(F.col("kind") == "DATETIME", stated).when(F.col("kind") == "DATE", "APPROXIMATE").when(F.col("own_day").isNotNull(), stated).when(F.col("n_days") == 1, "APPROXIMATE").otherwise("INFERRED_ORDER_ONLY")
    found = F.when(time, F.coalesce("own_day", F.when(F.col("n_days") == 1, F.col("only_day")))).otherwise(day)
    clock = F.when(F.col("kind") == "DATETIME", F.substring("value", 11, 6)).when(time, F.col("value")).otherwise("T00:00")
    at = F.try_to_timestamp(F.concat(found, clock, F.lit(ZONE)), F.lit("yyyy-MM-dd'T'HH:mmXXX"))
    return out.withColumn("day", found).withColumn("at", at).withColumn("precision", precision).withColumn("granularity", F.when(F.col("kind") == "DATE", "DATE").otherwise("TIME")).drop("own_day", "n_days", "only_day")


def assign_times(facts: DataFrame) -> DataFrame:
    """``times_of`` for the TIME facts alone."""
    return times_of(facts).where("kind = 'TIME'")


def snapshot(sections: DataFrame) -> DataFrame:
    """One canonical document for each case and its hash: ``case_id, section, content`` become sorted JSON."""
    body = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "content")))))
    return sections.groupBy("case_id").agg(body.alias("snapshot")).withColumn("sha256", F.sha2(F.col("snapshot").cast("binary"), 256))
