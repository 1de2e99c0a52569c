"""Case read models and state: overview, run plans, transitions, step reuse, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import latest

# States in their order, steps of a full run in theirs.
STATES = ("NEW", "INGESTING", "EXTRACTED", "ANALYZING", "CORRELATED", "TIMELINE_READY", "ACTIONS_READY", "REPORT_DRAFT", "USER_REVIEW", "EXPORTED")
STEPS = ("PLAN", "PARSE", "EXTRACT", "NORMALIZE", "SCAM_ANALYSIS", "CORRELATE", "TIMELINE", "MISSING_INFO", "ACTIONS", "URGENCY")
REWINDS = ("EXTRACTED", "TIMELINE_READY", "ACTIONS_READY")
DRAFT_AGAIN = ("USER_REVIEW", "EXPORTED")


def rank(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATES)), status)


def allowed(before: Column, after: Column) -> Column:
    """Whether a case may go from one state to another: one step on, back to a state that allows it, or to new evidence."""
    one_on = rank(after) == rank(before) + 1
    back = after.isin(*REWINDS) & (rank(before) > rank(after))
    return after.isin("NEW", "INGESTING") | one_on | back | ((after == "REPORT_DRAFT") & before.isin(*DRAFT_AGAIN))


def transitions(spark: SparkSession) -> DataFrame:
    """All pairs of states: ``before, after, allowed``."""
    states = spark.createDataFrame([(s,) for s in STATES], "before string")
    return states.withColumn("after", F.explode(F.array(*map(F.lit, STATES)))).withColumn("allowed", allowed(F.col("before"), F.col("after")))


def plan_steps(trigger: Column, state: Column, time_changed: Column) -> Column:
    """The steps of a run: PLAN, then all from where the trigger re-enters."""
    correction = F.when((state == "TIMELINE_READY") & time_changed, "MISSING_INFO").when(state == "TIMELINE_READY", "ACTIONS").otherwise("NORMALIZE")
    start = F.when(trigger == "ANSWER", F.when(time_changed, "TIMELINE").otherwise("MISSING_INFO")).when(trigger == "CORRECTION", correction).otherwise("PARSE")
    steps = F.array(*map(F.lit, STEPS))
    return F.concat(F.array(F.lit("PLAN")), F.slice(steps, F.array_position(steps, start).cast("int"), len(STEPS)))


def overview(cases: DataFrame, evidence: DataFrame, runs: DataFrame, entities: DataFrame) -> DataFrame:
    """One row per case: evidence counts by status, latest run, entity counts by type (an empty map without any)."""
    status = ("UPLOADING", "UPLOADED", "PROCESSING", "PROCESSED", "FAILED")
    counts = evidence.groupBy("case_id").agg(F.count("*").alias("evidence_total"), *[F.count_if(F.col("processing_status") == s).alias(f"evidence_{s.lower()}") for s in status])
    run = latest(runs, ["case_id"], [F.col("created_at").desc(), F.col("run_id").desc()]).select("case_id", F.col("run_id").alias("latest_run_id"), F.col("status").alias("latest_run_status"))
    per_type = entities.groupBy("case_id", "field_type").agg(F.count("*").alias("n")).groupBy("case_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field_type", "n")))).alias("entity_counts"))
    out = cases.join(counts, "case_id", "left").join(run, "case_id", "left").join(per_type, "case_id", "left")
    out = out.na.fill(0, ["evidence_total", *[f"evidence_{s.lower()}" for s in status]])
    return out.withColumn("entity_counts", F.coalesce("entity_counts", F.create_map().cast("map<string,bigint>")))


def full_overview(cases: DataFrame, evidence: DataFrame, runs: DataFrame, entities: DataFrame, steps: DataFrame, reports: DataFrame, confirmations: DataFrame, urgency: DataFrame) -> DataFrame:
    """``overview`` with the failed step of the latest run, the latest and the current report, whether that one is confirmed, and the current urgency.

    The current report is the highest GENERATED one; its confirmation counts unless it was voided. Urgency is out of date where the case has gone back
    before ACTIONS_READY. ``runs`` also have ``failed_step_id``; ``steps``: ``step_id, step_name``; ``reports``: ``report_id, case_id, version, status``;
    ``confirmations``: ``report_id, voided_at``; ``urgency``: ``case_id, level, is_current``; ``cases`` have ``status``.
    """
    run = latest(runs, ["case_id"], [F.col("created_at").desc(), F.col("run_id").desc()]).select("case_id", F.col("failed_step_id").alias("step_id"))
    failed = run.join(steps.select("step_id", F.col("step_name").alias("failed_step")), "step_id", "left").select("case_id", "failed_step")
    done = F.when(F.col("status") == "GENERATED", F.col("version"))
    report = reports.groupBy("case_id").agg(F.max("version").alias("latest_report_version"), F.max_by("status", "version").alias("latest_report_status"), F.max(done).alias("current_report_version"), F.max_by("report_id", done).alias("current_report_id"))
    active = confirmations.where("voided_at is null").select(F.col("report_id").alias("current_report_id"), F.lit(True).alias("has_active_confirmation")).distinct()
    level = urgency.where("is_current").select("case_id", F.col("level").alias("urgency_level"))
    out = overview(cases, evidence, runs, entities).join(failed, "case_id", "left").join(report, "case_id", "left")
    out = out.withColumn("current_report_id", F.when(F.col("current_report_version").isNotNull(), F.col("current_report_id"))).join(active, "current_report_id", "left").join(level, "case_id", "left")
    early = F.col("urgency_level").isNotNull() & (rank(F.col("status")) < STATES.index("ACTIONS_READY"))
    return out.withColumn("has_active_confirmation", F.coalesce("has_active_confirmation", F.lit(False))).withColumn("urgency_out_of_date", F.coalesce(early, F.lit(False)))


def reusable_steps(steps: DataFrame) -> DataFrame:
    """Planned steps that have a succeeded one with the same case, name and input: ``step_id, reuse_id`` (the earliest)."""
    done = steps.where("status = 'SUCCEEDED'").groupBy("case_id", "step_name", "input_hash").agg(F.min("step_id").alias("reuse_id"))
    return steps.where("status = 'PLANNED'").join(done, ["case_id", "step_name", "input_hash"]).select("step_id", "reuse_id")


def without_own_line(facts: DataFrame, fact_lines: DataFrame, lines: DataFrame) -> DataFrame:
    """Facts that no line of their own evidence supports; a sound store has none."""
    owned = fact_lines.join(lines.select("line_id", F.col("evidence_id").alias("line_evidence")), "line_id")
    good = facts.join(owned, "fact_id").where("evidence_id = line_evidence").select("fact_id")
    return facts.join(good, "fact_id", "left_anti")


def attach_sources(owners: DataFrame, refs: DataFrame, extractions: DataFrame, statements: DataFrame, evidence: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source rows (``owner_id, ref_kind, ref_id, line_id, ordinal``) of the owners whose references are all sound, and what is wrong with the others (``owner_id, violation``).

    An owner needs a reference; an entity's are user statements only; a reference is of the owner's case; a cited line is of the
    cited evidence. One bad reference is enough to attach none. ``owners``: ``owner_id, owner_kind, case_id``; ``refs``: ``owner_id,
    ordinal, ref_kind`` (EXTRACTION, USER_STATEMENT or EVIDENCE), ``ref_id, line_id``; the tables that are cited: ``case_id`` and their own id
    (``extraction_id``, ``statement_id``, ``evidence_id``; lines also ``line_id``). Repeated references count once.
    """
    of = lambda rows, key, kind: rows.select(F.lit(kind).alias("ref_kind"), F.col(key).alias("ref_id"), F.col("case_id").alias("ref_case"))
    known = of(extractions, "extraction_id", "EXTRACTION").unionByName(of(statements, "statement_id", "USER_STATEMENT")).unionByName(of(evidence, "evidence_id", "EVIDENCE")).distinct()
    places = lines.select(F.lit("EVIDENCE").alias("ref_kind"), F.col("evidence_id").alias("ref_id"), "line_id", F.lit(True).alias("own_line")).distinct()
    asked = owners.join(refs, "owner_id", "left").join(known.withColumnRenamed("ref_case", "case_id").withColumn("found", F.lit(True)), ["ref_kind", "ref_id", "case_id"], "left").join(places, ["ref_kind", "ref_id", "line_id"], "left")
    wrong = (
        F.when(F.col("ref_kind").isNull(), "NO_SOURCE")
        .when((F.col("owner_kind") == "entity") & (F.col("ref_kind") != "USER_STATEMENT"), "ENTITY_NEEDS_STATEMENT")
        .when(F.col("found").isNull(), "FOREIGN_SOURCE")
        .when((F.col("ref_kind") == "EVIDENCE") & F.col("line_id").isNotNull() & F.col("own_line").isNull(), "FOREIGN_LINE")
    )
    judged = asked.withColumn("violation", wrong)
    violations = judged.where("violation is not null").select("owner_id", "violation").distinct()
    links = judged.join(violations.select("owner_id").distinct(), "owner_id", "left_anti").groupBy("owner_id", "ref_kind", "ref_id", "line_id").agg(F.min("ordinal").alias("ordinal"))
    return links, violations


def verify_integrity(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """MATCH, MISMATCH or COULD_NOT_COMPLETE for each item, by the hash of its bytes."""
    found = files.select("evidence_id", F.sha2("content", 256).alias("found"))
    result = F.when(F.col("found").isNull(), "COULD_NOT_COMPLETE").when(F.col("found") == F.col("sha256"), "MATCH").otherwise("MISMATCH")
    return evidence.join(found, "evidence_id", "left").select("evidence_id", result.alias("result"))


def expired(rows: DataFrame, now: Column, max_attempts: int) -> DataFrame:
    """Challenges that can't be used any more: consumed, out of time or out of attempts."""
    return rows.where(F.col("consumed_at").isNotNull() | (F.col("expires_at") <= now) | (F.col("attempts") >= max_attempts))


def abandoned(evidence: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """Uploads that never finished within their time."""
    return evidence.where((F.col("processing_status") == "UPLOADING") & (F.unix_seconds("created_at") < F.unix_seconds(now) - minutes * 60))


def planned_evidence(evidence: DataFrame, run_created_at: Column) -> DataFrame:
    """Items that a run takes up: uploaded before it, and new or failed in a way that may be retried."""
    fresh = (F.col("processing_status") == "UPLOADED") | ((F.col("processing_status") == "FAILED") & F.col("failure_retryable"))
    return evidence.where((F.col("uploaded_at") <= run_created_at) & fresh)


def input_changes(planned: DataFrame, current: DataFrame) -> DataFrame:
    """Items that were added, removed or changed since a plan was made: ``item_id, change``."""
    a, b = planned.select(F.col("item_id"), F.col("sha256").alias("was")), current.select(F.col("item_id"), F.col("sha256").alias("now"))
    change = F.when(F.col("was").isNull(), "ADDED").when(F.col("now").isNull(), "REMOVED").when(F.col("was") != F.col("now"), "CHANGED")
    return a.join(b, "item_id", "full").select("item_id", change.alias("change")).where("change is not null")


def ordered_fingerprint(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """A hash of each group's rows in order."""
    text = F.to_json(F.array_sort(F.collect_list(F.struct(*order))))
    return rows.groupBy(by).agg(F.sha2(text.cast("binary"), 256).alias("fingerprint"))


def run_outcomes(steps: DataFrame) -> DataFrame:
    """SUCCEEDED, FAILED or RUNNING for each run, and the step a failure is laid to: the first in order, but a changed case before all."""
    failed = F.struct((F.col("failure_code") != "CASE_CHANGED").alias("later"), "sequence_no", "step_name")
    out = steps.groupBy("run_id").agg(F.bool_and(F.col("status").isin("SUCCEEDED", "SKIPPED")).alias("done"), F.min(F.when(F.col("status") == "FAILED", failed)).alias("first"))
    return out.select("run_id", F.when(F.col("first").isNotNull(), "FAILED").when(F.col("done"), "SUCCEEDED").otherwise("RUNNING").alias("outcome"), F.col("first.step_name").alias("failed_step"))


def audit_violations(audit: DataFrame, allowed: DataFrame) -> DataFrame:
    """Metadata of audit rows that no (action, key, pattern) allows: ``audit_id, key``. ``audit``: ``audit_id, action, metadata`` (a map)."""
    rows = audit.select("audit_id", "action", F.explode("metadata").alias("key", "value"))
    good = rows.join(F.broadcast(allowed), ["action", "key"]).where(F.regexp_like("value", F.col("pattern"))).select("audit_id", "key")
    return rows.select("audit_id", "key").join(good, ["audit_id", "key"], "left_anti")
