"""Steps and states of a run: numbering, dependencies, reuse, gates, rewinds, removal, activity, integrity, invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relational import latest
from .case import STEPS, rank

# What each step waits for.
DEPENDENCIES = {
    "PARSE": ("PLAN",),
    "EXTRACT": ("PARSE",),
    "NORMALIZE": ("EXTRACT",),
    "SCAM_ANALYSIS": ("NORMALIZE",),
    "CORRELATE": ("NORMALIZE",),
    "TIMELINE": ("SCAM_ANALYSIS", "CORRELATE"),
    "MISSING_INFO": ("TIMELINE",),
    "ACTIONS": ("MISSING_INFO",),
    "URGENCY": ("ACTIONS",),
}
# From which state to which a run may advance a case, and the steps it needs.
ADVANCES = (("EXTRACTED", "ANALYZING", ("SCAM_ANALYSIS",)), ("ANALYZING", "CORRELATED", ("SCAM_ANALYSIS", "CORRELATE")), ("CORRELATED", "TIMELINE_READY", ("TIMELINE",)), ("TIMELINE_READY", "ACTIONS_READY", ("MISSING_INFO", "ACTIONS", "URGENCY")))


def dependencies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, d) for s, needs in DEPENDENCIES.items() for d in needs], "step_name string, needs string")


def ready_steps(steps: DataFrame, needs: DataFrame) -> DataFrame:
    """Pending steps all of whose dependencies in the run are done: ``run_id, step_name``. ``steps``: ``run_id, step_name, status``, a row for each item where there are items."""
    done = steps.groupBy("run_id", "step_name").agg(F.bool_and(F.col("status").isin("SUCCEEDED", "SKIPPED")).alias("done"))
    waiting = steps.where("status = 'PENDING'").select("run_id", "step_name").distinct().join(F.broadcast(needs), "step_name", "left")
    found = waiting.join(done.select("run_id", F.col("step_name").alias("needs"), "done"), ["run_id", "needs"], "left")
    return found.groupBy("run_id", "step_name").agg(F.bool_and(F.col("needs").isNull() | F.coalesce("done", F.lit(False))).alias("ready")).where("ready").select("run_id", "step_name")


def numbered_steps(items: DataFrame) -> DataFrame:
    """The steps of each run with their places: PLAN 1, then PARSE of each item, EXTRACT of each item, and the case's own steps. ``items``: ``run_id, item_id``."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("item_id"))
    n = F.count("*").over(Window.partitionBy("run_id"))
    per = items.withColumn("k", place).withColumn("n", n)
    each = per.select("run_id", F.col("item_id"), F.inline(F.array(F.struct(F.lit("PARSE").alias("step_name"), (F.col("k") + 1).cast("bigint").alias("sequence_no")), F.struct(F.lit("EXTRACT").alias("step_name"), (F.col("k") + 1 + F.col("n")).alias("sequence_no")))))
    own = F.transform(F.array(*map(F.lit, STEPS[3:])), lambda s, i: F.struct(s.alias("step_name"), (2 + 2 * F.col("n") + i).alias("sequence_no")))
    case = items.groupBy("run_id").agg(F.count("*").alias("n")).select("run_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.inline(F.concat(F.array(F.struct(F.lit("PLAN").alias("step_name"), F.lit(1).cast("bigint").alias("sequence_no"))), own)))
    return each.unionByName(case)


def done_steps(steps: DataFrame) -> DataFrame:
    """Steps that are done: succeeded, or skipped because they reuse one that succeeded on the same input. ``steps``: ``step_id, run_id, step_name, status, input_hash, reused_step_id``."""
    good = steps.where("status = 'SUCCEEDED'")
    reused = good.select(F.col("step_id").alias("reused_step_id"), F.col("step_name").alias("r_name"), F.col("input_hash").alias("r_hash"))
    skipped = steps.where("status = 'SKIPPED'").join(reused, "reused_step_id").where((F.col("step_name") == F.col("r_name")) & F.col("input_hash").eqNullSafe(F.col("r_hash")))
    return good.select("run_id", "step_id", "step_name").unionByName(skipped.select("run_id", "step_id", "step_name"))


def advanced(state: Column, done: Column) -> Column:
    """Where a case gets from ``state`` when the steps in the array ``done`` are done: gate after gate."""
    for before, after, needs in ADVANCES:
        state = F.when((state == before) & F.forall(F.array(*map(F.lit, needs)), lambda s: F.array_contains(done, s)), after).otherwise(state)
    return state


def rewound(state: Column, to: Column) -> Column:
    """A case that is beyond ``to`` goes back there; one that isn't stays."""
    return F.when(rank(state) > rank(to), to).otherwise(state)


def voided(confirmations: DataFrame, rewinds: DataFrame) -> DataFrame:
    """Active confirmations of cases that go back: ``confirmation_id, case_id``. ``rewinds``: ``case_id, state, to``."""
    back = rewinds.where(rank(F.col("state")) > rank(F.col("to"))).select("case_id")
    return confirmations.where("voided_at is null").join(back, "case_id", "left_semi").select("confirmation_id", "case_id")


def settled(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """The state of each case after items were removed: NEW without any, else INGESTING."""
    some = evidence.select("case_id").distinct().withColumn("some", F.lit(True))
    return cases.select("case_id").join(some, "case_id", "left").select("case_id", F.when(F.col("some"), "INGESTING").otherwise("NEW").alias("state"))


def evidence_gate(evidence: DataFrame) -> DataFrame:
    """Whether a case's items let it go on: some, and all processed. ``case_id, passes, failed``."""
    return evidence.groupBy("case_id").agg(F.bool_and(F.col("processing_status") == "PROCESSED").alias("passes"), F.bool_or(F.col("processing_status") == "FAILED").alias("failed"))


def activity(runs: DataFrame, steps: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per case: its latest run, the run's steps in order, and how many of its items are processed. Items that are still being uploaded don't count."""
    run = latest(runs, ["case_id"], [F.col("created_at").desc(), F.col("run_id").desc()]).select("case_id", "run_id", "status")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("sequence_no", "step_name", "step_status"))), lambda x: F.concat_ws(":", x["step_name"], x["step_status"]))
    own = steps.groupBy("run_id").agg(F.array_join(listed, ",").alias("steps"))
    progress = evidence.groupBy("case_id").agg(F.count_if(F.col("processing_status") == "PROCESSED").alias("processed"), F.count_if(F.col("processing_status") != "UPLOADING").alias("total"))
    return run.join(own, "run_id", "left").join(progress, "case_id", "left").na.fill(0, ["processed", "total"])


def integrity_status(evidence: DataFrame, checks: DataFrame) -> DataFrame:
    """Each item's latest result, NOT_YET_VERIFIED without any. ``checks``: ``evidence_id, checked_at, check_id, result``."""
    last = latest(checks, ["evidence_id"], [F.col("checked_at").desc(), F.col("check_id").desc()]).select("evidence_id", "result")
    return evidence.select("evidence_id").join(last, "evidence_id", "left").select("evidence_id", F.coalesce("result", F.lit("NOT_YET_VERIFIED")).alias("result"))


def without_sources(facts: DataFrame, sources: DataFrame, key: str, kinds: tuple[str, ...] | None = None, least: int = 1) -> DataFrame:
    """Derived facts with fewer than ``least`` distinct sources of the given kinds; a sound store has none."""
    some = sources if kinds is None else sources.where(F.col("source_kind").isin(*kinds))
    enough = some.groupBy(key).agg(F.count_distinct("source_id").alias("n")).where(F.col("n") >= least)
    return facts.select(key).join(enough, key, "left_anti")


def stale_urgency(reasons: DataFrame, sources: DataFrame) -> DataFrame:
    """Cases whose urgency must be judged again: a reason of theirs has lost its last source. ``reasons``: ``case_id, reason_id``."""
    return reasons.join(sources.select("reason_id").distinct(), "reason_id", "left_anti").select("case_id").distinct()


def missing_parts(events: DataFrame, sources: DataFrame) -> DataFrame:
    """``case_id, event_id, missing``: MISSING_TIMESTAMP for events without a time, MISSING_EVIDENCE for those without a source."""
    no_time = events.where("at is null").select("case_id", "event_id", F.lit("MISSING_TIMESTAMP").alias("missing"))
    bare = events.join(sources.select("event_id").distinct(), "event_id", "left_anti")
    return no_time.unionByName(bare.select("case_id", "event_id", F.lit("MISSING_EVIDENCE").alias("missing")))


def attached(fragments: DataFrame, facts: DataFrame, kinds: tuple[str, ...] = ("AMOUNT", "TRANSACTION", "UPI_ID", "PHONE"), most: int = 80) -> DataFrame:
    """Facts that belong to an event's fragment: on its line, within ``most`` characters, and of the event's type where both tables have ``event_type``.

    ``fragments``: ``event_id, doc_id, line_number, start, end``.
    """
    typed = "event_type" in fragments.columns and "event_type" in facts.columns
    own = facts.where(F.col("field_type").isin(*kinds)).select("doc_id", "line_number", "fact_id", F.col("start").alias("f_start"), F.col("end").alias("f_end"), *["event_type"] * typed)
    gap = F.greatest(F.col("f_start") - F.col("end"), F.col("start") - F.col("f_end"), F.lit(0))
    return fragments.join(own, ["doc_id", "line_number", *["event_type"] * typed]).where(gap <= most).select("event_id", "fact_id", gap.alias("distance"))
