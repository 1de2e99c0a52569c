"""What the tables of a case must satisfy, as data: each rule names columns and limits, and all rules of a table are checked in one pass.

A rule passes where a column it reads is null, unless it is about nulls itself. Tables and columns that a caller doesn't have are left out:
``check`` takes any DataFrame and applies the rules whose columns are there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import duplicates
from ..operators.relations import IDENTIFIERS
from ..sources.files import HEADERS, MAX_BYTES, MAX_PASTE, MAX_PIXELS

Rule = tuple[str, tuple[str, ...], Callable[..., Column]]


def within(column: str, low=None, high=None) -> Rule:
    test = lambda c: (c >= low if low is not None else F.lit(True)) & (c <= high if high is not None else F.lit(True))
    return f"{column}_range", (column,), test


def longest(column: str, most: int) -> Rule:
    return f"{column}_length", (column,), lambda c: F.length(c) <= most


def shaped(column: str, pattern: str) -> Rule:
    return f"{column}_format", (column,), lambda c: c.rlike(pattern)


def one_of(column: str, *values) -> Rule:
    return f"{column}_value", (column,), lambda c: c.isin(*values)


def filled_where(column: str, by: str, *values) -> Rule:
    """``column`` has a value exactly where ``by`` is one of ``values``."""
    return f"{column}_with_{by}", (column, by), lambda c, b: c.isNotNull() == F.coalesce(b.isin(*values), F.lit(False))


def only_where(column: str, by: str, *values) -> Rule:
    """``column`` may have a value only where ``by`` is one of ``values``."""
    return f"{column}_only_with_{by}", (column, by), lambda c, b: c.isNull() | F.coalesce(b.isin(*values), F.lit(False))


def needed_where(column: str, by: str, *values) -> Rule:
    """``column`` must have a value where ``by`` is one of ``values``."""
    return f"{column}_needed_with_{by}", (column, by), lambda c, b: c.isNotNull() | ~F.coalesce(b.isin(*values), F.lit(False))


def together(a: str, b: str) -> Rule:
    return f"{a}_and_{b}", (a, b), lambda x, y: x.isNull() == y.isNull()


def below(a: str, b: str) -> Rule:
    return f"{a}_before_{b}", (a, b), lambda x, y: x < y


def exactly_one(name: str, *columns: str) -> Rule:
    return name, columns, lambda *cs: reduce(lambda n, c: n + c.isNotNull().cast("int"), cs, F.lit(0)) == 1


PASTED, IMAGES, LOADED = ("TEXT", "URL"), ("PNG", "JPEG"), ("UPLOADED", "PROCESSING", "PROCESSED", "FAILED")
HASH = "^[0-9a-f]{64}$"
# What the audit trail may tell of.
AUDITED = (
    "AUTH_CODE_REQUESTED AUTH_SIGNED_IN AUTH_SIGN_IN_FAILED AUTH_SIGNED_OUT CASE_CREATED CASE_UPDATED CASE_STATUS_CHANGED CASE_DELETED EVIDENCE_UPLOADED EVIDENCE_REJECTED EVIDENCE_VIEWED EVIDENCE_PROCESSING_FAILED EVIDENCE_DELETED "
    "ANALYSIS_STARTED ANALYSIS_STEP_FAILED ANALYSIS_COMPLETED ANALYSIS_FAILED FALLBACK_USED EXTRACTION_CORRECTED TIMELINE_EVENT_CORRECTED TIMELINE_EVENT_ADDED TIMELINE_EVENT_DISMISSED QUESTION_ANSWERED QUESTION_SKIPPED ACTION_STATUS_CHANGED "
    "REPORT_GENERATED REPORT_GENERATION_FAILED REPORT_CONFIRMED REPORT_CONFIRMATION_VOIDED REPORT_INVALIDATED EXPORT_CREATED EXPORT_DOWNLOADED INTEGRITY_VERIFIED"
).split()
# Limits, formats and pairs of the stored tables.
RULES: dict[str, tuple[Rule, ...]] = {
    "users": (longest("email", 254), longest("name", 100), ("email_lower", ("email",), lambda c: c == F.lower(c))),
    "otp_challenges": (below("created_at", "expires_at"), within("max_attempts", 1), within("attempt_count", 0), ("attempts_left", ("attempt_count", "max_attempts"), lambda n, most: n <= most)),
    "sessions": (below("created_at", "expires_at"),),
    "cases": (shaped("case_reference", r"^CF-[0-9]{5,}$"), longest("contact_text", 200), longest("location_text", 200), longest("summary", 2000), filled_where("incident_time", "incident_time_precision", "EXACT", "APPROXIMATE"), ("variant_fits_loss", ("checklist_variant", "financial_loss_reported"), lambda v, loss: (v == "FINANCIAL") == loss)),
    "evidence_items": (
        within("sequence_no", 1, 20), longest("label", 100), longest("original_filename", 255), within("byte_size", 1, MAX_BYTES), within("text_char_count", 1, MAX_PASTE), within("page_count", 1, 20), within("image_width", 1), within("image_height", 1), shaped("sha256", HASH),
        filled_where("paste_kind", "evidence_type", *PASTED), filled_where("text_char_count", "evidence_type", *PASTED), ("filename_unless_pasted", ("original_filename", "evidence_type"), lambda name, kind: name.isNull() == kind.isin(*PASTED)), ("url_is_pasted_as_url", ("evidence_type", "paste_kind"), lambda kind, paste: (kind != "URL") | (paste == "URL")),
        needed_where("byte_size", "processing_status", *LOADED), filled_where("sha256", "processing_status", *LOADED), together("uploaded_at", "sha256"), filled_where("failure_code", "processing_status", "FAILED"), filled_where("failure_retryable", "processing_status", "FAILED"),
        ("pixels", ("image_width", "image_height"), lambda w, h: w.cast("bigint") * h <= MAX_PIXELS), ("size_of_images", ("image_width", "evidence_type", "processing_status"), lambda w, kind, s: w.isNotNull() == (kind.isin(*IMAGES) & (s != "UPLOADING"))), ("pages_of_files", ("page_count", "evidence_type", "processing_status"), lambda n, kind, s: n.isNotNull() == ((kind == "PDF") & (s != "UPLOADING"))),
        ("no_text_layer_is_final", ("failure_code", "failure_retryable"), lambda code, again: ~((code == "PDF_NO_TEXT_LAYER") & again)), ("content_type_once_loaded", ("detected_content_type", "processing_status"), lambda t, s: (s == "UPLOADING") | t.isin("image/png", "image/jpeg", "application/pdf", "text/plain", "message/rfc822")),
    ),
    "parse_results": (within("page_count", 1, 20), filled_where("failure_code", "status", "FAILED")),
    "source_pages": (within("page_number", 1, 20), within("non_whitespace_char_count", 0)),
    "source_lines": (within("line_number", 1), within("ocr_confidence", 0, 1), filled_where("header_name", "location_kind", "EMAIL_HEADER"), one_of("header_name", *HEADERS)),
    "sensitive_detections": (within("char_start", 0), below("char_start", "char_end")),
    "extractions": (
        within("confidence", 0, 1), within("value_amount_minor", 0), longest("source_label", 50), longest("snippet", 200), ("method_is_no_user", ("method",), lambda m: m != "USER"), ("identifiers_rest_on_source", ("field_type", "confidence_basis"), lambda kind, basis: ~kind.isin(*IDENTIFIERS) | (basis == "SOURCE_VALIDATION")),
        needed_where("normalized_value", "normalization_status", "NORMALIZED"), ("no_entity_unless_normal", ("entity_id", "normalization_status"), lambda e, s: e.isNull() | (s != "NOT_NORMALIZED")), together("value_currency", "value_amount_minor"), together("value_datetime_precision", "value_datetime"), ("amounts_have_units", ("value_amount_minor", "field_type", "normalization_status"), lambda v, kind, s: v.isNotNull() == ((kind == "AMOUNT") & (s == "NORMALIZED"))),
        filled_where("corrected_value", "correction_status", "USER_CORRECTED"), filled_where("correction_statement_id", "correction_status", "USER_CORRECTED"),
    ),
    "extraction_source_lines": (within("ordinal", 1),),
    "user_statements": (longest("value_text", 2000), within("value_amount_minor", 0)),
    "entities": (only_where("amount_minor", "entity_type", "AMOUNT"), only_where("currency", "entity_type", "AMOUNT")),
    "relationships": (("two_entities", ("from_entity_id", "to_entity_id"), lambda a, b: a != b),),
    "fact_sources": (
        exactly_one("one_owner", "relationship_id", "timeline_event_id", "scam_signal_id", "missing_info_item_id", "action_item_id", "urgency_reason_id", "entity_id"), only_where("entity_id", "ref_kind", "USER_STATEMENT"), filled_where("extraction_id", "ref_kind", "EXTRACTION"), filled_where("evidence_id", "ref_kind", "EVIDENCE"), only_where("source_line_id", "ref_kind", "EVIDENCE"), filled_where("user_statement_id", "ref_kind", "USER_STATEMENT"), within("ordinal", 1),
    ),
    "timeline_events": (filled_where("event_key", "origin", "AI_GENERATED"), ("time_unless_inferred", ("event_at", "timestamp_precision"), lambda at, p: at.isNull() == (p == "INFERRED_ORDER_ONLY")), longest("time_source_text", 100), longest("description", 300), longest("original_description", 300), within("confidence", 0, 1), *[filled_where(c, "correction_status", "USER_CORRECTED") for c in ("original_event_type", "original_timestamp_precision", "original_description", "correction_statement_id")], only_where("original_event_at", "correction_status", "USER_CORRECTED")),
    "scam_signals": (within("confidence", 0, 1), longest("explanation", 600)),
    "missing_information_items": (
        needed_where("checklist_field", "finding_kind", "MISSING_FIELD"), filled_where("resolution", "status", "RESOLVED"), filled_where("question_text", "question_status", "OPEN", "ANSWERED", "SKIPPED"), filled_where("answer_statement_id", "question_status", "ANSWERED"),
        ("asked_if_of_value", ("question_status", "is_high_value"), lambda asked, high: (asked == "NONE") | high), ("identity_is_never_asked", ("checklist_field", "status", "question_status"), lambda f, s, asked: (f != "IDENTITY_DOCUMENT") | ((s == "INFORMATIONAL") & (asked == "NONE"))),
    ),
    "action_items": (within("priority_rank", 1),),
    "urgency_assessments": (("level_fits_signals", ("level", "signal_u1_financial_loss", "signal_u2_credential_exposure", "rule_version"), lambda level, u1, u2, version: (version != "G2-v1") | (level == F.when(u1, "HIGH").when(u2, "MEDIUM").otherwise("LOW"))),),
    "reports": (
        within("version_number", 1), shaped("content_sha256", HASH), shaped("pdf_sha256", HASH), *[filled_where(c, "status", "GENERATED") for c in ("content", "content_sha256", "pdf_storage_key", "pdf_sha256")], needed_where("generated_at", "status", "GENERATED"), only_where("generated_at", "status", "GENERATED", "INVALIDATED"), filled_where("failure_code", "status", "FAILED"), filled_where("invalidated_at", "status", "INVALIDATED"), filled_where("invalidation_reason", "status", "INVALIDATED"),
    ),
    "review_confirmations": (shaped("report_content_sha256", HASH), together("voided_at", "void_reason")),
    "exports": (filled_where("storage_key", "status", "READY"), filled_where("sha256", "status", "READY"), shaped("sha256", HASH)),
    "integrity_verifications": (
        shaped("recorded_sha256", HASH), shaped("computed_sha256", HASH), filled_where("computed_sha256", "result", "MATCH", "MISMATCH"), filled_where("failure_code", "result", "COULD_NOT_COMPLETE"), ("result_fits_hashes", ("result", "recorded_sha256", "computed_sha256"), lambda r, a, b: (r == "COULD_NOT_COMPLETE") | ((r == "MATCH") == (a == b))),
    ),
    "audit_logs": (filled_where("actor_user_id", "actor_kind", "USER"), one_of("action", *AUDITED)),
}
# Of which rows, and by what, there may be one only.
ONE_EACH = {"analysis_runs": (("case_id",), "status in ('QUEUED', 'RUNNING')"), "scam_signals": (("case_id",), "is_primary"), "urgency_assessments": (("case_id",), "is_current"), "review_confirmations": (("report_id",), "voided_at is null")}


def applicable(name: str, columns: list[str]) -> dict[str, Callable[[], Column]]:
    """The rules of a table whose columns are there, by name."""
    return {rule: (lambda used=used, test=test: test(*map(F.col, used))) for rule, used, test in RULES[name] if set(used) <= set(columns)}


def check(rows: DataFrame, name: str, key: str) -> DataFrame:
    """``key, failed_check``: a row for each rule of the table that a row breaks, all rules in one pass."""
    tests = applicable(name, rows.columns)
    failed = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(~test(), F.lit(rule)) for rule, test in tests.items()]))
    return rows.select(key, F.explode(failed).alias("failed_check"))


def check_all(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``table, key, failed_check`` over several tables (name: rows and their key)."""
    parts = [check(rows, name, key).select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"), "failed_check") for name, (rows, key) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def more_than_one(rows: DataFrame, name: str) -> DataFrame:
    """The key's columns and ``n``: of what a table may hold one row only, and holds more."""
    key, some = ONE_EACH[name]
    return duplicates(rows, list(key), F.expr(some))
