"""From documents to located, redacted lines.

A line keeps ``doc_id``, its ``line_number`` from 1 (blank lines take none) and text of at most
``MAX_LINE`` code points. Redaction replaces cards, accounts and one-time codes before anything else
reads a line. Null and empty texts have no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.patterns import CARD, NOT_S, OTP_CUE, PHONE_LIKE
from ..functions.unicode import form_c

MAX_LINE = 1000
# What stands in place of a redacted span.
REDACTION_VERSION = "redact-v1"
TOKENS = {"CARD_NUMBER": "[REDACTED:CARD]", "OTP": "[REDACTED:OTP]"}


def segments(line: Column) -> Column:
    """Pieces of at most MAX_LINE code points, cut at the last white space that allows it (which goes), else hard."""
    n = MAX_LINE
    pieces = F.regexp_extract_all(line, F.lit(rf"(?sU)(?=.{{{n + 1}}})(.{{1,{n - 1}}})\s|(?=.{{{n + 1}}}).{{{n}}}|.+"), F.lit(0))
    last = F.size(pieces) - 1
    return F.transform(pieces, lambda p, i: F.when(i < last, F.regexp_replace(p, r"(?U)\s$", "")).otherwise(p))


def is_long(line: Column) -> Column:
    """Whether a line has to be cut; bytes, which need no counting, rule most lines out."""
    return (F.octet_length(line) > MAX_LINE) & (F.length(line) > MAX_LINE)


def not_blank(text: Column) -> Column:
    """The lines of a text that hold more than white space, at their full length."""
    ends = F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(F.coalesce(text, F.lit("")))
    return F.filter(F.split(ends, "\n"), lambda x: x.rlike(f"{NOT_S}]"))


def split_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """``doc_id, line_number, text`` in Unicode form C; with ``whole`` lines keep their full length."""
    some = not_blank(form_c(F.col(text_col)))
    cut = some if whole else F.flatten(F.transform(some, lambda x: F.when(is_long(x), segments(x)).otherwise(F.array(x))))
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(cut).alias("line_number", "text")).withColumn("line_number", F.col("line_number") + 1)


def sensitive_spans(text: Column, card: str = CARD, accounts: bool = True) -> Column:
    """Cards, accounts (as cards) and one-time codes of a line, in order: ``kind, start, end``."""
    cards, cues, phones = T.card_spans(text, card), T.find_spans(text, OTP_CUE), T.find_spans(text, PHONE_LIKE)
    numbers = F.concat(cards, F.filter(T.account_spans(text), lambda s: ~T.overlaps(s, cards))) if accounts else cards
    codes = F.when(F.size(cues) > 0, T.otp_spans(text, cues, phones, numbers)).otherwise(F.array().cast(T.SPANS))
    tag = lambda spans, kind: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.array_sort(F.concat(tag(numbers, "CARD_NUMBER"), tag(codes, "OTP")))


def redact(lines: DataFrame, card: str = CARD, accounts: bool = True) -> DataFrame:
    """Lines with tokens in place of sensitive spans, and ``detections`` (kind, start, end) that point at the tokens.

    ``card`` is the pattern of cards: anywhere, or with ``CARD_WORD`` as words only. Without ``accounts`` numbers behind an
    account's cue stay, unless they are cards. Lines without four digits and their cues are left to one cheap test; only others run the span search.
    """
    spans = F.when(F.col("text").rlike(r"\d{4}|\d(?:[ -]?\d){3}"), sensitive_spans(T.plain(F.col("text")), card, accounts)).otherwise(F.array().cast("array<struct<start:int,end:int,kind:string>>"))
    token = lambda kind: F.when(kind == "OTP", TOKENS["OTP"]).otherwise(TOKENS["CARD_NUMBER"])
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int>>").alias("found"))

    def step(a, s):
        out = F.concat(a["out"], F.substr("text", a["at"] + 1, s["start"] - a["at"]))
        hit = F.struct(s["kind"].alias("kind"), F.length(out).alias("start"), (F.length(out) + F.length(token(s["kind"]))).alias("end"))
        return F.struct(F.concat(out, token(s["kind"])).alias("out"), s["end"].alias("at"), F.concat(a["found"], F.array(hit)).alias("found"))

    done = F.aggregate("spans", zero, step, lambda a: F.struct(F.concat(a["out"], F.substr("text", a["at"] + 1)).alias("text"), a["found"].alias("detections")))
    as_it_is = F.struct(F.col("text"), F.array().cast("array<struct<kind:string,start:int,end:int>>").alias("detections"))
    done = F.when(F.size("spans") > 0, done).otherwise(as_it_is)
    return lines.withColumn("spans", spans).withColumn("done", done).drop("text", "spans").select("*", "done.text", "done.detections").drop("done")


def detection_counts(redacted: DataFrame) -> DataFrame:
    """``doc_id, kind, n, version``: how often each kind was redacted in a document, and by which version of the rules."""
    found = redacted.select("doc_id", F.explode("detections").alias("d"))
    return found.groupBy("doc_id", F.col("d.kind").alias("kind")).agg(F.count("*").alias("n")).withColumn("version", F.lit(REDACTION_VERSION))
