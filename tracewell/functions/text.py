"""Column functions over text: matches with offsets, span arithmetic, masks and normal forms. All native."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .hosts import is_address, known_ending

OPEN, CLOSE = "\u0001", "\u0002"
SPANS = "array<struct<value:string,start:int,end:int>>"


def plain(text: Column) -> Column:
    """Text without the two characters that mark matches."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{OPEN}{CLOSE}]", " ")


def let(value: Column, made: Callable[[Column], Column]) -> Column:
    """What is made of a value that is worked out once, however often it is named."""
    return F.transform(F.array(value), made)[0]


def find_spans(text: Column, pattern: str) -> Column:
    """All matches as ``(value, start, end)`` in code points from 0; stays in the JVM and keeps look-around."""
    return spans_in(plain(text), pattern)


def spans_in(text: Column, pattern: str) -> Column:
    """As ``find_spans``, of text that is ``plain`` already."""
    pieces = F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), OPEN)

    def hit(at, piece):
        return F.struct(F.substring_index(piece, CLOSE, 1).alias("value"), at.alias("start"), (at + F.instr(piece, CLOSE) - 1).alias("end"))

    def step(acc, piece):
        return F.struct((acc["at"] + F.length(piece) - 1).alias("at"), F.concat(acc["found"], F.array(hit(acc["at"], piece))).alias("found"))

    def placed(pieces):
        zero = F.struct(F.length(pieces[0]).alias("at"), F.array().cast(SPANS).alias("found"))
        every = F.aggregate(F.slice(pieces, 2, F.size(pieces)), zero, step, lambda a: a["found"])
        # most texts with a match have one, whose place needs no running sum
        one = F.array(hit(F.length(pieces[0]), pieces[1]))
        return F.when(F.size(pieces) == 1, F.array().cast(SPANS)).when(F.size(pieces) == 2, one).otherwise(every)

    return let(pieces, placed)


def overlaps(a: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"]))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def card_spans(text: Column, pattern: str = P.CARD) -> Column:
    return F.filter(find_spans(text, pattern), lambda s: F.call_function("luhn_check", digits_of(s["value"])))


def account_spans(text: Column) -> Column:
    """The digits after an account cue, unless a card is there."""
    tail = lambda s: F.regexp_extract(s["value"], r"(\d{9,18})$", 1)
    found = F.transform(find_spans(text, P.ACCOUNT_CUE), lambda s: F.struct(tail(s).alias("value"), (s["end"] - F.length(tail(s))).alias("start"), s["end"].alias("end")))
    return found


def otp_spans(text: Column, cues: Column, phones: Column, taken: Column) -> Column:
    """Runs of 4 to 8 digits near a cue that are no amount, reference, date, time, decimal or phone number."""

    def fits(s):
        before, after = F.left(text, s["start"]), F.substr(text, s["end"] + 1)
        near = F.exists(cues, lambda c: ((c["end"] <= s["start"]) & (s["start"] - c["end"] <= P.CUE_DISTANCE)) | ((s["end"] <= c["start"]) & (c["start"] - s["end"] <= P.CUE_DISTANCE)))
        size = F.length(digits_of(s["value"]))
        labelled = F.right(before, F.lit(6)).rlike(P.AMOUNT_BEFORE) | F.right(before, F.lit(24)).rlike(P.LABEL_BEFORE)
        part = before.rlike(r"\d[-/:.]$") | after.rlike(r"^[-/:.,]\d")
        return near & size.between(4, 8) & ~labelled & ~part & ~overlaps(s, taken) & ~overlaps(s, phones)

    return F.filter(find_spans(text, P.DIGIT_RUN), fits)


def strip_url_tail(url: Column) -> Column:
    return F.regexp_replace(url, P.URL_TAIL, "")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^(?i:https?://)?(?:[^/?#@]*@)?([^/?#:]+)", 1))


def normal_url(raw: Column) -> Column:
    """Canonical key of a URL: lower-case scheme and host, no default port, fragment, tracking parameters or last slash; null if it has user info or no host.

    A bare host counts with a known ending only; behind a scheme any ending of letters does.
    """
    return let(F.struct(raw.alias("raw"), F.when(raw.rlike(r"(?i)^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw)).alias("full")), lambda x: _normal_url(x["raw"], x["full"]))


def _normal_url(raw: Column, full: Column) -> Column:
    scheme = F.lower(F.regexp_extract(full, r"^([A-Za-z]+)://", 1))
    authority = F.regexp_extract(full, r"^[A-Za-z]+://([^/?#]*)", 1)
    return let(F.struct(scheme.alias("scheme"), authority.alias("authority"), F.lower(F.regexp_extract(authority, r"^([^:]*)", 1)).alias("host")), lambda x: _shown_url(raw, full, x["scheme"], x["authority"], x["host"]))


def _shown_url(raw: Column, full: Column, scheme: Column, authority: Column, host: Column) -> Column:
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    path = F.regexp_extract(full, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").when(path.endswith("/") & (path != "/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    query = F.regexp_extract(full, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).rlike(P.TRACKING))
    shown_port = F.when((port == "") | ((scheme == "https") & (port == "443")) | ((scheme == "http") & (port == "80")), "").otherwise(F.concat(F.lit(":"), port))
    shown_query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    stated = raw.rlike(r"(?i)^https?://") & host.rlike(r"\.[^\d\s.]{2,}$")
    fine = ~authority.contains("@") & scheme.isin("http", "https") & (known_ending(host) | is_address(host) | stated)
    return F.when(fine, F.concat(scheme, F.lit("://"), host, shown_port, path, shown_query))


def normalize(kind: Column, raw: Column) -> Column:
    """Canonical value by type, null where the value can't be normalised."""
    phone = F.regexp_replace(raw, P.PHONE_SEPARATORS, "")
    mobile = F.regexp_extract(phone, P.MOBILE, 1)
    foreign = F.regexp_extract(phone, P.ABROAD, 1)
    rupees = F.regexp_replace(F.regexp_extract(raw, P.RUPEES, 1), ",", "")
    paise = F.regexp_extract(raw, P.PAISE, 1)
    amount = F.concat(F.lit("INR "), F.regexp_replace(rupees, r"^0+(?=\d)", ""), F.lit("."), F.when(paise == "", "00").otherwise(paise))
    hint = F.regexp_extract(raw, P.HINT, 1)
    return (
        F.when(kind == "PHONE", F.when(mobile != "", F.concat(F.lit("+91"), mobile)).when(foreign != "", F.concat(F.lit("+"), foreign)))
        .when(kind == "URL", normal_url(raw))
        .when(kind.isin("DOMAIN", "EMAIL"), F.lower(raw))
        .when(kind == "UPI_ID", F.lower(F.regexp_replace(raw, r"^\W+|\W+$", "")))
        .when(kind == "TRANSACTION", F.upper(F.regexp_replace(raw, r"\s+", "")))
        .when(kind == "AMOUNT", F.when(rupees != "", amount))
        .when(kind == "ACCOUNT_HINT", F.when(hint != "", hint))
        .when(kind == "SMS_SENDER_HEADER", F.upper(raw))
        .when(kind == "MESSAGING_HANDLE", F.lower(F.regexp_replace(raw, P.HANDLE_START, "")))
        .when(kind.isin("PERSON", "BANK_OR_WALLET"), F.regexp_replace(F.trim(raw), r"\s+", " "))
    )


def valid_format(kind: Column, raw: Column) -> Column:
    """Whether a whole value has its type's form; times are ``temporal.normalize``'s."""
    bare = F.regexp_replace(raw, P.PHONE_SEPARATORS, "")
    whole = lambda pattern: raw.rlike(f"^(?:{pattern})$")
    name = F.regexp_replace(F.trim(raw), f"{P.S}+", " ").rlike(P.WHOLE_NAME)
    return F.coalesce(
        F.when(kind == "PHONE", bare.rlike(P.MOBILE) | bare.rlike(P.ABROAD))
        .when(kind == "URL", normal_url(raw).isNotNull() & (strip_url_tail(raw) == raw))
        .when(kind == "DOMAIN", known_ending(raw) & raw.rlike(P.WHOLE_DOMAIN))
        .when(kind == "EMAIL", whole(P.EMAIL))
        .when(kind == "UPI_ID", F.regexp_replace(raw, r"^\W+|\W+$", "").rlike(P.WHOLE_UPI_ID))
        .when(kind == "TRANSACTION", F.regexp_replace(raw, f"{P.S}+", "").rlike(P.WHOLE_TRANSACTION))
        .when(kind == "AMOUNT", whole(P.AMOUNT))
        .when(kind == "ACCOUNT_HINT", raw.rlike(P.WHOLE_HINT))
        .when(kind == "SMS_SENDER_HEADER", F.upper(raw).rlike(P.SMS_SENDER))
        .when(kind == "MESSAGING_HANDLE", whole(P.HANDLE))
        .when(kind.isin("PERSON", "BANK_OR_WALLET"), name),
        F.lit(False),
    )


def amount_minor(canonical: Column) -> Column:
    """Minor units of ``INR 123.45``."""
    return F.regexp_replace(canonical, r"[^\d]", "").cast("decimal(38,0)").cast("bigint")


def mask(kind: Column, value: Column) -> Column:
    """What may be shown of a canonical value."""
    mobile = F.regexp_replace(value, P.SHOWN_MOBILE, P.SHOWN_AS)
    middle = F.regexp_extract(value, P.SHOWN_ABROAD, 1)
    abroad = F.concat(F.substring(value, 1, 4), F.repeat(F.lit("X"), F.length(middle)), F.right(value, F.lit(3)))
    at = F.instr(value, "@")
    return (
        F.when((kind == "PHONE") & value.rlike(r"^\+91\d{10}$"), mobile)
        .when((kind == "PHONE") & (middle != ""), abroad)
        .when((kind == "UPI_ID") & (at > 0), F.concat(F.left(F.substring_index(value, "@", 1), F.lit(5)), F.lit("***"), F.substr(value, at)))
        .when((kind == "EMAIL") & (at > 1), F.concat(F.left(value, F.lit(1)), F.lit("***"), F.substr(value, at)))
        .when(kind == "TRANSACTION", F.concat(F.left(value, F.lit(4)), F.lit("…"), F.right(value, F.lit(4))))
        .when(kind == "MESSAGING_HANDLE", F.concat(F.left(value, F.least(F.lit(3), F.greatest(F.lit(1), F.length(value) - 1))), F.lit("***")))
        .otherwise(value)
    )


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "HIGH").when(confidence >= 0.6, "MEDIUM").otherwise("LOW")
