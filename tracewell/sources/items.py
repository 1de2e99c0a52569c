"""Uploaded and pasted items: what is taken, and how each kind becomes lines.

An item is ``item_id, kind, text``. Kinds: ``TEXT``, ``URL`` (one trimmed line), ``EML`` and ``HTML``. Null texts count
as empty. Everything is native but for Unicode forms and entities, which are Arrow batches.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.hosts import known_ending
from ..functions.patterns import BARE_HOST, S
from ..functions.unicode import form_c
from ..operators.lines import not_blank, split_lines
from .files import MAX_BYTES, MAX_PASTE, MAX_PIXELS

# Extensions by declared type, mailbox extensions, limits, the least text worth reading, a header field.
EXTENSIONS = {"txt": "text/plain", "eml": "message/rfc822", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "pdf": "application/pdf"}
MAILBOXES = ("msg", "mbox", "mbx", "pst")
MAX_PAGES, MIN_READABLE = 20, 10
HEADER_FIELD = "^[!-9;-~]+:"
#: Tags after which a new line starts.
BLOCKS = r"(?i)</?(?:br|hr|p|div|li|ul|ol|h[1-6]|tr|table|article|section|nav|footer|header|title)\b[^>]*>"
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>"
WHOLE_ENTITY = re.compile(r"&(#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
LINK = r'(?is)<a\b[^>]*?\bhref="([^"]*)"[^>]*>(.*?)</a>'


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(StringType())
def unescape_whole(text: pd.Series) -> pd.Series:
    """As ``unescape``, but for entities whose semicolon is missing, which stay."""
    return text.map(lambda x: None if x is None else WHOLE_ENTITY.sub(lambda m: html.unescape(m[0]) if m[1][0] == "#" or f"{m[1]};" in html5 else m[0], x))


def canonical_paste(text: Column) -> Column:
    """What a pasted text's fingerprint covers: form C, line feeds only."""
    return F.regexp_replace(form_c(text), "\r\n?", "\n")


def readable_size(text: Column) -> Column:
    """Code points that are no white space."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), S, ""))


def declared_type_rejection(filename: Column, content_type: Column) -> Column:
    """Why a declared type isn't taken: mailboxes have a code of their own; type and extension must agree; null if fine."""
    extension = F.when(filename.contains("."), F.lower(F.substring_index(filename, ".", -1))).otherwise("")
    kinds = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    fine = F.coalesce(F.element_at(kinds, extension) == F.lower(F.trim(content_type)), F.lit(False))
    return F.when(extension.isin(*MAILBOXES), "EMAIL_FORMAT_NOT_SUPPORTED").when(~fine, "TYPE_NOT_SUPPORTED")


def limit_rejection(size: Column, pages: Column | None = None, pixels: Column | None = None, pasted: Column | None = None) -> Column:
    """The first limit that an item breaks; null if none."""
    out = F.when(size <= 0, "EMPTY_FILE").when(size > MAX_BYTES, "FILE_TOO_LARGE")
    for value, most, code in ((pages, MAX_PAGES, "PDF_TOO_MANY_PAGES"), (pixels, MAX_PIXELS, "IMAGE_TOO_LARGE"), (pasted, MAX_PASTE, "TEXT_TOO_LONG")):
        out = out if value is None else out.when(value > most, code)
    return out


def mail_rejection(text: Column) -> Column:
    """Why a text isn't mail: a mailbox export, or no header fields up to the first empty line; null if it is."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "^\ufeff", ""), "\r?\n")
    first = F.array_position(F.transform(lines, lambda x: F.regexp_replace(x, S, "") != ""), True).cast("int")
    rest = F.slice(lines, F.greatest(first, F.lit(1)), F.size(lines))
    end = F.array_position(rest, "").cast("int")
    head = F.when(end > 0, F.slice(rest, 1, F.greatest(end - 1, F.lit(0)))).otherwise(rest)
    fields = rest[0].rlike(HEADER_FIELD) & F.forall(head, lambda x: x.rlike(HEADER_FIELD) | x.rlike("^[ \t]"))
    return F.when(first == 0, "CONTENT_TYPE_MISMATCH").when(rest[0].startswith("From "), "EMAIL_FORMAT_NOT_SUPPORTED").when(~fields, "CONTENT_TYPE_MISMATCH")


def is_pasted_url(text: Column) -> Column:
    """Whether the whole text is a URL, or a bare host with a known ending and perhaps a path."""
    absolute = text.rlike(r"(?i)^https?://[^/?#]+")
    bare = text.rlike(rf"^(?:{BARE_HOST})$") & known_ending(F.lower(F.substring_index(text, "/", 1)))
    return F.coalesce((text != "") & ~text.rlike(S) & (absolute | bare), F.lit(False))


def html_text(page: Column, decode: Callable[[Column], Column] = unescape) -> Column:
    """Readable text of a page: hidden parts go, links keep their target in brackets, blocks end lines, entities are decoded, as browsers do or by ``unescape_whole``."""
    shown = F.regexp_replace(F.coalesce(page, F.lit("")), HIDDEN, "")
    linked = F.regexp_replace(shown, LINK, "$2 ($1)")
    bare = F.regexp_replace(F.regexp_replace(linked, BLOCKS, "\n"), "<[^>]+>", "")
    return F.when(bare.contains("&"), decode(bare)).otherwise(bare)


def html_lines(page: Column) -> Column:
    """The readable lines of a page, white space collapsed."""
    return F.transform(not_blank(html_text(page)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))


def parsed(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (``item_id, line_number, text``) of all items that can be read, and failures (``item_id, failure``) of the others, by kind."""
    from . import mail

    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "^\ufeff", "")
    failure = F.when(F.col("kind") == "EML", mail_rejection(F.col("text"))).when(F.col("kind").isin("TEXT", "HTML") & (readable_size(text) < MIN_READABLE), "NO_READABLE_TEXT").when(~F.col("kind").isin("TEXT", "HTML", "URL", "EML"), "TYPE_NOT_SUPPORTED")
    judged = items.select("item_id", "kind", text.alias("text")).withColumn("failure", failure)
    good = judged.where("failure is null")
    one = good.where("kind = 'URL'").select("item_id", F.lit(1).alias("line_number"), F.trim("text").alias("text"))
    pages = good.where("kind = 'HTML'").select("item_id", F.array_join(html_lines(F.col("text")), "\n").alias("text"))
    plain = good.where("kind = 'TEXT'").select("item_id", "text").unionByName(pages)
    mails, _, unread = mail.parsed_mail(good.where("kind = 'EML'"), content_col="text")
    lines = one.unionByName(split_lines(plain, id_col="item_id").withColumnRenamed("doc_id", "item_id"))
    return lines.unionByName(mails.select("item_id", "line_number", form_c(F.col("text")).alias("text"))), judged.where("failure is not null").select("item_id", "failure").unionByName(unread)
