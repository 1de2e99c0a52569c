"""Mail as a tree of parts: headers and body become lines, attachments are listed, never opened.

One Arrow-fed pass walks each message's parts, once; HTML bodies then become text natively, as pages do. A message that is
encrypted or can't be read fails with a code and has no lines. Headers come in a fixed order; a plain body is
preferred, wherever in the tree it is, else the first HTML one. Null and empty messages can't be read; empty tables give no rows.
"""

from __future__ import annotations

from email import message_from_bytes, policy
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lines import is_long, not_blank, segments
from .files import HEADERS
from .items import html_lines

# Headers of which a message needs one.
REQUIRED = ("From", "Date", "Subject")
PARTS = "item_id string, part int, kind string, name string, content_type string, size_bytes long, text string"


@lru_cache(maxsize=4096)
def _header(name: str, value: str):
    return policy.default.header_fetch_parse(name, value)


class Headers(policy.EmailPolicy):
    """The default policy; a header's text is parsed once, not at each look, and types and senders of mails are mostly alike."""

    def header_fetch_parse(self, name: str, value: str):
        return _header(name, value)


READ = Headers()


def walk(data: bytes) -> list[tuple]:
    """``kind, name, content_type, size, text`` of the parts of a message: HEADER, PLAIN, HTML, ATTACHMENT, or one FAILURE."""
    try:
        mail = message_from_bytes(data, policy=READ)
        if mail.get_content_type() == "multipart/encrypted" or mail.get_content_type().endswith("pkcs7-mime"):
            return [("FAILURE", "EMAIL_ENCRYPTED", None, None, None)]
        said = [(h, mail[h]) for h in HEADERS if h in mail]
        headers = [("HEADER", h, None, None, " ".join(str(x).split())) for h, x in said if str(x).strip()]
        if not {h for _, h, *_ in headers} & set(REQUIRED):
            return [("FAILURE", "EMAIL_UNPARSEABLE", None, None, None)]
        return headers + [_leaf(part) for part in leaves(mail)]
    except (LookupError, ValueError, UnicodeError, TypeError, AttributeError, IndexError):  # what the parser raises on broken headers and parts
        return [("FAILURE", "EMAIL_UNPARSEABLE", None, None, None)]


def leaves(part):
    """The parts that hold something, in the order of the message; a forwarded message is one of them."""
    if part.get_content_maintype() == "multipart":
        for child in part.iter_parts():
            yield from leaves(child)
    else:
        yield part


def _leaf(part) -> tuple:
    kind = part.get_content_type()
    if kind in ("text/plain", "text/html") and part.get_content_disposition() != "attachment" and not part.get_filename():
        text = part.get_payload(decode=True).decode(part.get_content_charset("utf-8") if _known(part.get_content_charset("utf-8")) else "latin-1", "replace")
        return ("PLAIN" if kind == "text/plain" else "HTML", None, kind, None, text.replace("\0", ""))
    data = part.get_payload(decode=True) if not part.is_multipart() else b"".join(bytes(x) for x in part.get_payload())
    return ("ATTACHMENT", part.get_filename() or "unnamed", kind, len(data or b""), None)


def _known(charset: str) -> bool:
    import codecs

    try:
        codecs.lookup(charset)
    except LookupError:
        return False
    return True


def mail_parts(mails: DataFrame, id_col: str = "item_id", content_col: str = "content") -> DataFrame:
    """``item_id, part, kind, name, content_type, size_bytes, text``: a row for each header, body, attachment or failure, in order."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [(i, n, *p) for i, c in zip(batch["item_id"], batch["content"], strict=True) for n, p in enumerate(walk(bytes(c)) if c is not None else [("FAILURE", "EMAIL_UNPARSEABLE", None, None, None)], 1)]
            out = pd.DataFrame(rows, columns=["item_id", "part", "kind", "name", "content_type", "size_bytes", "text"])
            out["size_bytes"] = out["size_bytes"].astype("Int64")
            yield out

    kind = dict(mails.dtypes)[id_col]
    return mails.select(F.col(id_col).alias("item_id"), F.col(content_col).cast("binary").alias("content")).mapInPandas(run, PARTS.replace("item_id string", f"item_id {kind}"))


def mail_items(mails: DataFrame, id_col: str = "item_id", content_col: str = "content") -> DataFrame:
    """``item_id, failure, headers, body, attached``: one row for each message, which is parsed once; the body as lines, in order."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for i, content in zip(batch["item_id"].to_pylist(), batch["content"].to_pylist(), strict=True):
                parts = walk(content) if content is not None else [("FAILURE", "EMAIL_UNPARSEABLE", None, None, None)]
                own = {k: [p for p in parts if p[0] == k] for k in ("FAILURE", "HEADER", "PLAIN", "HTML", "ATTACHMENT")}
                first = lambda k: next((p[4] for p in own[k] if p[4].strip(" ")), None)  # noqa: B023, E731
                rows.append((i, own["FAILURE"][0][1] if own["FAILURE"] else None, [p[1::3] for p in own["HEADER"]], first("PLAIN"), first("HTML"), [p[1:4] for p in own["ATTACHMENT"]]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            nested = lambda values, schema: pa.array([[dict(zip(schema.names, x, strict=True)) for x in v] for v in values], pa.list_(pa.struct(schema)))
            text = lambda values: pa.array(values, pa.string())
            headers = nested(columns[2], pa.schema([("name", pa.string()), ("text", pa.string())]))
            attached = nested(columns[5], pa.schema([("filename", pa.string()), ("content_type", pa.string()), ("size_bytes", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch["item_id"], text(columns[1]), headers, text(columns[3]), text(columns[4]), attached], ["item_id", "failure", "headers", "plain", "html", "attached"])

    schema = f"item_id {dict(mails.dtypes)[id_col]}, failure string, headers array<struct<name: string, text: string>>, plain string, html string, attached array<struct<filename: string, content_type: string, size_bytes: long>>"
    own = mails.select(F.col(id_col).alias("item_id"), F.col(content_col).cast("binary").alias("content")).mapInArrow(run, schema)
    body = F.when(F.col("plain").isNotNull(), not_blank(F.col("plain"))).otherwise(html_lines(F.col("html")))
    cut = F.flatten(F.transform(body, lambda x: F.when(is_long(x), segments(x)).otherwise(F.array(x))))
    return own.select("item_id", "failure", "headers", cut.alias("body"), "attached")


def parsed_mail(mails: DataFrame, id_col: str = "item_id", content_col: str = "content") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines (``item_id, line_number, location, header_name, text``), attachments (``item_id, ordinal, filename, content_type, size_bytes``) and failures (``item_id, failure``)."""
    own = mail_items(mails, id_col, content_col)
    failures = own.where("failure is not null").select("item_id", "failure")
    attached = own.select("item_id", F.posexplode_outer("attached").alias("ordinal", "a")).where("ordinal is not null").select("item_id", (F.col("ordinal") + 1).alias("ordinal"), "a.filename", "a.content_type", "a.size_bytes")
    line = lambda location, name, text: F.struct(F.lit(location).alias("location"), name.alias("header_name"), text.alias("text"))
    every = F.concat(F.transform("headers", lambda h: line("EMAIL_HEADER", h["name"], h["text"])), F.transform("body", lambda x: line("EMAIL_BODY_LINE", F.lit(None).cast("string"), x)))
    lines = own.select("item_id", F.posexplode_outer(every).alias("line_number", "line")).where("line_number is not null").select("item_id", (F.col("line_number") + 1).alias("line_number"), "line.location", "line.header_name", "line.text")
    return lines, attached, failures
