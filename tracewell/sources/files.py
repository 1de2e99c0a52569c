"""Files as evidence: type by content, image headers, mail, limits; sinks for derived tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Limits of an evidence item.
MAX_BYTES, MAX_PIXELS, MAX_PASTE = 10_485_760, 40_000_000, 20_000
HEADERS = ("From", "To", "Cc", "Reply-To", "Return-Path", "Subject", "Date", "Message-ID")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, content`` of all files; the content of files over the limit is never read."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= MAX_BYTES).select("path", "length", "content")


def oversized(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, rejection`` of the files over the limit, which ``read_files`` leaves out."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") > MAX_BYTES).select("path", "length", F.lit("FILE_TOO_LARGE").alias("rejection"))


def content_type(content: Column) -> Column:
    """By the first bytes: png, jpeg, OLE, PDF, then text if it is UTF-8 without NUL, else binary."""
    head, hexed = F.hex(F.substring(content, 1, 8)), F.hex(F.substring(content, 1, 1024))
    pdf = hexed.rlike("^(?:..)*?255044462D")
    text = F.is_valid_utf8(content.cast("string")) & (F.position(F.lit(b"\x00"), content) == 0)
    return (
        F.when(head == "89504E470D0A1A0A", "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head == "D0CF11E0A1B11AE1", "ole")
        .when(pdf, "application/pdf")
        .when(text, "text")
        .otherwise("binary")
    )


def big_endian(content: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(content, at + 1, size)), 16, 10).cast("bigint")


def png_size(content: Column) -> Column:
    """Width and height from the first chunk; null if that isn't the header."""
    fine = (F.length(content) >= 24) & (F.hex(F.substring(content, 13, 4)) == "49484452")
    return F.when(fine, F.struct(big_endian(content, 16, 4).alias("width"), big_endian(content, 20, 4).alias("height")))


def jpeg_size(files: DataFrame) -> DataFrame:
    """``path, width, height`` of JPEG files, by a walk over their segments to the frame header; null without one."""

    def walk(data: bytes):
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            kind = data[at + 1]
            if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD8:
                at += 1 if kind == 0xFF else 2
            elif kind in (0xC0, 0xC2) and at + 9 <= len(data):
                return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            elif kind in (0xD9, 0xDA):
                break
            else:
                at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        return None, None

    def run(parts):
        import pandas as pd

        for part in parts:
            sizes = [walk(bytes(x)) for x in part["content"]]
            yield pd.DataFrame({"path": part["path"], "width": pd.array([w for w, _ in sizes], "Int64"), "height": pd.array([h for _, h in sizes], "Int64")})

    return files.select("path", "content").mapInPandas(run, "path string, width long, height long")


def mail_lines(files: DataFrame) -> DataFrame:
    """Lines of mail: headers in fixed order, then the body (plain text preferred): ``path, ordinal, header_name, text``."""

    def parse(data: bytes):
        from email import message_from_bytes, policy

        mail = message_from_bytes(data, policy=policy.default)
        out = [(h, " ".join(str(mail[h]).split())) for h in HEADERS if mail[h] and str(mail[h]).strip()]
        body = mail.get_body(("plain", "html"))
        if body is not None:
            import html
            import re

            text = body.get_content()
            if body.get_content_type() == "text/html":
                text = re.sub(r'(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', r"\2 (\1)", text)
                text = html.unescape(re.sub(r"(?s)<[^>]+>", "", re.sub(r"(?is)<(script|style)\b.*?</\1>|<(?:br|/p|/div)\b[^>]*>", "\n", text)))
            out += [(None, x) for x in text.splitlines() if x.strip()]
        return out

    def run(parts):
        import pandas as pd

        for part in parts:
            rows = [(p, n, h, x) for p, c in zip(part["path"], part["content"], strict=True) for n, (h, x) in enumerate(parse(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["path", "ordinal", "header_name", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, ordinal int, header_name string, text string")


def rejection(length: Column, kind: Column) -> Column:
    """Why an item isn't taken; null if it is."""
    return F.when(length <= 0, "EMPTY_FILE").when(length > MAX_BYTES, "FILE_TOO_LARGE").when(kind.isin("ole", "binary"), "UNSUPPORTED_TYPE")


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Write rows; partitions that occur in them are replaced, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_audit(rows: DataFrame, path: str) -> None:
    """The audit trail is only ever appended to."""
    rows.write.mode("append").parquet(path)
