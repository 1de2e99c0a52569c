"""The library from SQL: a table function that finds facts in a text, and scalar functions, registered for a session.

``SELECT d.doc_id, f.* FROM documents d, LATERAL extract_entities(d.text) f`` gives what ``facts.candidates`` gives for one line
at a time; ``extract_entities(d.text, 'EMAIL')`` looks for facts of that type only. It calls Python once a row and is meant for looking into
texts from SQL; jobs over whole corpora use the DataFrame functions.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import patterns as P
from .hosts import both_forms
from .temporal import TEMPORAL
from .unicode import _form_c

FOUND = "field_type string, raw_value string, start int, end int"


@lru_cache(1)
def finders() -> list:
    """``(type, pattern, what of a match counts)``; Java's patterns, read as it reads them."""
    import regex

    compiled = lambda p: regex.compile(f"(?a){p}")
    tail, hint, digits, last = compiled(P.URL_TAIL), compiled(r"([Xx*]{2,}\d{3,4}|(?i:ending\s+(?:in\s+)?\d{4}))$"), compiled(r"\d"), compiled(r"([A-Za-z0-9]{8,22})$")
    behind = compiled(rf"(?i)^[^:]*:{P.S}*")
    all_of = lambda m: (m.start(), m[0])
    shown = lambda m: (m.start(), tail.sub("", m[0]))

    def transaction(m):
        value = last.search(m[0])[1]
        return (m.end() - len(value), value) if digits.search(value) else None

    def account(m):
        value = hint.search(m[0])[1]
        return m.end() - len(value), value

    def named(m):
        at = behind.match(m[0]).end()
        return m.start() + at, m[0][at:].rstrip(".'&-")

    def debited(m):
        value = compiled(P.DEBITED_NAME).search(m[0])[1]
        return m.end() - len(value), value

    rows = [
        ("PHONE", P.PHONE, all_of), ("URL", P.URL, shown), ("URL", P.BARE_HOST, shown), ("EMAIL", P.EMAIL, all_of), ("UPI_ID", P.UPI_ID, all_of), ("AMOUNT", P.AMOUNT, all_of), ("TRANSACTION", P.TRANSACTION, transaction),
        ("ACCOUNT_HINT", P.ACCOUNT_HINT, account), ("MESSAGING_HANDLE", P.HANDLE, all_of), ("DATETIME", TEMPORAL, all_of), ("PERSON", P.PERSON_LABEL + P.NAME, named), ("BANK_OR_WALLET", P.BANK_LABEL + P.NAME, named), ("BANK_OR_WALLET", P.DEBITED_FROM, debited),
    ]
    return [(kind, compiled(p), take) for kind, p, take in rows]


class ExtractEntities:
    def eval(self, text: str, only: str = None):
        for kind, pattern, take in finders():
            for m in pattern.finditer(text or "") if only in (None, kind) else ():
                if hit := take(m):
                    yield kind, hit[1], hit[0], hit[0] + len(hit[1])


@F.pandas_udf(StringType())
def _ascii(hosts):
    return both_forms(hosts)["ascii"]


@F.pandas_udf(StringType())
def _readable(hosts):
    return both_forms(hosts)["read"]


def register(spark: SparkSession) -> None:
    """Give the session ``extract_entities(text)``, ``form_c(text)``, ``idn_to_ascii(host)`` and ``idn_to_unicode(host)``."""
    # deterministic: conditions on the rows it is applied to hold before Python is called
    spark.udtf.register("extract_entities", F.udtf(ExtractEntities, returnType=FOUND).asDeterministic())
    spark.udf.register("form_c", _form_c)
    spark.udf.register("idn_to_ascii", _ascii)
    spark.udf.register("idn_to_unicode", _readable)
