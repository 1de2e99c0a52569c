"""Spans, redaction, facts, normal forms and masks against small models."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.functions import patterns as P
from tracewell.functions import text as T
from tracewell.operators import facts, lines


def column(spark, texts, make):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.x for r in rows.select("i", make(F.col("text")).alias("x")).orderBy("i").collect()]


def test_find_spans_equals_finditer(spark):
    texts = ["", None, "a1b22", "é12 𝄞3", "1", "no", "12\n34 5", "$1 \\2"]
    got = column(spark, texts, lambda t: T.find_spans(t, r"\d+"))
    assert [[(s.value, s.start, s.end) for s in x] for x in got] == [[(m[0], m.start(), m.end()) for m in re.finditer(r"\d+", t or "", re.A)] for t in texts]


def test_lines(spark):
    long = "word " * 300 + "x" * 1500 + " end"
    docs = spark.createDataFrame([(1, "a\r\n\r\n b \rc\n \n"), (2, None), (3, ""), (4, long), (5, "𝄞" * 1001)], "doc_id int, text string")
    got = {}
    for r in lines.split_lines(docs).orderBy("doc_id", "line_number").collect():
        got.setdefault(r.doc_id, []).append((r.line_number, r.text))
    assert got[1] == [(1, "a"), (2, " b "), (3, "c")] and 2 not in got and 3 not in got
    assert all(len(x) <= 1000 for _, x in got[4]) and "".join(x for _, x in got[4]).replace(" ", "").replace(" ", "") == long.replace(" ", "").replace(" ", "")
    assert [len(x) for _, x in got[5]] == [1000, 1]


@pytest.mark.parametrize(
    "text, want",
    [
        ("card 4111 1111 1111 1111 ok", "card [REDACTED:CARD] ok"),
        ("card 4111 1111 1111 1112 no", "card 4111 1111 1111 1112 no"),
        ("Your OTP is 123456.", "Your OTP is [REDACTED:OTP]."),
        ("code is 12-3456 and Rs. 5000", "code is [REDACTED:OTP] and Rs. 5000"),
        ("OTP 2026-10-02 at 10:1234", "OTP 2026-10-02 at 10:1234"),
        ("otp for 98765 43210", "otp for 98765 43210"),
        ("A/c no. 123456789012 debited", "A/c no. [REDACTED:CARD] debited"),
        ("nothing 123456 here", "nothing 123456 here"),
        ("UTR: 12345678 otp", "UTR: 12345678 otp"),
    ],
)
def test_redaction(spark, text, want):
    row = lines.redact(spark.createDataFrame([(1, 1, text)], "doc_id int, line_number int, text string")).first()
    assert row.text == want
    assert all(row.text[d.start : d.end].startswith("[REDACTED:") for d in row.detections)
    assert len(row.detections) == want.count("[REDACTED:")


NOTE = [
    (1, 1, "AX-DEMOBK"),
    (1, 2, "Rs. 8,500.00 debited from A/c XX4521 UTR: ABCD12345678"),
    (1, 3, "Pay kyc.refund@demoupi or call +91 98765-43210, see HTTPS://Pay.Demo.example:443/verify/?utm_source=x&id=7#top."),
    (1, 4, "mail Help.Desk@bank.example or @demo_help and t.me/demo_chan"),
    (1, 5, "Paid to: shop"),
]


def test_facts(spark):
    found = facts.extract(spark.createDataFrame(NOTE, "doc_id int, line_number int, text string")).collect()
    got = {(r.line_number, r.field_type, r.normalized_value) for r in found}
    assert got >= {
        (1, "SMS_SENDER_HEADER", "AX-DEMOBK"),
        (2, "AMOUNT", "INR 8500.00"),
        (2, "ACCOUNT_HINT", "4521"),
        (2, "TRANSACTION", "ABCD12345678"),
        (3, "UPI_ID", "kyc.refund@demoupi"),
        (3, "PHONE", "+919876543210"),
        (3, "URL", "https://pay.demo.example/verify?id=7"),
        (3, "DOMAIN", "pay.demo.example"),
        (4, "EMAIL", "help.desk@bank.example"),
        (4, "MESSAGING_HANDLE", "demo_help"),
        (4, "MESSAGING_HANDLE", "demo_chan"),
    }
    text = {n: t for _, n, t in NOTE}
    assert all(text[r.line_number][r.start : r.end] == r.raw_value for r in found)


def test_edges_and_entities(spark):
    rows = spark.createDataFrame(NOTE + [(2, 1, "see https://pay.demo.example/verify?id=7 now"), (3, 1, "nothing")], "doc_id int, line_number int, text string")
    found = facts.extract(rows).cache()
    assert sorted((r.url, r.host, r.n_docs, r.first_doc) for r in facts.hosted_on(found).collect()) == [("https://pay.demo.example/verify?id=7", "pay.demo.example", 2, 1), ("https://t.me/demo_chan", "t.me", 1, 1)]
    entity = {(r.field_type, r.canonical_value): r for r in facts.entities(found).collect()}
    assert entity["PHONE", "+919876543210"].masked_value == "+91 98XXX XX210" and entity["UPI_ID", "kyc.refund@demoupi"].masked_value == "kyc.r***@demoupi"
    assert entity["TRANSACTION", "ABCD12345678"].masked_value == "ABCD…5678" and entity["URL", "https://pay.demo.example/verify?id=7"].n_docs == 2
    paid = facts.single_pair_edges(found, "TRANSACTION", "UPI_ID", "PAID_TO", facts.paid_cue, rows)
    assert [(r.from_value, r.to_value, r.n_docs) for r in paid.collect()] == [("ABCD12345678", "kyc.refund@demoupi", 1)]
    debited = facts.single_pair_edges(found, "TRANSACTION", "ACCOUNT_HINT", "DEBITED_FROM", facts.debit_cue, rows)
    assert debited.count() == 1 and facts.extract(rows.limit(0)).count() == 0


def greedy(spans):
    kept = []
    for s, e in sorted(spans, key=lambda x: (x[0] - x[1], x)):
        if not any(s < b and a < e for a, b in kept):
            kept.append((s, e))
    return sorted(kept)


def test_longest_first(spark):
    import random

    rng, groups = random.Random(2), {}
    for g in range(200):
        groups[g] = {(a, a + rng.randint(1, 8)) for a in (rng.randint(0, 20) for _ in range(rng.randint(1, 7)))}
    rows = [(g, 1, "URL", f"{s}", s, e) for g, spans in groups.items() for s, e in spans]
    got = {}
    for r in facts.longest_first(spark.createDataFrame(rows, "doc_id int, line_number int, field_type string, raw_value string, start int, end int")).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    assert {g: sorted(x) for g, x in got.items()} == {g: greedy(x) for g, x in groups.items()}


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab@.-_ 19é+", max_size=30), min_size=1, max_size=20))
def test_email_pattern_as_in_python(spark, texts):
    got = column(spark, texts, lambda t: T.find_spans(t, P.EMAIL))
    assert [[(s.value, s.start) for s in x] for x in got] == [[(m[0], m.start()) for m in re.finditer(P.EMAIL, t, re.A)] for t in texts]


def test_urls(spark):
    cases = {
        "HTTP://A.example": "http://a.example/",
        "http://a.example:80/x/": "http://a.example/x",
        "https://a.example:8443?b=1&gclid=2": "https://a.example:8443/?b=1",
        "https://u:p@a.example/": None,
        "ftp://a.example/": None,
        "a.example/x#y": "https://a.example/x",
        "https://1.2.3.4/x": "https://1.2.3.4/x",
        "https://a.unknowntld/": "https://a.unknowntld/",
        "a.unknowntld/": None,
        "https://localhost/": None,
    }
    assert column(spark, list(cases), T.normal_url) == list(cases.values())
    assert column(spark, ["INR 8500.00", "INR 0.05"], T.amount_minor) == [850000, 5]


def test_times(spark):
    from tracewell.functions.temporal import TEMPORAL, normalize

    cases = {
        "24 Sep 2026 at 12:19 PM": ("2026-09-24T12:19+05:30", "DATETIME", "EXACT"),
        "Thursday, 24 September 2026": ("2026-09-24", "DATE", "EXACT"),
        "2026-02-30": None,
        "03/04/69": ("2069-04-03", "DATE", "EXACT"),
        "03-04-70, around 9:05": ("1970-04-03T09:05+05:30", "DATETIME", "APPROXIMATE"),
        "~ 12:00 a.m.": ("T00:00", "TIME", "APPROXIMATE"),
        "23:59": ("T23:59", "TIME", "EXACT"),
        "24:00": None,
        "13:00 pm": None,
    }
    got = column(spark, list(cases), normalize)
    assert [x and (x.value, x.kind, x.precision) for x in got] == list(cases.values())
    assert got[0].at.isoformat().startswith("2026-09-24T06:49") and got[1].at is None
    found = column(spark, ["On 24 Sep 2026, 12:03 PM and about 5:10pm; ratio 3:4x 1/2/2026-5"], lambda t: T.find_spans(t, TEMPORAL))
    assert [s.value for s in found[0]] == ["24 Sep 2026, 12:03 PM", "about 5:10pm"]


def test_labelled_names(spark):
    rows = spark.createDataFrame([(1, 1, "Paid by: Asha K. Rao, then left"), (1, 2, "Bank name: Demo & Sons Wallet"), (1, 3, "debited from First Demo Bank on 3"), (1, 4, "Name: ")], "doc_id int, line_number int, text string")
    got = {(r.line_number, r.field_type, r.normalized_value) for r in facts.extract(rows).collect()}
    assert {(1, "PERSON", "Asha K. Rao"), (3, "BANK_OR_WALLET", "First Demo Bank")} <= got
    assert (2, "BANK_OR_WALLET", "Demo") in got and not any(n == 4 for n, _, _ in got)
