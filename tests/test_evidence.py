"""Mail trees, timers, the audit feed, sketches, SQL functions, kept analyses, source checks and rules on small fixtures."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewell.functions import sql
from tracewell.functions import text as T
from tracewell.functions.unicode import form_c
from tracewell.operators import facts, lines, literal, relations, sketches
from tracewell.plans import analysis, case, graph, rules
from tracewell.sources import files, items, mail
from tracewell.streaming import cleanup, feed, limiter


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- lines in form C, and proposals on them


def test_proposals_on_texts_with_loose_accents(spark):
    """Two accents before a name shift nothing: lines are in form C, and so are the places in them."""
    docs = spark.createDataFrame([(1, "Reséné: Asha Rao\nK plain 한"), (2, None), (3, "")], "doc_id int, text string")
    found = lines.split_lines(docs)
    assert [r.text for r in found.orderBy("line_number").collect()] == ["Resénè: Asha Rao".replace("è", "é"), "K plain 한"]
    ask = spark.createDataFrame([(1, 1, [1], "PERSON", "Asha  Rao", None), (2, 1, [1], "PERSON", "Resené", None), (3, 1, [1], "PERSON", "Reséné", 0)], "proposal_id int, doc_id int, line_numbers array<int>, field_type string, value string, at int")
    got = {r.proposal_id: r for r in literal.validate_spans(ask, found).collect()}
    assert [got[i].rejection for i in (1, 2, 3)] == [None, "NOT_LITERAL", None]
    assert got[1].matched == got[1].normalized_value == "Asha Rao" and [tuple(x) for x in got[1].matched_lines] == [(1, 8, 16)]
    assert form_c is not None and items.canonical_paste is not None


# ---- mail

NESTED = """From: =?utf-8?q?Asha_R=C3=A9?= <a@x.example>\r
To: b@x.example, c@x.example\r
Subject: two\r
 words\r
Date: Mon, 1 Jan 2026 10:00:00 +0530\r
MIME-Version: 1.0\r
Content-Type: multipart/mixed; boundary="m"\r
\r
--m\r
Content-Type: multipart/related; boundary="r"\r
\r
--r\r
Content-Type: text/html; charset="iso-8859-1"\r
Content-Transfer-Encoding: quoted-printable\r
\r
<p>Gr=FC=DFe &amp; <a href="https://x.example">this</a></p><script>no</script>\r
--r--\r
--m\r
Content-Type: image/png; name="a.png"\r
Content-Transfer-Encoding: base64\r
\r
AAECAw==\r
--m\r
Content-Type: message/rfc822\r
\r
From: z@x.example\r
Subject: inner\r
\r
inner body\r
--m--\r
"""


def test_mail_trees(spark):
    encrypted = b"From: a@x.example\r\nContent-Type: application/pkcs7-mime\r\n\r\nxx"
    odd = b"Subject: s\r\nContent-Type: text/plain; charset=\"no-such\"\r\n\r\nb\xe9 \r\n\r\n" + b"w " * 900
    rows = [(1, NESTED.encode()), (2, encrypted), (3, b"To: b@x.example\r\n\r\nno sender"), (4, None), (5, b""), (6, odd), (7, b"From: a@x.example\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\nno parts")]
    found, attached, failed = mail.parsed_mail(spark.createDataFrame(rows, "item_id int, content binary").withColumn("part", F.lit(1)))
    got = {}
    for r in found.orderBy("item_id", "line_number").collect():
        got.setdefault(r.item_id, []).append((r.line_number, r.header_name, r.text))
    assert got[1][:3] == [(1, "From", "Asha Ré <a@x.example>"), (2, "To", "b@x.example, c@x.example"), (3, "Subject", "two words")]
    assert got[1][3][:2] == (4, "Date") and got[1][4:] == [(5, None, "Grüße & this (https://x.example)")]
    assert rows_of(attached.select("item_id", "ordinal", "filename", "content_type", "size_bytes"))[:1] == [(1, 1, "a.png", "image/png", 4)]
    assert rows_of(attached.select("item_id", "ordinal", "filename", "content_type"))[1] == (1, 2, "unnamed", "message/rfc822")
    assert rows_of(failed) == [(2, "EMAIL_ENCRYPTED"), (3, "EMAIL_UNPARSEABLE"), (4, "EMAIL_UNPARSEABLE"), (5, "EMAIL_UNPARSEABLE")]
    assert [n for n, *_ in got[6]] == [1, 2, 3, 4] and all(len(t) <= 1000 for *_, t in got[6]) and got[7][0][1] == "From"
    assert all(x.count() == 0 for x in mail.parsed_mail(spark.createDataFrame([], "item_id int, content binary")))


# ---- streams


def test_abandoned_uploads(spark, tmp_path):
    at = datetime(2026, 1, 1, 10)
    m = lambda n: at + timedelta(minutes=n)
    first = [("a", "UPLOADING", m(0)), ("b", "UPLOADING", m(0)), ("c", "UPLOADING", m(1)), ("a", "UPLOADING", m(3)), ("d", "PROCESSED", m(2))]
    second = [("b", "UPLOADED", m(5)), ("d", "UPLOADING", m(1)), ("e", "UPLOADING", m(20)), ("x", "UPLOADED", m(21))]
    third = [("f", "UPLOADING", m(40)), ("x", "UPLOADED", m(60))]
    schema = "item_id string, status string, at timestamp"
    source, store = str(tmp_path / "in"), {k: spark.conf.get(k, None) for k in ("spark.sql.streaming.stateStore.providerClass",)}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n, part in enumerate((first, second, third, [("y", "UPLOADED", m(90))])):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
            stream = cleanup.abandoned_stream(spark.readStream.schema(schema).parquet(source))
            out = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            assert out.awaitTermination(300)
        got = rows_of(spark.read.parquet(str(tmp_path / "out")))
    finally:
        for k, v in store.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    assert got == [("a", m(0)), ("c", m(1)), ("e", m(20)), ("f", m(40))]
    # the same by the filter over the items' last state
    every = spark.createDataFrame(first + second + third, schema)
    last = every.groupBy("item_id").agg(F.min("at").alias("created_at"), F.when(F.bool_and(F.col("status") == "UPLOADING"), "UPLOADING").otherwise("UPLOADED").alias("processing_status"))
    assert rows_of(case.abandoned(last, F.lit(m(89))).select("item_id", "created_at")) == got


def test_audit_feed(spark, tmp_path):
    trail, sink, checkpoint = (str(tmp_path / x) for x in ("trail", "sink", "cp"))
    entry = lambda *rows: files.append_audit(spark.createDataFrame([(a, o, datetime(2026, 1, d)) for a, o, d in rows], feed.AUDIT), trail)
    entry(("LOGIN", "SUCCEEDED", 1), ("LOGIN", "FAILED", 1), ("LOGIN", "SUCCEEDED", 2))
    assert feed.follow(feed.new_entries(spark, trail), sink, checkpoint).awaitTermination(300) is not False
    entry(("LOGIN", "SUCCEEDED", 1), ("EXPORT", "SUCCEEDED", 3))
    assert feed.follow(feed.new_entries(spark, trail), sink, checkpoint).awaitTermination(300) is not False
    want = rows_of(feed.counted(spark.read.parquet(trail)).select("action", "outcome", "day", "n"))
    assert rows_of(feed.totals(spark, sink).select("action", "outcome", "day", "n")) == want and sum(r[3] for r in want) == 5
    # a batch that was written but not committed runs again and replaces itself
    last = max(int(x) for x in os.listdir(f"{checkpoint}/commits") if x.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(f"{checkpoint}/commits/{name}")
    feed.follow(feed.new_entries(spark, trail), sink, checkpoint).awaitTermination(300)
    assert rows_of(feed.totals(spark, sink).select("action", "outcome", "day", "n")) == want


def test_refreshes_and_limits(spark):
    seen = spark.createDataFrame([("s", n, datetime(2026, 1, 1) + timedelta(seconds=t)) for n, t in enumerate((0, 59, 60, 100, 119, 120, 300))], "k string, n int, at timestamp")
    assert [r.n for r in limiter.refreshes(seen, "k", "at", "n").orderBy("n").collect()] == [0, 2, 5, 6]
    assert limiter.decide([5, 7], 0, 10_000_000, []) == ([False, False], [10, 10], [])


# ---- sketches and SQL


def test_sketches_merge_within_their_bounds(spark):
    rows = spark.range(60_000).selectExpr("id % 30 AS day", "hash(id % 20000) AS who", "CAST(id % 1000 AS DOUBLE) AS value")
    days = sketches.sketched(rows, ["day"], "who", "value")
    whole = sketches.estimates(sketches.merged(days.withColumn("all", F.lit(1)), ["all"])).first()
    exact = rows.agg(F.count_distinct("who")).first()[0]
    assert whole.n == 60_000 and abs(whole.n_distinct - exact) < 0.05 * exact
    assert abs(whole.q50 - 500) < 30 and abs(whole.q95 - 950) < 30
    assert sketches.estimates(sketches.merged(days.limit(0), ["day"])).count() == 0
    nulls = spark.createDataFrame([(1, None, None), (1, "a", 2.0)], "day int, who string, value double")
    one = sketches.estimates(sketches.sketched(nulls, ["day"], "who", "value")).first()
    assert (one.n, one.n_distinct, one.q50) == (2, 1, 2.0)


def test_grouping_sets_tell_nulls_apart(spark):
    rows = spark.createDataFrame([("a", None), ("a", "x"), (None, "x")], "p string, q string")
    assert rows_of(sketches.grouping_sets(rows, [["p"], ["q"], []], F.count("*").alias("n"))) == sorted([("a", None, 1, 2), (None, None, 1, 1), (None, None, 2, 1), (None, "x", 2, 2), (None, None, 3, 3)], key=repr)


SAID = [
    "Call +91 98765-01234 now, or see HTTPS://Pay.Example.com/a/?x=1. and pay.shop/x)", "Mail Help@Mail.example.org, UPI ID: u7x@okBank, handle @Agent_7, t.me/some_one", "Rs. 1,234.05 debited from A/c XX1234, UTR: ab00000012 on 5 March 2024 at 9:05 pm",
    "Name: Asha Rao, VM-BANK", "Bank: North Trust. and it was debited from State Street Bank", "é𝄞 a.b@c.de account ending in 4321 around 10:30 ₹500", "", "nothing",
]


def test_functions_in_sql(spark):
    sql.register(spark)
    said = spark.createDataFrame([(1, n, t) for n, t in enumerate(SAID)], "doc_id int, line_number int, text string")
    got = spark.sql("SELECT d.line_number, f.* FROM {d} d, LATERAL extract_entities(d.text) f", d=said)
    want = facts.candidates(said).where("field_type not in ('DOMAIN', 'SMS_SENDER_HEADER')").select("line_number", "field_type", "raw_value", "start", "end")
    assert rows_of(got) == rows_of(want) and want.count() > 15
    assert spark.sql("SELECT count(*) FROM (SELECT CAST(NULL AS STRING) AS t) d, LATERAL extract_entities(d.t)").first()[0] == 0
    row = spark.sql("SELECT form_c('é') AS a, idn_to_ascii('bücher.example') AS b, idn_to_unicode('xn--bcher-kva.example') AS c, idn_to_ascii(NULL) AS d").first()
    assert tuple(row) == ("é", "xn--bcher-kva.example", "bücher.example", None)


def test_function_in_sql_is_called_for_rows_asked_for_only(spark):
    sql.register(spark)
    said = spark.createDataFrame([(n, t) for n, t in enumerate(SAID)], "line_number int, text string")
    got = spark.sql("SELECT d.line_number, f.raw_value FROM {d} d, LATERAL extract_entities(d.text, 'EMAIL') f WHERE d.text LIKE '%@%'", d=said)
    want = facts.candidates(said.withColumn("doc_id", F.lit(1))).where("field_type = 'EMAIL'").select("line_number", "raw_value")
    assert rows_of(got) == rows_of(want) and got.count() == 2
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("PythonUDTF") < plan.index("Filter")  # texts without an @ are gone before Python is called


# ---- kept analyses


def listing(path):
    return sorted((os.path.join(d, f), os.stat(os.path.join(d, f)).st_mtime_ns) for d, _, fs in os.walk(path) for f in fs)


def test_analysis_is_not_done_twice(spark, tmp_path):
    docs = spark.createDataFrame([(1, "see https://a.example/x now"), (2, "UTR: AB12345678 Rs. 500"), (3, None), (3, None), (4, "card 4111 1111 1111 1111")], "doc_id int, text string")
    path = str(tmp_path)
    found, store = analysis.analyze(docs, path)
    direct = facts.extract(lines.redact(lines.split_lines(docs.distinct())).select("doc_id", "line_number", "text"))
    assert rows_of(found["facts"].select("doc_id", "raw_value")) == rows_of(direct.select("doc_id", "raw_value"))
    assert {r.canonical_value for r in found["entities"].collect()} == {"https://a.example/x", "a.example", "AB12345678", "INR 500.00"}
    assert {(r.relation, r.from_value) for r in found["edges"].collect()} == {("HOSTED_ON", "https://a.example/x"), ("AMOUNT_OF", "INR 500.00")}
    assert not store.reused and len(store.written) == 6
    before = listing(path)
    again, store = analysis.analyze(docs, path)
    assert rows_of(again["entities"]) == rows_of(found["entities"]) and not store.written and listing(path) == before
    # one document changes and one goes: only the changed one is read again, and nothing of the old text is left
    changed = spark.createDataFrame([(1, "see https://b.example/y now"), (2, "UTR: AB12345678 Rs. 500")], "doc_id int, text string")
    new, store = analysis.analyze(changed, path)
    assert {r.canonical_value for r in new["entities"].collect()} == {"https://b.example/y", "b.example", "AB12345678", "INR 500.00"}
    done = [n for n in store.written if n.startswith("PARSE-done")]
    assert len(done) == 1 and spark.read.parquet(f"{path}/{done[0]}").count() == 1
    assert rows_of(analysis.analyze(docs, path)[0]["entities"]) == rows_of(found["entities"])


# ---- rules, sources, sinks


def test_timeline_places_what_has_no_time(spark):
    at = datetime(2026, 1, 1)
    rows = [("c", 1, "CALL", at, "EXACT", "E2", 1, 1, None), ("c", 2, "CALL", at, "EXACT", "E1", 1, 1, None), ("c", 3, "CALL", None, "INFERRED_ORDER_ONLY", "E1", 1, 9, 2), ("c", 4, "OTHER", None, "INFERRED_ORDER_ONLY", "E1", 1, 2, 2), ("c", 5, "CALL", None, "INFERRED_ORDER_ONLY", "E1", 1, 2, 2), ("c", 6, "CALL", None, "INFERRED_ORDER_ONLY", "E0", 1, 1, 77), ("c", 7, "CALL", None, "INFERRED_ORDER_ONLY", "E9", 1, 1, 3), ("d", 8, "CALL", None, "INFERRED_ORDER_ONLY", "E9", 1, 1, 1)]
    got = graph.timeline(spark.createDataFrame(rows, "case_id string, event_id int, event_type string, at timestamp, precision string, evidence_ref string, page int, line_number int, after_event int"))
    assert [r.event_id for r in got.where("case_id = 'c'").orderBy("position").collect()] == [2, 5, 4, 3, 1, 6, 7]
    assert got.where("case_id = 'd'").first().position == 1 and graph.timeline(got.drop("position").limit(0)).count() == 0


def test_stated_precision_is_kept(spark):
    rows = [("c", "e1", 1, 0, "DATE", "2026-01-01", "EXACT"), ("c", "e1", 2, 0, "TIME", "T10:30", "APPROXIMATE"), ("c", "e1", 3, 0, "TIME", "T10:31", "EXACT"), ("c", "e2", 1, 0, "TIME", "T11:00", "EXACT"), ("c", "e2", 2, 0, "DATETIME", "2026-01-01T12:00+05:30", "APPROXIMATE"), ("d", "e3", 1, 0, "TIME", "T12:00", "EXACT")]
    got = graph.times_of(spark.createDataFrame(rows, "case_id string, evidence_id string, line_number int, start int, kind string, value string, precision string"))
    assert [(r.precision, r.granularity, r.at) for r in got.orderBy("evidence_id", "line_number").collect()] == [("APPROXIMATE", "DATE", datetime(2025, 12, 31, 18, 30)), ("APPROXIMATE", "TIME", datetime(2026, 1, 1, 5, 0)), ("EXACT", "TIME", datetime(2026, 1, 1, 5, 1)), ("APPROXIMATE", "TIME", datetime(2026, 1, 1, 5, 30)), ("APPROXIMATE", "TIME", datetime(2026, 1, 1, 6, 30)), ("INFERRED_ORDER_ONLY", "TIME", None)]


def test_cues_of_proposals(spark):
    said = spark.createDataFrame([(1, 1, "You paid"), (1, 2, "to shop"), (2, 1, "nothing")], "evidence_id int, line_number int, text string")
    found = spark.createDataFrame([(1, 10, "TRANSACTION", 1, None, "T", 100), (1, 20, "UPI_ID", 1, None, "u@b", 101), (2, 10, "TRANSACTION", 1, None, "T", 200), (2, 20, "UPI_ID", 1, None, "u@b", 201)], "evidence_id int, entity_id int, field_type string, line_number int, header_name string, normalized_value string, fact_id int")
    cues = relations.item_cues(said, found, spark.createDataFrame([(1, "TEXT"), (2, "TEXT")], "evidence_id int, kind string"))
    asked = spark.createDataFrame([(1, 10, "PAID_TO", 20, [1], [100, 101]), (2, 10, "PAID_TO", 20, [1, 2], [100, 101, 200, 201])], "proposal_id int, from_entity int, relation string, to_entity int, evidence_ids array<int>, fact_ids array<int>")
    known = spark.createDataFrame([(10, "TRANSACTION"), (20, "UPI_ID")], "entity_id int, field_type string")
    judge = lambda c: {r.proposal_id: r.rejection for r in relations.judge_proposals(asked, known, found, relations.allowed_pairs(spark), c).collect()}
    assert judge(cues) == {1: None, 2: "NO_CUE"} and judge(None) == {1: None, 2: None}


def test_dates_without_times_contradict_by_day(spark):
    at = datetime(2026, 1, 1, 18, 29)
    rows = [("c", "e", 1, at, "EXACT", "TIME"), ("c", "e", 2, at + timedelta(minutes=1), "APPROXIMATE", "DATE"), ("c", "e", 3, at - timedelta(hours=20), "APPROXIMATE", "DATE"), ("c", "e", 4, at + timedelta(hours=9), "INFERRED_ORDER_ONLY", "DATE")]
    got = rules.time_contradictions(spark.createDataFrame(rows, "case_id string, event_key string, id int, at timestamp, precision string, granularity string"))
    assert rows_of(got.select("id_a", "id_b")) == [(1, 2), (2, 3)]


def test_sources_of_nothing(spark):
    owners = spark.createDataFrame([(1, "finding", 0), (2, "entity", 0), (3, "finding", 0)], "owner_id int, owner_kind string, case_id int")
    refs = spark.createDataFrame([(1, 1, "EVIDENCE", 5, None), (1, 2, "EVIDENCE", 5, None), (2, 1, "EXTRACTION", 5, None)], "owner_id int, ordinal int, ref_kind string, ref_id int, line_id int")
    of = lambda key: spark.createDataFrame([(0, 5)], f"case_id int, {key} int")
    links, wrong = case.attach_sources(owners, refs, of("extraction_id"), of("statement_id"), of("evidence_id"), spark.createDataFrame([], "evidence_id int, line_id int"))
    assert rows_of(wrong) == [(2, "ENTITY_NEEDS_STATEMENT"), (3, "NO_SOURCE")]
    assert rows_of(links.select("owner_id", "ref_id", "ordinal")) == [(1, 5, 1)]


def test_files_over_the_limit_and_replaced_partitions(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "big").write_bytes(b"x" * 2000)
    (tmp_path / "in" / "small").write_bytes(b"y")
    monkeypatch.setattr(files, "MAX_BYTES", 1000)
    assert [(os.path.basename(r.path), r.length, r.rejection) for r in files.oversized(spark, str(tmp_path / "in")).collect()] == [("big", 2000, "FILE_TOO_LARGE")]
    assert [os.path.basename(r.path) for r in files.read_files(spark, str(tmp_path / "in")).collect()] == ["small"]
    out = str(tmp_path / "out")
    table = lambda *rows: spark.createDataFrame(rows, "k int, v string")
    files.replace_partitions(table((1, "a"), (1, "b"), (2, "c")), out, "k")
    files.replace_partitions(table((1, "d")), out, "k")
    assert rows_of(spark.read.parquet(out).select("k", "v")) == [(1, "d"), (2, "c")]


@pytest.mark.parametrize("value,want", [(0.85, "HIGH"), (0.849, "MEDIUM"), (0.6, "MEDIUM"), (0.59, "LOW")])
def test_bands(spark, value, want):
    assert spark.range(1).select(T.confidence_band(F.lit(value)).alias("b")).first().b == want


def test_constraints_at_and_over_their_limits(spark):
    from tracewell.plans import constraints

    base = dict(item=1, sequence_no=1, evidence_type="PDF", paste_kind=None, label="x" * 100, original_filename="f" * 255, byte_size=10_485_760, text_char_count=None, page_count=20, image_width=None, image_height=None, sha256="a" * 64, uploaded_at="now", processing_status="PROCESSED", failure_code=None, failure_retryable=None, detected_content_type="application/pdf")
    schema = "item int, sequence_no int, evidence_type string, paste_kind string, label string, original_filename string, byte_size long, text_char_count int, page_count int, image_width int, image_height int, sha256 string, uploaded_at string, processing_status string, failure_code string, failure_retryable boolean, detected_content_type string"
    changes = [{}, {"sequence_no": 21}, {"label": "x" * 101}, {"byte_size": 10_485_761}, {"page_count": 21}, {"sha256": "A" * 64}, {"sha256": None, "uploaded_at": None}, {"failure_code": "X"}, {"processing_status": "FAILED", "failure_code": "PDF_NO_TEXT_LAYER", "failure_retryable": True}, {"evidence_type": "PNG", "page_count": None, "image_width": 8000, "image_height": 5001}, {"evidence_type": "URL", "paste_kind": "TEXT", "page_count": None, "text_char_count": 5, "original_filename": None}, {"detected_content_type": "text/html"}]
    rows = [tuple((base | c | {"item": n})[k.split()[0]] for k in schema.split(", ")) for n, c in enumerate(changes)]
    got = {}
    for r in constraints.check(spark.createDataFrame(rows, schema), "evidence_items", "item").collect():
        got.setdefault(r.item, set()).add(r.failed_check)
    assert got == {1: {"sequence_no_range"}, 2: {"label_length"}, 3: {"byte_size_range"}, 4: {"page_count_range"}, 5: {"sha256_format"}, 6: {"sha256_with_processing_status"}, 7: {"failure_code_with_processing_status"}, 8: {"no_text_layer_is_final"}, 9: {"pixels"}, 10: {"url_is_pasted_as_url"}, 11: {"content_type_once_loaded"}}
    sources = spark.createDataFrame([(1, "EXTRACTION", 5, None, None, 1, 1), (2, "EXTRACTION", None, 5, None, 1, 0), (3, "EVIDENCE", None, 5, 1, None, 1)], "k int, ref_kind string, extraction_id int, evidence_id int, entity_id int, relationship_id int, ordinal int")
    for name in ("timeline_event_id", "scam_signal_id", "missing_info_item_id", "action_item_id", "urgency_reason_id"):
        sources = sources.withColumn(name, F.lit(None).cast("int"))
    both = constraints.check_all({"fact_sources": (sources, "k"), "sessions": (spark.createDataFrame([(1, 2, 2)], "k int, created_at int, expires_at int"), "k")})
    assert rows_of(both) == sorted([("fact_sources", "2", "extraction_id_with_ref_kind"), ("fact_sources", "2", "evidence_id_with_ref_kind"), ("fact_sources", "2", "ordinal_range"), ("fact_sources", "3", "entity_id_only_with_ref_kind"), ("sessions", "1", "created_at_before_expires_at")], key=repr)
    levels = spark.createDataFrame([(1, 'HIGH', True, False, 'G2-v1'), (2, 'LOW', False, True, 'G2-v1'), (3, 'LOW', True, True, 'G1')], 'k int, level string, signal_u1_financial_loss boolean, signal_u2_credential_exposure boolean, rule_version string')
    assert rows_of(constraints.check(levels, 'urgency_assessments', 'k')) == [(2, 'level_fits_signals')]
    voided = spark.createDataFrame([(1, None), (1, 'x'), (2, None), (2, None), (None, None), (None, None)], 'report_id int, voided_at string')
    assert rows_of(constraints.more_than_one(voided, 'review_confirmations')) == [(2, 2)]
    assert sum(map(len, constraints.RULES.values())) > 100 and constraints.check(sources.limit(0), "fact_sources", "k").count() == 0


def test_a_message_is_one_row_and_its_headers_are_parsed_once(spark, monkeypatch):
    row = b"From: A <a@x.example>\r\nSubject: s\r\nContent-Type: text/plain\r\n\r\n \r\nbody\r\n"
    seen, real = [], mail.policy.EmailPolicy.header_fetch_parse
    monkeypatch.setattr(mail.policy.EmailPolicy, "header_fetch_parse", lambda self, name, value: seen.append(name) or real(self, name, value))
    mail._header.cache_clear()
    first = mail.walk(row)
    assert mail.walk(row) == first and len(seen) == len(set(seen)) == 3
    got = mail.mail_items(spark.createDataFrame([(1, row), (1, row), (2, None)], "item_id int, content binary")).collect()
    assert [(r.item_id, r.body) for r in got if r.failure is None] == [(1, ["body"])] * 2
    assert [r.failure for r in got if r.item_id == 2] == ["EMAIL_UNPARSEABLE"]
