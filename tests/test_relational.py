"""Relational building blocks, case state, rules, sources and streams."""

import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewell.operators import relational
from tracewell.plans import case, graph, rules
from tracewell.sources import files
from tracewell.streaming import limiter, windows


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_merges(spark):
    old = spark.createDataFrame([(1, "Bank", 1), (2, "X", 1)], "k int, name string, n int")
    new = spark.createDataFrame([(1, "BANK", 5), (3, "Y", 2)], "k int, name string, n int")
    assert rows_of(relational.upsert(old, new, ["k"], keep=["name"])) == [(1, "Bank", 5), (2, "X", 1), (3, "Y", 2)]
    assert rows_of(relational.insert_missing(old, new, ["k"])) == [(3, "Y", 2)]
    assert rows_of(relational.reconcile(old, new, ["k"])) == [(1, "keep"), (2, "delete"), (3, "insert")]


def test_pages_and_cursors(spark):
    rows = spark.createDataFrame([(i % 3, f"k{i}") for i in range(10)], "at int, k string")
    seen, after = [], None
    while page := relational.keyset_page(rows, ["at", "k"], 4, after).collect():
        seen += [tuple(r) for r in page]
        after = seen[-1]
    assert seen == sorted(((i % 3, f"k{i}") for i in range(10)), reverse=True)
    page, more, cursor = relational.page_with_cursor(rows, ["at", "k"], 9)
    assert page.count() == 9 and more and not relational.page_with_cursor(rows, ["at", "k"], 9, cursor)[1]
    good = ("2026-01-01T00:00:00.000001Z", "0a0a0a0a-1111-2222-3333-0123456789ab")
    assert relational.decode_cursor(relational.encode_cursor(*good)) == good
    for bad in ("", "x", relational.encode_cursor("a", "b")[:-4], relational.encode_cursor("a", good[1]), relational.encode_cursor(good[0], "k")):
        with pytest.raises(ValueError):
            relational.decode_cursor(bad)


def test_counts_and_guards(spark):
    parents, children = spark.createDataFrame([(1,), (2,)], "p int"), spark.createDataFrame([(1, "A"), (1, "B"), (1, "A")], "q int, s string")
    assert rows_of(relational.status_counts(parents, children, "p", "q", "s", {"a": "A", "b": "B"})) == [(1, 3, 2, 1), (2, 0, 0, 0)]
    assert rows_of(relational.exactly_one(children, "q", "s")) == []
    slots = spark.createDataFrame([(1, 1), (1, 3), (2, 1), (2, 2)], "g int, n int")
    assert rows_of(relational.lowest_free_slot(slots, "g", "n", 2).na.fill(-1)) == [(1, 2), (2, -1)]
    checked = relational.violations(spark.createDataFrame([(1, 5), (2, None), (3, 50)], "k int, v int"), {"small": F.col("v") <= 10, "even": F.col("v") % 2 == 0}, "k")
    assert rows_of(checked) == [(1, "even"), (3, "small")]


def test_states_and_plans(spark):
    pairs = {(r.before, r.after) for r in case.transitions(spark).where("allowed").collect()}
    order = case.STATES
    assert all((a, b) in pairs for a, b in zip(order, order[1:]))
    assert ("EXPORTED", "NEW") in pairs and ("USER_REVIEW", "EXTRACTED") in pairs and ("EXPORTED", "REPORT_DRAFT") in pairs
    assert ("NEW", "EXTRACTED") not in pairs and ("EXPORTED", "CORRELATED") not in pairs and ("ACTIONS_READY", "USER_REVIEW") not in pairs
    asked = [("UPLOAD", "NEW", False), ("ANSWER", "X", True), ("ANSWER", "X", False), ("CORRECTION", "TIMELINE_READY", False), ("CORRECTION", "TIMELINE_READY", True), ("CORRECTION", "EXTRACTED", True)]
    plans = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "i int, t string, s string, c boolean").select("i", case.plan_steps(F.col("t"), F.col("s"), F.col("c")).alias("p")).orderBy("i").collect()
    assert [r.p[1] for r in plans] == ["PARSE", "TIMELINE", "MISSING_INFO", "ACTIONS", "MISSING_INFO", "NORMALIZE"]
    assert all(r.p[0] == "PLAN" and r.p[-1] == "URGENCY" for r in plans)


def test_overview(spark):
    cases = spark.createDataFrame([("a",), ("b",)], "case_id string")
    evidence = spark.createDataFrame([("a", "PROCESSED"), ("a", "FAILED")], "case_id string, processing_status string")
    runs = spark.createDataFrame([("a", "r1", "OK", datetime(2026, 1, 1)), ("a", "r2", "FAILED", datetime(2026, 1, 2))], "case_id string, run_id string, status string, created_at timestamp")
    entities = spark.createDataFrame([("a", "URL"), ("a", "URL"), ("a", "PHONE")], "case_id string, field_type string")
    got = {r.case_id: r for r in case.overview(cases, evidence, runs, entities).collect()}
    assert (got["a"].evidence_total, got["a"].evidence_failed, got["a"].latest_run_id, got["a"].entity_counts) == (2, 1, "r2", {"URL": 2, "PHONE": 1})
    assert (got["b"].evidence_total, got["b"].latest_run_id, got["b"].entity_counts) == (0, None, {})
    steps = spark.createDataFrame([(1, "a", "P", "h", "SUCCEEDED"), (2, "a", "P", "h", "PLANNED"), (3, "a", "P", "g", "PLANNED")], "step_id int, case_id string, step_name string, input_hash string, status string")
    assert rows_of(case.reusable_steps(steps)) == [(2, 1)]


def test_rules(spark):
    at = datetime(2026, 9, 24, 12, 0)
    times = [("c", "e", i, at + timedelta(minutes=m), p) for i, m, p in ((1, 0, "EXACT"), (2, 2, "EXACT"), (3, 3, "EXACT"), (4, 10, "APPROXIMATE"), (5, 31, "APPROXIMATE"))]
    got = rules.time_contradictions(spark.createDataFrame(times, "case_id string, event_key string, id int, at timestamp, precision string"))
    assert rows_of(got.select("id_a", "id_b")) == [(1, 3), (1, 5), (2, 5), (3, 5), (4, 5)]
    cases = spark.createDataFrame([("a", "v")], "case_id string, variant string")
    required = spark.createDataFrame([("v", "PHONE"), ("v", "AMOUNT"), ("w", "URL")], "variant string, field string")
    assert rows_of(rules.checklist(cases, spark.createDataFrame([("a", "PHONE")], "case_id string, field string"), required)) == [("a", "AMOUNT")]


def test_files(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480) + b"\x08\x02\0\0\0"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 33, 44) + b"\x01\x11\x00"
    mail = b"From: A <a@x.example>\r\nSubject: two\r\n words\r\nContent-Type: text/html\r\n\r\n<p>see <a href=\"https://x.example\">this</a></p><script>no</script>"
    for name, data in {"a.png": png, "b.jpg": jpeg, "c.txt": "é".encode(), "d.bin": b"\0\x01", "e.pdf": b" %PDF-1.7", "f.eml": mail}.items():
        (tmp_path / name).write_bytes(data)
    found = files.read_files(spark, str(tmp_path))
    kind = {r.path[-5:]: r.kind for r in found.select("path", files.content_type(F.col("content")).alias("kind")).collect()}
    assert kind == {"a.png": "image/png", "b.jpg": "image/jpeg", "c.txt": "text", "d.bin": "binary", "e.pdf": "application/pdf", "f.eml": "text"}
    assert found.where("path like '%png'").select(files.png_size(F.col("content")).alias("s")).first().s.asDict() == {"width": 640, "height": 480}
    assert [(r.width, r.height) for r in files.jpeg_size(found.where("path like '%jpg'")).collect()] == [(44, 33)]
    assert [(r.ordinal, r.header_name, r.text) for r in files.mail_lines(found.where("path like '%eml'")).orderBy("ordinal").collect()] == [(1, "From", "A <a@x.example>"), (2, "Subject", "two words"), (3, None, "see this (https://x.example)")]


def test_limiter_batch_equals_stream(spark, tmp_path):
    start = datetime(2026, 1, 1)
    rows = [(i, i % 3, start + timedelta(seconds=(i * 37) % 400 if i % 2 else i * 11)) for i in range(90)]
    data = spark.createDataFrame(rows, "event_id int, user_id int, ts timestamp")
    batch = limiter.limit_events(data, "user_id", "ts", "event_id", 3, 60)
    held, want = {}, set()
    for i, u, t in sorted(rows, key=lambda r: (r[2], r[0])):
        own = [x for x in held.get(u, []) if x > t - timedelta(seconds=60)]
        ok = len(own) < 3
        held[u] = own + [t] * ok
        want.add((u, i, ok))
    assert {(r.user_id, r.event_id, r.allowed) for r in batch.collect()} == want
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    out = limiter.limit_stream(stream, "user_id", "ts", "event_id", 3, 60).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert {(r.user_id, r.event_id, r.allowed) for r in spark.table("limited").collect()} == want


def test_windows(spark, tmp_path):
    start = datetime(2026, 1, 1)
    rows = [(i, "a", start + timedelta(hours=h)) for i, h in enumerate((0, 1, 2, 30, 31, 100))]
    data = spark.createDataFrame(rows, "event_id int, kind string, ts timestamp")
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    for name, df, want in (("days", windows.tumbling_stream(stream, "ts", "1 day", "1 hour", "kind"), [3, 2]), ("sessions", windows.session_stream(stream, "ts", "2 hours", "1 hour", "kind"), [3, 2])):
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
        assert [r.n for r in spark.table(name).orderBy("start").collect()] == want


def test_entry_without_llm(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() >= 0


def test_graph_and_timeline(spark):
    times = [("c", 1, None, "INFERRED_ORDER_ONLY", "E02", 1), ("c", 2, datetime(2026, 1, 2), "EXACT", "E01", 3), ("c", 3, datetime(2026, 1, 1), "APPROXIMATE", "E01", 1), ("c", 4, datetime(2026, 1, 1), "EXACT", "E03", 1)]
    order = graph.timeline(spark.createDataFrame(times, "case_id string, event_id int, at timestamp, precision string, evidence_ref string, line_number int"))
    assert [r.event_id for r in order.orderBy("position").collect()] == [4, 3, 2, 1]
    facts = [("c", "e1", 1, 0, "DATE", "2026-01-01"), ("c", "e1", 2, 0, "TIME", "T10:00"), ("c", "e2", 1, 0, "TIME", "T11:00"), ("d", "e3", 1, 0, "TIME", "T12:00")]
    got = graph.assign_times(spark.createDataFrame(facts, "case_id string, evidence_id string, line_number int, start int, kind string, value string"))
    assert rows_of(got.select("evidence_id", "day", "precision").na.fill("-")) == [("e1", "2026-01-01", "EXACT"), ("e2", "2026-01-01", "APPROXIMATE"), ("e3", "-", "INFERRED_ORDER_ONLY")]
    sections = spark.createDataFrame([("c", "b", "2"), ("c", "a", "1")], "case_id string, section string, content string")
    assert graph.snapshot(sections).first().snapshot == '{"a":"1","b":"2"}'
    cases, evidence = spark.createDataFrame([("c",)], "case_id string"), spark.createDataFrame([("c", 1)], "case_id string, evidence_id int")
    entities = spark.createDataFrame([("c", 7, "a***")], "case_id string, entity_id int, masked_value string")
    assert rows_of(graph.nodes(cases, evidence, entities).select("node_id", "label")) == [("c:c", "c"), ("e:1", "1"), ("n:7", "a***")]
    appears = spark.createDataFrame([("c", 7, 1), ("c", 7, 1)], "case_id string, entity_id int, evidence_id int")
    relations = spark.createDataFrame([("c", 7, 8, "PAID_TO")], "case_id string, from_entity int, to_entity int, relation string")
    assert rows_of(graph.edges(appears, relations).select("from_node", "to_node", "kind")) == [("n:7", "e:1", "APPEARS_IN"), ("n:7", "n:8", "PAID_TO")]


def test_gates(spark):
    now = datetime(2026, 1, 1, 12)
    rows = [(1, "UPLOADING", now - timedelta(minutes=16), None, now), (2, "UPLOADING", now - timedelta(minutes=5), None, now), (3, "FAILED", now, True, now), (4, "FAILED", now, False, now), (5, "UPLOADED", now, None, now + timedelta(hours=1))]
    evidence = spark.createDataFrame(rows, "evidence_id int, processing_status string, created_at timestamp, failure_retryable boolean, uploaded_at timestamp")
    assert [r.evidence_id for r in case.abandoned(evidence, F.lit(now)).collect()] == [1]
    assert [r.evidence_id for r in case.planned_evidence(evidence, F.lit(now)).collect()] == [3]
    item = "item_id int, sha256 string"
    assert rows_of(case.input_changes(spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], item), spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], item))) == [(2, "CHANGED"), (3, "REMOVED"), (4, "ADDED")]
    steps = [("r", 1, "PARSE", "SUCCEEDED", None), ("r", 2, "EXTRACT", "FAILED", "X"), ("r", 3, "NORMALIZE", "FAILED", "CASE_CHANGED"), ("s", 1, "PARSE", "SKIPPED", None), ("t", 1, "PARSE", "PLANNED", None)]
    got = case.run_outcomes(spark.createDataFrame(steps, "run_id string, sequence_no int, step_name string, status string, failure_code string"))
    assert rows_of(got.na.fill("-")) == [("r", "FAILED", "NORMALIZE"), ("s", "SUCCEEDED", "-"), ("t", "RUNNING", "-")]
    audit = spark.createDataFrame([(1, "LOGIN", {"ip": "1.2.3.4", "extra": "x"})], "audit_id int, action string, metadata map<string,string>")
    allowed = spark.createDataFrame([("LOGIN", "ip", r"^[0-9.]+$")], "action string, key string, pattern string")
    assert rows_of(case.audit_violations(audit, allowed)) == [(1, "extra")]
    challenges = spark.createDataFrame([(1, None, now + timedelta(hours=1), 0), (2, now, now + timedelta(hours=1), 0), (3, None, now, 0), (4, None, now + timedelta(hours=1), 5)], "id int, consumed_at timestamp, expires_at timestamp, attempts int")
    assert sorted(r.id for r in case.expired(challenges, F.lit(now), 5).collect()) == [2, 3, 4]
    one, two = (spark.createDataFrame(x, "g int, a int") for x in ([(1, 2), (1, 1)], [(1, 1), (1, 2)]))
    assert case.ordered_fingerprint(one, "g", ["a"]).collect() == case.ordered_fingerprint(two, "g", ["a"]).collect()


def test_labels_actions_and_facts(spark):
    from tracewell.operators import facts

    labels = spark.createDataFrame([("a", "X", True), ("a", "Y", False), ("b", "X", True), ("b", "UNKNOWN_OTHER", False), ("c", "X", False)], "case_id string, label string, is_primary boolean")
    assert rows_of(rules.label_violations(labels)) == [("b",), ("c",)]
    triggers = spark.createDataFrame([("a", "money"), ("a", "link")], "case_id string, trigger string")
    templates = spark.createDataFrame([("money", "CALL_BANK", 1), ("link", "REPORT_LINK", 2), ("link", "CALL_BANK", 5)], "trigger string, action string, rank int")
    assert rows_of(rules.ranked_actions(triggers, templates)) == [("a", "CALL_BANK", 1), ("a", "REPORT_LINK", 2)]
    lines = spark.createDataFrame([(1, 1, "urgent: pay a@b.example [REDACTED:OTP] now"), (1, 2, "blocked, pay")], "doc_id int, line_number int, text string")
    assert rows_of(rules.indicators(lines)) == [(1, "ACCOUNT_THREAT", 2), (1, "CREDENTIAL_REQUEST", 1), (1, "PAYMENT_REQUEST", 1), (1, "URGENT_LANGUAGE", 1)]
    proposed = [(1, 1, "EMAIL", "a@b.example"), (1, 9, "EMAIL", "a@b.example"), (1, 1, "EMAIL", "x@b.example"), (1, 1, "PERSON", "[REDACTED:OTP]"), (1, 1, "PHONE", "urgent")]
    got = facts.validate(spark.createDataFrame(proposed, "doc_id int, line_number int, field_type string, raw_value string"), lines)
    assert sorted((r.line_number, r.raw_value, r.rejection or "") for r in got.collect()) == [(1, "[REDACTED:OTP]", "REDACTED_SPAN"), (1, "a@b.example", ""), (1, "urgent", "FORMAT"), (1, "x@b.example", "NOT_LITERAL"), (9, "a@b.example", "FOREIGN_LINE")]
    row = spark.createDataFrame([("x" * 150 + "HIT" + "y" * 150, [0.9, None], 0.95)], "t string, o array<double>, j double")
    made = row.select(facts.snippet(F.col("t"), F.lit(150), F.lit(153)).alias("s"), facts.confidence(F.col("o")).alias("c"), facts.confidence(F.col("o"), F.col("j")).alias("d"), rules.event_key(F.lit("PAID"), F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("k")).first()
    assert len(made.s) == 200 and "HIT" in made.s and (made.c, made.d, made.k) == (0.9, 0.84, "PAID|a,b")


def test_first_deliveries(spark, tmp_path):
    start = datetime(2026, 1, 1)
    data = spark.createDataFrame([(1, start), (1, start + timedelta(minutes=1)), (2, start)], "event_id int, ts timestamp")
    data.write.parquet(str(tmp_path / "in"))
    stream = windows.first_deliveries(spark.readStream.schema(data.schema).parquet(str(tmp_path / "in")), ["event_id"], "ts", "1 hour")
    stream.writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.event_id for r in spark.table("firsts").collect()) == [1, 2]
