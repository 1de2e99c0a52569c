"""Cases, items, proposals and steps on small fixtures: nulls, ties, repeated rows, empty tables."""

import pytest
from pyspark.sql import functions as F

from tracewell.functions import text as T
from tracewell.operators import literal, relational, relations, resolution
from tracewell.plans import lifecycle
from tracewell.sources import items


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


FACT = "case_id int, fact_id int, evidence_no int, evidence_status string, field_type string, raw_value string, normalized_value string, status string, corrected_value string"


def test_entities_of_cases(spark):
    fact = lambda c, i, kind, value, no=1, state="PROCESSED", fixed=None: (c, i, no, state, kind, value, value, "NORMALIZED", fixed)
    rows = [fact(1, 1, "BANK_OR_WALLET", "North BANK", 2), fact(1, 2, "BANK_OR_WALLET", "North Bank"), fact(2, 3, "BANK_OR_WALLET", "north bank"), fact(1, 4, "EMAIL", "a@b.co", fixed="C@D.co"), fact(1, 5, "EMAIL", "c@d.co"), fact(1, 6, "DATETIME", "x"), fact(1, 7, "EMAIL", "e@f.co", state="FAILED"), fact(None, 8, "EMAIL", "g@h.co"), fact(1, 9, "PHONE", "+919876500000", fixed="no number")]
    facts = spark.createDataFrame(rows, FACT)
    found = resolution.resolve(facts)
    assert rows_of(found.select("case_id", "canonical_value", "n_facts")) == [(1, "North Bank", 2), (1, "c@d.co", 2), (2, "north bank", 1)]
    old = spark.createDataFrame([(1, "BANK_OR_WALLET", "NORTH BANK")], "case_id int, field_type string, canonical_value string")
    assert rows_of(resolution.resolve(facts, old).select("canonical_value", "created")) == [("NORTH BANK", False), ("c@d.co", True), ("north bank", True)]
    assert {r.fact_id: r.canonical_value for r in resolution.assign(facts, found).collect()} == {1: "North Bank", 2: "North Bank", 3: "north bank", 4: "c@d.co", 5: "c@d.co", 6: None, 7: None, 8: None, 9: None}
    assert rows_of(resolution.unmerged(facts).select("fact_id")) == [(9,)]
    asked = spark.createDataFrame([(4, "x"), (5, " C@D.CO "), (9, "98765 00001"), (77, "a"), (3, None)], "fact_id int, new_value string")
    got = {r.fact_id: r.outcome for r in resolution.correct(facts, asked).collect()}
    assert got[5] == "UNCHANGED" and got[9] == "CHANGED" and got[77] == "UNKNOWN_FACT" and got[3] == "FORMAT"
    fixed = resolution.apply_corrections(facts, asked.where("fact_id = 9"))
    assert resolution.resolve(fixed).where("field_type = 'PHONE'").first().canonical_value == "+919876500001"
    assert resolution.resolve(facts.limit(0)).count() == 0


def test_invalidated_sources(spark):
    sources = spark.createDataFrame([(1, 10, 100), (1, 11, 100), (1, 12, 101), (2, 13, 100), (3, 10, 100)], "edge_id int, fact_id int, evidence_id int")
    left = resolution.invalidate(sources, spark.createDataFrame([(10, 100)], "fact_id int, evidence_id int"))
    assert rows_of(left.select("edge_id", "fact_id", "evidence_id")) == [(1, 12, 101), (2, 13, 100)]


@pytest.mark.parametrize(
    "lines,value,at,want",
    [(["Paid  to", "Asha Rao"], "to asha rao", None, None), (["Paid  to", "Asha Rao"], "to Asha Rao", None, (6, 17)), (["ab ab"], "ab", 3, (3, 5)), (["ab ab"], "ab", 2, (0, 2)), ([" x "], "  ", None, None), (["a"], "", None, None), (["a.b|c (d)"], "b|c  (d)", None, (2, 9)), (["$1 x\\y"], "$1 x\\y", None, (0, 6)), (["é́x é b"], "é b", 9, (4, 7)), (["𝄞 no 𝄞 yes"], "𝄞 yes", None, (5, 10)), (["a-a-a"], "a-a", 2, (2, 5))],
)
def test_literal_match(spark, lines, value, at, want):
    row = spark.createDataFrame([(" ".join(lines), value, at)], "t string, v string, at int")
    got = row.select(literal.place(F.col("t"), literal.value_pattern(F.col("v"), F.lit(False)), F.col("at")).alias("x")).first().x
    assert (got and tuple(got)) == want


def test_proposals_over_lines(spark):
    lines = spark.createDataFrame([(1, 1, "UTR: AB12"), (1, 2, "CD3456 end"), (1, 3, "Card [REDACTED:CARD] x"), (1, 4, "debited from North Bank")], "doc_id int, line_number int, text string")
    ask = [(1, 1, [1], "TRANSACTION", "AB12"), (2, 1, [3], "PERSON", "[REDACTED:CARD]"), (3, 1, [4], "BANK_OR_WALLET", "North Bank"), (4, 1, [4], "BANK_OR_WALLET", "Bank"), (5, 1, [], "PERSON", "x"), (6, 1, [1, 9], "PERSON", "UTR"), (7, 1, [1, 2], "TRANSACTION", "AB12 CD3456"), (8, 1, [1], "PERSON", None)]
    got = {r.proposal_id: r for r in literal.validate_spans(spark.createDataFrame(ask, "proposal_id int, doc_id int, line_numbers array<int>, field_type string, value string").withColumn("at", F.lit(None).cast("int")), lines).collect()}
    assert {i: r.rejection for i, r in got.items()} == {1: "FORMAT", 2: "REDACTED_SPAN", 3: None, 4: "FORMAT", 5: "FOREIGN_LINE", 6: "FOREIGN_LINE", 7: None, 8: "NOT_LITERAL"}
    assert [tuple(x) for x in got[7].matched_lines] == [(1, 5, 9), (2, 0, 6)]
    assert got[7].matched == "AB12 CD3456"


def test_items(spark):
    rows = [(1, "TEXT", "﻿hello big world\r\n\r\nnext line"), (2, "TEXT", " short "), (3, "URL", " https://a.example/x "), (4, "HTML", "<head><title>t</title></head><p>One &amp; two&#33;<br>three <a href='x'>y</a> <a href=\"u\">link</a>"), (5, "EML", "Subject: x\n\nbody of it"), (6, "EML", "no mail"), (7, "PDF", "x"), (8, "TEXT", None)]
    found, failed = items.parsed(spark.createDataFrame(rows, "item_id int, kind string, text string"))
    assert rows_of(failed) == [(2, "NO_READABLE_TEXT"), (6, "CONTENT_TYPE_MISMATCH"), (7, "TYPE_NOT_SUPPORTED"), (8, "NO_READABLE_TEXT")]
    text = {}
    for i, n, x in rows_of(found):
        text.setdefault(i, []).append(x)
    assert text == {1: ["hello big world", "next line"], 3: ["https://a.example/x"], 4: ["One & two!", "three y link (u)"], 5: ["x", "body of it"]}
    one = spark.createDataFrame([("é\r\nx",)], "t string").select(items.canonical_paste(F.col("t")).alias("t")).first().t
    assert one == "é\nx"


def test_lifecycle(spark):
    runs = spark.createDataFrame([(1, "PLAN", "SUCCEEDED"), (1, "PARSE", "SUCCEEDED"), (1, "PARSE", "PENDING"), (1, "EXTRACT", "PENDING"), (2, "PLAN", "PENDING")], "run_id int, step_name string, status string")
    assert rows_of(lifecycle.ready_steps(runs, lifecycle.dependencies(spark))) == [(1, "PARSE"), (2, "PLAN")]
    steps = spark.createDataFrame([(1, 1, "A", "SUCCEEDED", "h", None), (2, 2, "A", "SKIPPED", "h", 1), (3, 2, "B", "SKIPPED", "h", 1), (4, 2, "A", "SKIPPED", "k", 1), (5, 2, "A", "SKIPPED", "h", None)], "step_id int, run_id int, step_name string, status string, input_hash string, reused_step_id int")
    assert rows_of(lifecycle.done_steps(steps).select("step_id")) == [(1,), (2,)]
    state = lambda s, *done: spark.range(1).select(lifecycle.advanced(F.lit(s), F.array(*map(F.lit, done)).cast("array<string>")).alias("s")).first().s
    assert state("EXTRACTED", "SCAM_ANALYSIS", "CORRELATE") == "CORRELATED" and state("EXTRACTED", "CORRELATE") == "EXTRACTED" and state("NEW") == "NEW"
    assert spark.range(1).select(lifecycle.rewound(F.lit("EXPORTED"), F.lit("EXTRACTED")), lifecycle.rewound(F.lit("NEW"), F.lit("EXTRACTED"))).first()[:] == ("EXTRACTED", "NEW")


def test_updates(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", None)], "k int, s string, n int")
    patches = spark.createDataFrame([(1, ["s", "n"], None, 1), (2, ["n"], "ignored", None)], "k int, given array<string>, s string, n int")
    assert rows_of(relational.partial_update(rows, patches, "k", ["s", "n"])) == [(1, None, 1, ["s"]), (2, "b", None, [])]
    merged = spark.range(1).select(relational.merged_map(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))), relational.merged_map(F.lit(None).cast("map<string,string>"), F.lit(None).cast("map<string,string>"))).first()
    assert merged[0] == {"a": "1", "b": "3"} and merged[1] == {}
    before, after = (spark.createDataFrame(x, "k int, sha string") for x in ([(1, "x"), (2, None), (3, "z")], [(1, "y"), (2, "n"), (3, "z")]))
    assert rows_of(relational.immutable_violations(before, after, "k", ["sha"])) == [(1, "sha")]
    left = relational.cascade(rows.where("k = 1"), "k", {"child": (spark.createDataFrame([(1, 5), (2, 6), (None, 7)], "p int, c int"), "p")})
    assert rows_of(left["child"]) == [(2, 6), (None, 7)]
    assert rows_of(relational.duplicates(spark.createDataFrame([(1,), (1,), (None,), (None,)], "k int"), ["k"])) == [(1, 2)]


def test_senders_and_names(spark):
    its = spark.createDataFrame([(1, "EML"), (2, "TEXT"), (3, "TEXT"), (4, "EML")], "evidence_id int, kind string")
    facts = [(1, "EMAIL", "a", "From", 1), (1, "EMAIL", "b", None, 5), (1, "URL", "u", None, 6), (2, "SMS_SENDER_HEADER", "s", None, 1), (2, "PHONE", "p", None, 2), (3, "SMS_SENDER_HEADER", "s", None, 1), (3, "SMS_SENDER_HEADER", "s", None, 4), (3, "PHONE", "p", None, 2), (4, "EMAIL", "a", "From", 1), (4, "EMAIL", "c", "from", 2), (4, "URL", "u", None, 3)]
    table = spark.createDataFrame(facts, "evidence_id int, field_type string, entity_id string, header_name string, line_number int")
    assert rows_of(relations.messages_contained(its, table)) == [("a", "u", 1, 1), ("s", "p", 1, 2)]
    heads = spark.createDataFrame([(1, 1, "From", '"Asha Rao" <a@b.c>'), (2, 1, "from", "<a@b.c>"), (3, 1, "To", "X <a@b.c>"), (4, 1, "From", None)], "doc_id int, line_number int, header_name string, text string")
    assert rows_of(relations.display_names(heads)) == [(1, 1, "Asha Rao", 1)]
