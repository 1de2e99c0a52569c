"""Plans that work each row out once, and what they give for repeated rows."""

from pyspark.sql import functions as F

from tracewell.operators import facts, literal, relations

SAID = [(1, 1, "VM-HDFCBK"), (1, 2, "Rs. 50 debited from A/c XX1234, UTR: AB12345678"), (1, 3, "see https://a.example/x,b.example or +91 98765 43210")]
SCHEMA = "doc_id int, line_number int, text string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_facts_of_a_line_need_no_shuffle(spark):
    said = spark.createDataFrame([*SAID, SAID[2]], SCHEMA)
    found = facts.extract(said)
    assert "Exchange" not in plan(found)
    got = sorted((r.field_type, r.raw_value) for r in found.where("line_number = 3").collect())
    assert got == sorted([("URL", "https://a.example/x,b.example"), ("DOMAIN", "a.example"), ("DOMAIN", "b.example"), ("PHONE", "+91 98765 43210")] * 2)


def test_edges_of_payments_read_facts_once(spark):
    said = spark.createDataFrame(SAID, SCHEMA)
    got = facts.payment_edges(facts.extract(said), said)
    assert "Join" not in plan(got) and "Expand" not in plan(got)
    assert {(r.relation, r.from_value, r.to_value) for r in got.collect()} == {("AMOUNT_OF", "INR 50.00", "AB12345678"), ("DEBITED_FROM", "AB12345678", "1234")}


def test_contents_of_messages_read_facts_once(spark):
    said = spark.createDataFrame(SAID, SCHEMA)
    found = facts.extract(said).select(F.col("doc_id").alias("evidence_id"), "field_type", F.col("normalized_value").alias("entity_id"), F.lit(None).cast("string").alias("header_name"), "line_number")
    got = relations.messages_contained(spark.createDataFrame([(1, "TEXT")], "evidence_id int, kind string"), found)
    assert plan(got).count("Join") == 1
    assert {(r.from_entity, r.to_entity, r.n_items) for r in got.collect()} == {("VM-HDFCBK", "https://a.example/x,b.example", 1), ("VM-HDFCBK", "+919876543210", 1)}


def test_united_candidates_meet_once(spark):
    schema = "doc_id int, line_number int, field_type string, raw_value string, start int, end int"
    rules = spark.createDataFrame([(1, 1, "PERSON", "a", 0, 5)], schema)
    model = spark.createDataFrame([(1, 1, "PERSON", "b", 4, 6), (1, 1, "PERSON", "c", 7, 9), (1, 1, "PERSON", "c", 7, 9), (1, 2, "PERSON", "d", 0, 5)], schema)
    got = literal.union_candidates(rules, model)
    assert "Join" not in plan(got)
    assert sorted((r.method, r.raw_value) for r in got.collect()) == [("LLM", "c"), ("LLM", "d"), ("RULE", "a")]


def test_proposals_send_no_table_through_the_driver(spark):
    lines = spark.createDataFrame(SAID, SCHEMA)
    asked = spark.createDataFrame([(7, 1, [2], "TRANSACTION", "AB12345678", None)], "proposal_id int, doc_id int, line_numbers array<int>, field_type string, value string, at int")
    got = literal.validate_spans(asked, lines)
    assert "Broadcast" not in plan(got) and [(r.rejection, r.matched) for r in got.collect()] == [(None, "AB12345678")]


def test_words_are_laid_out_once(spark, tmp_path):
    from tracewell import evidence_catalog

    spark.createDataFrame([(1, "<p>One two</p>"), (2, "12"), (3, None)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    texts, _ = evidence_catalog.laid_out(spark, str(tmp_path))
    assert plan(texts).count("regexp_extract_all") == 1
    assert sorted(r.text for r in texts.collect()) == ["One", "p", "p", "two"]


def test_rules_and_model_search_lines_once(spark, tmp_path):
    from tracewell import case_catalog

    rows = [(1, 5, '{"k": 3}'), (2, 6, '{"k": 4}')]
    spark.createDataFrame(rows, "event_id long, user_id long, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = case_catalog.rule_and_model_facts(spark, str(tmp_path))
    assert plan(got).count("FileScan") == 1 and "Union" not in plan(got)
    assert "REPARTITION_BY_NUM" in plan(got).split("ArrowEvalPython")[-1]  # events are dealt before lines are searched
    assert {(r.field_type, r.n) for r in got.collect()} == {(k, 2) for k in (*relations.IDENTIFIERS, "PERSON", "BANK_OR_WALLET")}


def test_facts_with_their_methods_unite_as_two_tables_do(spark):
    rows = [(1, 1, "PERSON", "a", 0, 5, "RULE"), (1, 1, "PERSON", "b", 4, 6, "LLM"), (1, 1, "PERSON", "c", 7, 9, "LLM"), (1, 1, "PERSON", "c", 7, 9, "LLM")]
    both = spark.createDataFrame(rows, "doc_id int, line_number int, field_type string, raw_value string, start int, end int, method string")
    assert sorted((r.method, r.raw_value) for r in literal.united(both).collect()) == [("LLM", "c"), ("RULE", "a")]


def test_places_of_one_and_of_several_matches(spark):
    from tracewell.functions import patterns as P
    from tracewell.functions import text as T

    said = spark.createDataFrame([("é a@b.co x",), ("a@b.co, ç@d.eu a.b@c.de",), ("none",), ("😀 me@x.org",)], "text string")
    got = [[(s.value, s.start, s.end) for s in r[0]] for r in said.select(T.find_spans(F.col("text"), P.EMAIL)).collect()]
    assert got == [[("a@b.co", 2, 8)], [("a@b.co", 0, 6), ("a.b@c.de", 15, 23)], [], [("me@x.org", 2, 10)]]
