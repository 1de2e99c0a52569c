"""Language profiles: edge cases, and accuracy on held-out texts."""

import random

from tracewell.llm import language

SOUNDS = {"aa": ["tho", "wan", "ish", "ing"], "bb": ["eau", "oux", "ré", "ç"], "cc": ["sch", "ung", "ö", "ver"]}


def make(seed=1, n=40):
    rng = random.Random(seed)
    return [(10 * i + k, " ".join("".join(rng.choice(s) for _ in range(3)) for _ in range(20)), lang) for i in range(n) for k, (lang, s) in enumerate(SOUNDS.items())]


def test_accuracy_and_edges(spark):
    docs = spark.createDataFrame(make(), "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS lang_pred")
    profiles = language.prototypes(docs)
    test = make(seed=2)
    edges = [(9001, None, "aa"), (9002, "", None), (9003, "123 !?", "bb"), (9004, "x", None), (None, test[0][1], None), (9005, "漢字" * 3000 + "".join(chr(0x4E00 + k) for k in range(3000)), None)]
    found = language.identify(spark.createDataFrame(test + edges, "doc_id long, text string, lang string"), profiles).collect()
    got = {r.doc_id: r for r in found}
    assert len(found) == len(test) + len(edges)
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in test)
    assert [got[i].lang_pred for i in (9001, 9002, 9003)] == ["und"] * 3 and got[9004].lang_pred in SOUNDS and got[None].lang_pred == test[0][2]
    assert {r.doc_id for r in language.keep_identified(spark.createDataFrame(test + edges[:3], docs.select("doc_id", "text", "lang").schema)).collect()} == {i for i, _, _ in test}


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.prototypes(empty) == {}
    docs = spark.createDataFrame([(1, "abc", None)], empty.schema)
    assert [r.lang_pred for r in language.identify(docs, {}).collect()] == ["und"]
    assert language.identify(empty, {}).count() == 0


def test_texts_in_no_language_go_and_unlabelled_tables_stay(spark):
    rng = random.Random(3)
    gibberish = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (100, 200, 400)]
    clean = make()
    rows = clean + [(9100 + k, x, None) for k, x in enumerate([*gibberish, "漢字" * 300])] + [(9200, "ok", None), (9201, "123", None)]
    schema = "doc_id long, text string, lang string"
    kept = lambda rows: {r.doc_id for r in language.keep_identified(spark.createDataFrame(rows, schema)).collect()}
    assert kept(rows) == {i for i, _, _ in clean} | {9200}
    assert kept([(i, x, None) for i, x, _ in rows]) == {i for i, _, _ in rows} - {9201}
