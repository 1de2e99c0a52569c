"""The pipeline: each stage against what it may do, on a fixture with planted cases."""

import random
import re

import corpus_pipeline
from test_neardup import brute

from tracewell.llm import packing


def fixture(spark, tmp_path):
    rng = random.Random(5)
    sounds = {"aa": ["tho", "wan", "ish", "ing", "er"], "bb": ["eau", "oux", "ré", "ç", "la"]}
    say = lambda lang, n: " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    docs = [(i, say(lang, 80), lang, "src", 0) for i, lang in enumerate(["aa", "bb"] * 20)]
    near = docs[3][1].split()
    near[40] = "changed"
    docs += [(100, docs[3][1], "bb", "src", 0), (101, " ".join(near), "bb", "src", 0)]
    item = say("aa", 14)
    docs += [(102, say("aa", 40) + " " + item + " " + say("aa", 10), "aa", "src", 0)]
    docs += [(103, say("bb", 60) + " password=hunter2hunter2 end", "bb", "src", 0)]
    docs += [(104, "12345 !!", "aa", "src", 0), (105, None, None, "src", None), (106, "", "aa", "src", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, tmp_path):
    sf_dir = fixture(spark, tmp_path)
    docs, ids = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        ids.append({r.doc_id for r in docs.collect()})
    clean = set(range(40))
    assert ids == [clean | {100, 101, 102, 103}, clean | {102, 103}, clean | {103}, clean | {103}]
    text = {r.doc_id: r.text for r in docs.collect()}
    assert "hunter2" not in text[103] and "[SECRET]" in text[103]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == ids[-1]


def test_run_equals_stages_and_empty_tables(spark, tmp_path):
    sf_dir = fixture(spark, tmp_path / "some")
    got = corpus_pipeline.run(spark, sf_dir)
    tokenizer = packing.tokens_of(packing.tokenizer_path(packing.VOCABULARY)).tokenizer
    assert got.where("doc_id < 40").count() == sum(-(-(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) // 2048) for t in [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40").collect()])
    none = tmp_path / "none"
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{none}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(0).write.parquet(f"{none}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(none)).count() == 0


def naive(rows, item):
    """Stages two to four by plain loops over (id, text): what is left, with its text."""
    label = {i: c for i, _, c, _ in brute([(i, t) for i, t in rows], 5, 80)}
    left = [(i, t) for i, t in rows if label[i] == i]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
    cut = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    left = [(i, t) for i, t in left if not cut(words(t), min(10, len(words(item)))) & cut(words(item), min(10, len(words(item))))]
    return {i: re.sub(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}", "[SECRET]", t) for i, t in left}


def test_stages_against_plain_loops(spark, tmp_path):
    sf_dir = fixture(spark, tmp_path)
    docs = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    want = naive([(r.doc_id, r.text) for r in docs.collect()], spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, sf_dir)
    assert {r.doc_id: r.text for r in docs.collect()} == want
    tokenizer = packing.tokens_of(packing.tokenizer_path(packing.VOCABULARY)).tokenizer
    packed = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).collect()
    assert {(r.doc_id, r.length) for r in packed} == {(i, len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for i, t in want.items()}
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)


def test_repeated_rows_leave_one(spark, tmp_path):
    sf_dir = fixture(spark, tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 5")
    left = corpus_pipeline.near_dedup_stage(spark, docs.unionByName(docs).withColumn("kept", docs["doc_id"]), sf_dir)
    assert sorted(r.doc_id for r in left.collect()) == [0, 1, 2, 3, 4]
