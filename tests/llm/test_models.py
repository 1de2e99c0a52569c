"""Language model, quality and toxicity: base scores by brute force, gradients by differences, held-out accuracy, edges."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import language_model, quality, toxicity
from tracewell.llm.common import crc_mod


def lm_rows():
    rng = random.Random(1)
    words = ["the", "cat", "sat", "on", "mat", "And", "dogs", "unbelievable", "Ünï"] + [f"rare{k}" for k in range(40)]
    rows = [(i, " ".join(rng.choices(words, weights=[30] * 9 + [1] * 40, k=rng.randint(1, 90)))) for i in range(80)]
    return rows + [(500, None), (501, ""), (502, "x" * 3000), (3, rows[3][1]), (None, "the cat")]


def test_base_scores(spark, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", 6)
    rows = lm_rows()
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode())
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + ["</s>"]
    counts = {}
    for i, t in rows:
        if crc(i) % 10:
            for w in tokens(t):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kind", "2 AS word", "3 AS c")
    got = language_model.score_documents(docs, crc_mod(F.col("doc_id"), 10) != 0).collect()
    want = sorted((str(i), len(tokens(t)), sum(w in counts for w in tokens(t)), n, round(sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert language_model.score_documents(docs.limit(0), F.lit(True)).count() == 0


def small_model():
    rng = np.random.default_rng(3)
    counts = np.zeros(language_model.IDS)
    counts[:200] = rng.integers(1, 1000, 200)
    return counts, language_model.classes_of(counts)


def test_probabilities_sum_to_one():
    counts, (cls, share, mass) = small_model()
    assert np.allclose(np.bincount(cls, 10**share, minlength=language_model.CLASSES), 1)
    flat = language_model.first_weights(mass)
    scorer, context = language_model.Scorer(flat, counts), np.arange(37) % 90
    one_of_each = [int(np.flatnonzero(cls == c)[0]) for c in range(language_model.CLASSES)]
    texts = [np.append(context, x) for x in one_of_each]
    p = 10 ** (scorer(texts) - scorer([context]) - share[one_of_each])
    assert p.sum() == pytest.approx(1, abs=1e-3)


def test_training_and_scoring_see_the_same_windows():
    counts, (cls, share, mass) = small_model()
    flat = language_model.first_weights(mass)
    rng = np.random.default_rng(4)
    text = np.append(rng.integers(0, 200, 70), language_model.END).astype("<u2")
    windows = np.concatenate([language_model.windows_of([text], [k]) for k in range(language_model.TRAIN_EVERY)])
    inputs, targets = language_model.training_arrays(windows, cls)
    loss, _ = language_model.gradient(language_model.views(flat), inputs, targets)
    assert -loss * len(text) / np.log(10) + share[text].sum() == pytest.approx(language_model.Scorer(flat, counts)([text])[0], rel=1e-4)


def test_context_tells_ids_of_one_class_apart():
    counts, (cls, share, mass) = small_model()
    first, tree = language_model.first_weights(mass), language_model.Tree(cls, counts)
    # four ids of one class, two that come first and two that follow them
    a, b, c, d = np.flatnonzero(cls == np.argmax(np.bincount(cls[:200])))[:4]
    text = np.append(np.array([[1, a, c, 2], [1, b, d, 2]] * 100)[np.random.default_rng(2).permutation(200)].ravel(), language_model.END).astype("<u2")
    windows = language_model.windows_of([text], [0])
    arrays = language_model.training_arrays(windows, cls)
    trainer = language_model.Trainer(first, 0, language_model.first_tables(), tree)
    for _ in range(60):
        trainer(*arrays, windows)
    scorer = language_model.Scorer(trainer.flat, counts, trainer.tables)
    pairs = scorer([np.array(x) for x in ([1, a, c], [1, a, d], [1, b, d], [1, b, c])])
    assert pairs[0] > pairs[1] + 1 and pairs[2] > pairs[3] + 1
    # training and scoring agree, and all ids together have probability 1
    last, ids = language_model.last_and_next(windows)
    loss, _, out, _ = language_model.gradients(language_model.views(trainer.flat), *arrays, trainer.tables[1][last])
    within = tree(trainer.tables[0], out[ids >= 0], ids[ids >= 0])[0].sum()
    assert (within - loss * len(text)) / np.log(10) == pytest.approx(scorer([text])[0], rel=1e-3)
    assert (10 ** (scorer([np.array([1, a, x]) for x in range(language_model.IDS)]) - scorer([np.array([1, a])]))).sum() == pytest.approx(1, abs=1e-3)


def test_every_training_window_is_learnt_from(spark, monkeypatch):
    assert language_model.TRAIN_EVERY == 1
    text = np.append(np.arange(70) % 60, language_model.END).astype("<u2")
    pieces = list(language_model.pieces_of(text, 32))
    assert max(map(len, pieces)) == 2 and np.array_equal(np.concatenate(pieces), language_model.windows_of([text], [0]))
    shards = language_model.shards_of(list("abcdefg"), 3 * language_model.SHARD)
    assert len(shards) == 3 and sorted(sum(shards, [])) == list("abcdefg")
    # one short text in many decides the weights too: whatever it is, its windows are never left out
    monkeypatch.setattr(language_model, "SHARD", 40)
    monkeypatch.setattr(language_model, "PIECE", 16)
    learn = lambda last: language_model.train_model(language_model.saved(language_model.prepare(language_model._source(spark.createDataFrame([(k, "the cat sat") for k in range(6)] + [(9, last)], "doc_id long, text string").repartition(3, "doc_id"), "doc_id", "text", F.lit(True)), language_model.tokenizer_path(language_model.VOCABULARY)), "lm"), np.ones(language_model.IDS))
    assert all(not np.array_equal(learn(x)[0], learn("the cat sat")[0]) for x in ("sat cat the", "cat the sat"))


def test_training_is_dealt_to_all_cores(spark):
    sizes = lambda n, shards, cores: [len(s) for s in language_model.shards_of([f"{k:03}" for k in range(n)], shards * language_model.SHARD, cores)]
    assert sizes(36, 8, 6) == [6] * 6 and sizes(8, 3, 4) == [4, 4] and sizes(72, 5, 6) == [18] * 4 and sizes(3, 9, 6) == [3]
    assert sizes(40, 10, 4) == [4] * 10
    # a core that gets no file, or two where others get one, waits or is waited for
    docs = spark.createDataFrame([(k, "the cat sat " * (k % 7)) for k in range(403)], "doc_id long, text string").coalesce(1)
    ready = language_model.dealt(language_model.prepare(language_model._source(docs, "doc_id", "text", F.lit(True)), language_model.tokenizer_path(language_model.VOCABULARY)))
    rows = [r["count"] for r in ready.groupBy(F.spark_partition_id()).count().collect()]
    assert len(rows) == spark.sparkContext.defaultParallelism and max(rows) - min(rows) <= 1 and sum(rows) == 405


def test_sums_by_key():
    rng = np.random.default_rng(9)
    keys, rows = rng.integers(0, 40, 300) * 1600, rng.normal(size=(300, 5))
    got, n, sums = language_model.summed_rows(keys, rows)
    assert got.tolist() == sorted(set(keys.tolist())) and n.tolist() == [int((keys == k).sum()) for k in got]
    assert np.allclose(sums, [rows[keys == k].sum(axis=0) for k in got])


def test_gradient_and_training():
    counts, (cls, _, mass) = small_model()
    flat = language_model.first_weights(mass).astype(np.float64)
    rng = np.random.default_rng(5)
    text = np.append(np.tile(rng.integers(0, 60, 12), 60), language_model.END).astype("<u2")
    windows = np.concatenate([language_model.windows_of([text], [k]) for k in range(language_model.TRAIN_EVERY)])
    inputs, targets = language_model.training_arrays(windows, cls)
    _, g = language_model.gradient(language_model.views(flat), inputs[:4], targets[:4])
    for k in rng.integers(0, language_model.SIZE, 25):
        moved = [flat.copy(), flat.copy()]
        moved[0][k] += 1e-5
        moved[1][k] -= 1e-5
        a, b = (language_model.gradient(language_model.views(x), inputs[:4], targets[:4])[0] for x in moved)
        assert (a - b) / 2e-5 == pytest.approx(g[k], abs=1e-4)
    before, _ = language_model.gradient(language_model.views(flat), inputs, targets)
    for r in range(20):
        flat = language_model.train(flat, inputs, targets, 0)
    assert language_model.gradient(language_model.views(flat), inputs, targets)[0] < before / 3


def labelled_docs(spark, bad, good, column):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(300):
        y = int(i % 3 == 0)
        docs.append((i, " ".join(rng.choice(bad if y and rng.random() < 0.3 else good) for _ in range(rng.randint(20, 60))) + "."))
        labels.append((i, y, y))
    docs += [(900, None), (901, ""), (None, "nothing"), (5, docs[5][1])]
    labels += [(None, 1, 1), (902, None, None), (7, 0, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS y", "2 AS fold"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, y) for i, y, _ in labels)


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_quality(spark):
    docs, labels, truth = labelled_docs(spark, ["$$$", "%%%***", "AAA!!"], ["plain", "words", "of", "text"], "quality")
    stats = quality.features(docs)
    train = stats.where("doc_id % 5 != 0").join(quality.labels_of(labels, "quality"), F.col("doc_id") == F.col("label_id"))
    got = quality.score(stats, quality.fit(train)).collect()
    assert len(got) == 304 and all(0 <= r.score <= 1 for r in got)
    assert auc([(r.score, truth[r.doc_id]) for r in got if r.doc_id is not None and r.doc_id < 300 and r.doc_id % 5 == 0]) > 0.95
    assert {r.score for r in quality.score(stats, quality.fit(train.limit(0))).collect()} == {0.5}
    assert quality.score(stats.limit(0), quality.fit(train.limit(0))).count() == 0


def test_isotonic_means():
    assert quality.pooled(np.array([1, 1, 2, 1.0]), np.array([0, 1, 1, 1.0])).tolist() == [0, 2 / 3, 2 / 3, 1]


def test_toxicity(spark):
    docs, labels, truth = labelled_docs(spark, ["vile", "rotten", "foul"], ["plain", "words", "of", "text", "and", "more"], "toxic")
    model = toxicity.fit(docs, toxicity.labels_of(labels, "toxic").where("label_id % 5 != 0"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == 304 and all(0 <= r.expected_severity <= toxicity.GRADES for r in got)
    assert sorted(model.thresholds) == list(model.thresholds)
    held = [(r.expected_severity, truth[r.doc_id]) for r in got if r.doc_id is not None and r.doc_id < 300 and r.doc_id % 5 == 0]
    assert auc(held) > 0.95 and sum((s >= 0.9) == y for s, y in held) > 0.85 * len(held)
    assert {r.grade for r in toxicity.score(docs, toxicity.fit(docs, toxicity.labels_of(labels, "toxic").limit(0))).collect()} == {0}


def test_frequent_words_are_bounded(spark):
    counts = spark.createDataFrame([("a", 90), ("b", 40), ("c", 40), ("d", 2), ("e", 1)], "word string, c long")
    chosen = lambda most: sorted(r["word"] for r in language_model.frequent(counts, most).collect())
    assert chosen(5) == ["a", "b", "c", "d", "e"] and chosen(3) == ["a", "b", "c"]
    assert chosen(2) == ["a"] and chosen(0) == []  # equal counts come together or not at all
