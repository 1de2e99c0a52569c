"""Repeated bytes against brute force, and the sort against Python's."""

import hashlib
import random

import numpy as np

from tracewell.llm import suffix_dedup


def brute(rows, width):
    first = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for p in range(len(b) - width + 1):
                w = b[p : p + width]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        if i is not None:
            for p in range(len(b) - width + 1):
                if first[b[p : p + width]] < i:
                    gone[p : p + width] = [True] * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((str(i), len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def make(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abé ") for _ in range(rng.choice([30, 49, 50, 51, 80, 300]))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            parts.append(rng.choice(passages) if rng.random() < 0.6 else "".join(rng.choice("abcdefghij k") for _ in range(rng.randint(1, 120))))
        rows.append((rng.choice([i, i, i - 3, None]), "".join(parts)))
    return rows + [(100, ""), (101, None), (102, "x" * 400), (103, "x" * 60), (104, "x" * 49), (105, rows[0][1]), (105, rows[0][1]), (7, "ab" * 100), (9, "ba" * 100)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 5000)
    for seed, width in ((1, 50), (2, 50), (3, 30)):
        rows = make(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS bucket", "'x' AS bits")
        got = suffix_dedup.repeated_bytes(docs, width).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, width)


def test_blocks_that_meet_by_slots(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 700)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(suffix_dedup, "SLOT", 4)
    rng = random.Random(9)
    hot = "".join(rng.choice("pqrst ") for _ in range(130))
    rows = make(5) + [(200 - k, hot[k % 7 :] + "".join(rng.choice("uvw") for _ in range(20)) if k % 3 else hot) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS slot")
    got = suffix_dedup.repeated_bytes(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows, 50)


def test_a_bucket_hears_once_from_a_slot():
    hot, width = b"h" * 80, 50
    runs = suffix_dedup._table(suffix_dedup.RUNS, range(500), [1] * 500, [np.array([31], np.uint32).tobytes()] * 500, [np.array([900 - k]).tobytes() for k in range(500)], [hot] * 500)
    merged = suffix_dedup.merge_runs(runs.append_column("slot", [[7] * 500]), width)
    assert merged.to_pylist() == [{"block": 7, "bucket": 1, "sizes": np.array([31], np.uint32).tobytes(), "docs": np.array([401]).tobytes(), "bytes": hot}]
    names = suffix_dedup._table(suffix_dedup.NAMES, range(500), [1] * 500, [np.array([8, 20 + 2 * k], np.uint64).tobytes() for k in range(500)])
    assert np.frombuffer(suffix_dedup.merge_names(names.append_column("slot", [[7] * 500])).to_pylist()[0]["names"], np.uint64).tolist() == [9, *range(20, 1020, 2)]


def test_a_text_longer_than_a_block(spark):
    text = random.Random(1).randbytes(suffix_dedup.BLOCK_BYTES * 11 // 20).hex()
    assert len(text) > suffix_dedup.BLOCK_BYTES
    docs = spark.createDataFrame([(1, text), (2, "<" + text[1_000_000:1_000_200] + ">"), (3, "plain " + text[5:54])], "doc_id long, text string")
    assert {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.repeated_bytes(docs).collect()} == {1: (0, 0), 2: (200, 1), 3: (0, 0)}


def test_empty_table(spark):
    assert suffix_dedup.repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_deep_shallow_sorts():
    rng = random.Random(4)
    text = ("".join(rng.choice("ab") for _ in range(300)) + "abcabcabc" * 30 + "".join(rng.choice("ab") for _ in range(200))) * 2
    data = np.frombuffer(text.encode() + bytes(80), np.uint8)
    offsets = np.arange(len(text) - 50)
    order, group = suffix_dedup.deep_shallow(data, offsets, 50)
    strings = [text[o : o + 50] for o in offsets[order]]
    assert strings == sorted(strings)
    assert [a == b for a, b in zip(strings, strings[1:])] == (group[1:] == group[:-1]).tolist()
