"""Packing: ids against the tokenizer itself, valid places, dominance against exhaustive search."""

import itertools
import random
import zlib

import numpy as np
import pytest

from tracewell.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path(packing.VOCABULARY))


TEXTS = ["", None, "Hello, World's end!  É́x ß İstanbul ΑΣ \x85 a b", "<|endoftext|> x<|startoftext|>y <|endo", "a " * 50, "12345 $$$*** don't we'll", "　 \x1c\x1d", "word " * 700 + "tail", "naïve\tcafé\r\n\x0bq\x0cz", "a", "(word) idiot### $$x$$ 'sword it's ΟΔΟΣ é́ cafe\u0301 <a> |b| x_y -9- ª² ÀÉ.", "ﬁ ǅ ʰ ٣ a\u0338= =\u0338"]


def test_chunks_equal_whole_texts(tokenizer):
    texts = [(t or "").encode() for t in TEXTS]
    ids, counts = packing.ChunkTokenizer(packing.tokenizer_path(packing.VOCABULARY)).encode(texts)
    want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert counts.tolist() == [len(x) for x in want]
    assert ids.tolist() == [x for ids in want for x in ids]


def test_shrinking_caches_change_no_ids(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 6)
    monkeypatch.setattr(packing, "STAY", 3)
    tokens = packing.ChunkTokenizer(packing.tokenizer_path(packing.VOCABULARY))
    for t in TEXTS * 2:
        ids, _ = tokens.encode([(t or "").encode()])
        assert ids.tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


def test_pack_places_every_piece(spark, tokenizer):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(7, "again"), (7, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS salt", "3 AS piece")
    out = [r.asDict() for r in packing.pack(docs, capacity=64).collect()]
    want = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(str(i), k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())) for k in range(0, len(ids), 64)]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == sorted(want)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def optimum(items, capacity):
    items = sorted(items, reverse=True)
    best = len(items)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= items[k]:
                rest = list(rooms)
                rest.remove(r)
                go(k + 1, [*rest, r - items[k]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best


def test_reduction_keeps_an_optimum():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([10, 17, 30])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        count = np.bincount(items, minlength=capacity + 1)
        fixed = packing.reduce_by_dominance(count, capacity)
        left = [x for x in range(capacity + 1) for _ in range(count[x])]
        used = [x for found, times in fixed for x in found * times]
        assert sorted(left + used) == sorted(items)
        assert all(sum(found) <= capacity for found, _ in fixed)
        assert sum(times for _, times in fixed) + optimum(left, capacity) == optimum(items, capacity)


def test_classes_equal_piece_by_piece():
    rng = random.Random(5)
    for _ in range(100):
        capacity = rng.choice([20, 50])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 60))), reverse=True)
        rooms = []
        for x in items:
            fits = [r for r in rooms if r >= x]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else capacity) - x)
        groups = packing.best_fit(np.bincount(items, minlength=capacity + 1), capacity)
        got = [capacity - sum(s * c for s, c in fill) for fill, times in groups for _ in itertools.repeat(0, times)]
        assert sorted(got) == sorted(rooms)
