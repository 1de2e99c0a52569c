"""Decontamination against brute force on a small fixture."""

import hashlib
import random
import re

from tracewell.llm import decontaminate

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(t):
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, n=10):
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[p : p + k]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for win, ids in windows.items():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    found |= ids
        out.append((str(i), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def make(seed):
    rng = random.Random(seed)
    vocab = [f"Wort{k}é" for k in range(30)] + ["7", "x_y", "İ", "a'b"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(say(rng.choice([1, 3, 9, 10, 11, 25])))) for k in range(12)] + [(50, None), (51, "?!"), (None, " ".join(say(12)))]
    docs = []
    for i in range(60):
        parts = say(rng.randint(0, 40))
        if rng.random() < 0.6:
            parts += (rng.choice(items)[1] or "").upper().split() + say(rng.randint(0, 3))
        docs.append((rng.choice([i, i - 1, None]), ", ".join(parts)))
    return docs + [(99, None), (100, ""), (101, docs[0][1]), (101, docs[0][1])], items


def test_against_brute_force(spark, monkeypatch):
    docs, items = make(1)
    long_only = [(i, t) for i, t in items if len(words(t)) >= 10]
    for bench, bound in ((items, 1_000_000), (long_only, 1_000_000), (items, 0)):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", bound)
        left = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS pos", "2 AS item_id", "3 AS length", "4 AS h", "5 AS w")
        right = spark.createDataFrame(bench, "item_id long, text string").selectExpr("*", "1 AS window", "2 AS items", "3 AS w")
        got = decontaminate.report(left, right).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == brute(docs, bench)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [(r.n_words, r.contaminated) for r in decontaminate.report(docs, none).collect()] == [(3, False)]
    assert decontaminate.report(docs.limit(0), none).count() == 0
    assert decontaminate.remove_documents(docs, none).collect() == docs.collect()
