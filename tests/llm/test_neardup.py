"""Near-duplicate groups against brute force."""

import random
import re

import pytest

from tracewell.llm import neardup


def brute(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {(i, len(sets[i]), label[i], i == label[i]) for i in sets}


def make(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(30):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 30, 60, 120]))]
        rows.append((10 * i, " ".join(base)))
        for k in range(rng.randint(0, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((10 * i + k + 1, "\n".join(copy).upper() if k % 2 else " ".join(copy)))
    return rows + [(1001, ""), (1002, None), (1003, " \t"), (1004, "one"), (1005, "ONE"), (1006, " x")]


def test_against_brute_force(spark):
    for size, percent, seed in ((3, 85, 1), (5, 80, 2)):
        rows = make(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS rep", "0 AS key", "'x' AS signature")
        got = neardup.near_duplicates(docs, size, percent)
        assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(rows, size, percent)


@pytest.mark.parametrize("loose", [24, 3, -1])
def test_chain_and_blocks(spark, monkeypatch, loose):
    """A chain of small edits is one component though its ends are far apart; keys and clusters with many documents go through several blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "KEY_BLOCK", 8)
    monkeypatch.setattr(neardup, "STAR", 3)
    monkeypatch.setattr(neardup, "LOOSE_DISTANCE", loose)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", loose)
    rng = random.Random(9)
    doc, rows = [f"v{rng.randrange(500)}" for _ in range(120)], []
    order = list(range(40))
    rng.shuffle(order)
    for i in order:
        doc = list(doc)
        doc[(7 * i) % 120] = f"new{i}"
        rows.append((i, " ".join(doc)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(rows, 3, 85)


def test_repeats_nulls_and_empty(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (9, "a b c d"), (None, "a b c d"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in neardup.near_duplicates(docs, 3, 85).collect())
    assert got == sorted([("5", "5", True), ("5", "5", True), ("9", "5", False), ("None", "None", True), ("3", "3", True)])
    assert neardup.near_duplicates(docs.limit(0), 3, 85).count() == 0
    assert neardup.keep_one(docs).columns == ["doc_id", "text"]
    left = neardup.keep_one(docs.selectExpr("*", "1 AS rep", "2 AS _hash"))
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == [("3", None), ("5", "a b c d"), ("None", "a b c d")]


def test_an_id_on_two_texts(spark):
    """Only the row whose text is a copy goes."""
    copy = "one two three four five six"
    docs = spark.createDataFrame([(2, copy), (5, "another text that stands quite alone here"), (5, copy)], "doc_id long, text string")
    assert sorted(tuple(r) for r in neardup.keep_one(docs).collect()) == [(2, copy), (5, "another text that stands quite alone here")]


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        neardup.near_duplicates(spark.createDataFrame([("x1", "a b c")], "doc_id string, text string"))


def test_a_large_cluster_of_unlinked_copies(spark):
    """Rows that meet in blocks hold no sets, and are as many as members times blocks."""
    n = 5000
    members = spark.range(n).selectExpr("id AS rep", "0L AS cluster", "300L AS n_shingles", "X'00' AS signature", "array(1L) AS shingles")
    dealt = neardup.dealt_to_blocks(members, spark.createDataFrame([], "a long, b long"))
    assert "shingles" not in dealt.columns
    assert dealt.count() == (n - 1) * (-(-(n - 1) // neardup.BLOCK) + 1) + -(-(n - 1) // neardup.BLOCK)


def test_very_long_text(spark):
    """A text of 3 million characters and its near copy."""
    rng = random.Random(4)
    words = [f"{rng.randrange(10**6)}" for _ in range(450_000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-9], "end"])), (3, " ".join(words[: len(words) // 2]))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(1, 1), (2, 1), (3, 3)]
