"""Personal data: fixed patterns as stated, the label model on planted reliabilities, added spans on planted texts."""

import hashlib
import re
import sys
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import personal

sys.set_int_max_str_digits(0)
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub(r"[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if passes(kind, m[0])]
    n = Counter(k for _, k, _ in found)
    return n[0], n[1], n[2], n[3], hashlib.sha256(",".join(x for *_, x in sorted(found)).encode()).hexdigest()


TEXTS = [None, "", "a@b.c@d.e x@@y.z @a.b a.@b.c.d.", "é𝄞 jo.e+x@mail-1.example.com, 1.2.3.4.5.6.7.8 256.1.1.1 0001.0.0.255", "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111", "+1 (415) 555-2671 +12 34 + 1 +1.2.3.4.5.6.7.8.9.0 +1-", "1" * 5000 + " +" + "1" * 5000 + " 1.1." + "0" * 5000 + ".1", "none here"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1234567890@.+- ()_é", max_size=60))
def test_fixed_patterns(text):
    base = personal.base_spans(text)
    assert [f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in base] == [x for *_, x in sorted((m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if passes(kind, m[0]))]
    personal.wide_spans(text, base)


@pytest.fixture(scope="module")
def classifier():
    """What the priors alone give."""
    model = personal.LabelModel({})
    every = [v for v in personal.product((1, 0, -1), repeat=7)]
    rows = [personal.vote_features(k, v) for k in range(6) for v in every]
    return personal.SpanClassifier(rows, [model.probability(k, v) for k in range(6) for v in every], [1.0] * len(rows))


def test_every_row_and_edges(spark, classifier):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, TEXTS[3]), (3, TEXTS[3])], "doc_id long, text string").selectExpr("*", "1 AS n_email", "2 AS spans", "3 AS kind")
    got = sorted((str(r.doc_id), (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)) for r in personal.scan(docs).collect())
    assert got == sorted([(str(i), brute(t)) for i, t in enumerate(TEXTS)] + [("None", brute(TEXTS[3])), ("3", brute(TEXTS[3]))])
    assert personal.scan(docs.limit(0)).count() == 0


def test_votes_are_counted_over_all_documents(spark):
    rows = [(i, f"write to user{i}@example.com or 4111111111111111 and {4111111111111112 + 10 * i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = Counter()
    for _, text in rows:
        base = personal.base_spans(text)
        counts.update((k, personal.votes_of(text, s, k, e, strict)) for spans, strict in ((base, True), (personal.wide_spans(text, base), False)) for s, k, e in spans)
    model, classifier = personal.fit(docs, sample=100)
    assert np.allclose(model.says, personal.LabelModel(counts).says) and np.allclose(model.share, personal.LabelModel(counts).share)
    good, bad = (classifier(personal.features_of(t, 5, personal.CARD, 21, personal.votes_of(t, 5, personal.CARD, 21, strict))) for t, strict in (("x of 4242424242424242 y", True), ("x of 4242424242424241 y", False)))
    assert good > 0.9 and bad < 0.1


def test_expectation_maximisation_finds_planted_reliabilities():
    """Votes drawn from known reliabilities: estimated shares within 0.04 of them, and spans told apart as well as with the true ones."""
    rng = np.random.default_rng(8)
    true = rng.random(20_000) < 0.7
    says = np.array([[[0.1, 0.3, 0.6], [0.8, 0.15, 0.05]]] * 4 + [[[0.3, 0.4, 0.3], [0.4, 0.4, 0.2]]] * 3)
    votes = np.array([[rng.choice([1, 0, -1], p=says[l, int(y)]) for l in range(7)] for y in true])  # noqa: E741
    model = personal.LabelModel(Counter((2, tuple(map(int, v))) for v in votes))
    assert abs(model.share[2] - 0.7) < 0.03 and np.abs(model.says[2] - says).max() < 0.04
    said = 1 - votes
    guessed, odds = model.true(2, said) > 0.5, np.log(0.7 / 0.3) + sum(np.log(says[l, 1][said[:, l]] / says[l, 0][said[:, l]]) for l in range(7))  # noqa: E741
    assert (guessed == true).mean() > max(0.95, ((odds > 0) == true).mean() - 0.003)
    assert (model.share[[0, 1, 3, 4, 5]] == 0.5).all()


PLANTED = {
    "call me at (415) 555-2671 today": "(415) 555-2671", "mail bob [at] example [dot] com now": "bob [at] example [dot] com", "my name is Maria Schmidt and": "Maria Schmidt",
    "her SSN is 123-45-6789, he said": "123-45-6789", "to IBAN DE89 3704 0044 0532 0130 00 soon": "DE89 3704 0044 0532 0130 00", "card 4111.1111.1111.1111 was used": "4111.1111.1111.1111",
    "the host 2001:db8::ff00:42:8329 is up": "2001:db8::ff00:42:8329", "Dear Mrs. Ursula Meier, thanks": "Ursula Meier",
}
INNOCENT = ["Apache License and James License", "at 12:30:45 we met", "order 4111111111111112 is late", "under the Public License for all", "about 100 200 300 400 of them", "on 12.03.2021 1999 people", "in version 1.2.3 of C++::std", "At At At At At", "DE00 1234 5678 9012 3456 78 is none", "id_123-45-6789x", "look at the dot com boom"]


def test_planted_and_innocent_texts(classifier):
    for text, value in PLANTED.items():
        assert [text[s:e] for s, _, e in personal.added_spans(text, personal.base_spans(text), classifier)] == [value], text
    for text in INNOCENT:
        assert personal.added_spans(text, personal.base_spans(text), classifier) == [], text


def test_redaction(spark, classifier):
    docs = spark.createDataFrame([(1, "ask a.b@c.de or +1 (415) 555-2671", 5), (2, None, 0), (3, "plain", 5)], "doc_id long, text string, n long")
    assert [tuple(r) for r in personal.redact(docs, classifier).orderBy("doc_id").collect()] == [(1, "ask [EMAIL] or [PHONE]", 5), (2, None, 0), (3, "plain", 5)]


def test_very_long_texts(classifier):
    began = time.process_time()
    for text in ("a" * 500_000, "1" * 500_000, "a@" * 200_000, "1.1.1.1 " * 50_000, "+1 " * 100_000, "Anna Anna " * 50_000, "x@y.zz " * 50_000, ":" * 200_000, "12 345 6789 " * 40_000):
        personal.added_spans(text, personal.base_spans(text), classifier)
    assert time.process_time() - began < 60
