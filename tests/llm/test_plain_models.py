"""Language profiles, the language model's scores, quality and toxicity against plain loops, with their ties, null ids and long texts."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import language, language_model, quality, toxicity


def plain_vector(text, size, letters):
    own = [c if c.isalpha() else None for c in text.lower()]
    total = np.zeros(size)
    for k, c in enumerate(own):
        if c:
            before, after = own[k - 1] if k else None, own[k + 1] if k + 1 < len(own) else None
            a, b, c = (letters(x) for x in (before, c, after))
            total += np.array([a[(d - 2) % size] * b[(d - 1) % size] * c[d] for d in range(size)])
    return total


def test_language_profiles(spark):
    size, rng, known = 48, random.Random(2), {}

    def letters(c):
        if c not in known:
            known[c] = np.random.default_rng([ord(c) if c else 0, size]).choice(np.array([-1, 1]), size).astype(float)
        return known[c]

    say = lambda s, n: " ".join("".join(rng.choice(s) for _ in range(3)) + rng.choice(["", ".", " 7"]) for _ in range(n))
    sounds = {"xx": ["tho", "wan", "ish"], "yy": ["eau", "Été", "ç"], "zz": ["日本", "語", "の"]}
    rows = [(k, say(sounds[lang], 4 + k % 5), lang) for k, lang in enumerate(["xx", "yy", "zz"] * 4)]
    rows += [(90, None, "xx"), (91, "", None), (92, "1!", "yy"), (93, "a", None), (94, "\U000f0000\U000e0041", None), (None, rows[0][1], "xx"), (0, rows[0][1], "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sums = {}
    for _, text, lang in rows:
        if lang and text:
            sums[lang] = sums.get(lang, 0) + plain_vector(text, size, letters)
    profiles = {k: v / np.sqrt((v * v).sum()) for k, v in sorted(sums.items())}
    got_profiles = language.prototypes(docs, size)
    assert list(got_profiles) == list(profiles) and all(np.allclose(got_profiles[k], v, atol=1e-5) for k, v in profiles.items())
    centre, want = sum(profiles.values()) / len(profiles), []
    for i, text, _ in rows:
        v = plain_vector(text or "", size, letters)
        if not v.any():
            want.append((str(i), "und", 0.0))
            continue
        v = v / np.sqrt((v * v).sum())
        near = {k: (v - centre) @ (p - centre) / np.sqrt(((p - centre) ** 2).sum()) for k, p in profiles.items()}
        best = max(near, key=near.get)
        want.append((str(i), best, round(max(0.0, float(v @ profiles[best])), 4)))
    got = [(str(r.doc_id), r.lang_pred, round(r.score, 4)) for r in language.identify(docs, profiles, size).collect()]
    assert sorted(x[:2] for x in got) == sorted(x[:2] for x in want)
    assert [x[2] for x in sorted(got)] == pytest.approx([x[2] for x in sorted(want)], abs=2e-4)


def plain_log10(text, flat, counts, nodes, last):
    """Attention of one place after the other, then the path to the id in the tree of its class."""
    m, p = language_model, {k: v.astype(float) for k, v in language_model.views(flat).items()}
    cls = m.classes_of(counts)[0]
    order = sorted(range(m.IDS), key=lambda i: (cls[i], -counts[i], i))
    where = {i: k for k, i in enumerate(order)}
    sums = np.append(0, np.cumsum(counts[order] + 0.1))
    sizes = np.bincount(cls, minlength=m.CLASSES)
    x, total = [m.CLASSES, *(cls[i] for i in text)], 0.0
    for t, i in enumerate(text):
        query, parts = p["emb"][x[t]] @ p["q"], []
        for j in range(max(0, (t // m.STRIDE - 1) * m.STRIDE), t + 1):
            s = query @ (p["emb"][x[j]] @ p["k"]) / math.sqrt(m.WIDTH)
            parts.append((math.exp(s + p["rel"][t - j]), p["emb"][x[j]] @ p["v"]))
        h = sum(w * v for w, v in parts) / sum(w for w, _ in parts)
        out = p["emb"][x[t]] + h @ p["o"] + last[text[t - 1] if t else m.IDS]
        logits = out @ p["u"] + p["b"]
        total += logits[cls[i]] - math.log(sum(math.exp(z) for z in logits))
        low = int(sizes[: cls[i]].sum())
        high = low + int(sizes[cls[i]])
        while high - low > 1:
            middle = next(k for k in range(low, high + 1) if sums[k] >= (sums[low] + sums[high]) / 2)
            middle = min(max(middle, low + 1), high - 1)
            z = nodes[middle] @ out + math.log((sums[high] - sums[middle]) / (sums[middle] - sums[low]))
            right = where[i] >= middle
            total -= math.log1p(math.exp(-z if right else z))
            low, high = (middle, high) if right else (low, middle)
    return total / math.log(10)


def test_language_model_scores():
    m, rng = language_model, np.random.default_rng(8)
    counts = np.zeros(m.IDS)
    counts[:300] = rng.integers(0, 900, 300)
    flat = m.first_weights(m.classes_of(counts)[2])
    m.views(flat)["rel"][:] = rng.normal(0, 0.5, 2 * m.STRIDE)
    nodes, last = (rng.normal(0, 0.3, (n, m.WIDTH)).astype(np.float32) for n in (m.IDS, m.IDS + 1))
    texts = [np.append(rng.integers(0, 300, n), m.END) for n in (0, 1, 15, 16, 33, 70)] + [np.array([40_000, 3, 3, m.END])]
    want = [plain_log10(x.tolist(), flat, counts, nodes, last) for x in texts]
    assert m.Scorer(flat, counts, [nodes, last])(texts) == pytest.approx(want, rel=2e-4)


def isotonic(n, positive):
    """The value at k is the largest of the least means of runs that hold k."""
    mean = lambda i, j: sum(positive[i : j + 1]) / sum(n[i : j + 1])
    return [max(min(mean(i, j) for j in range(k, len(n))) for i in range(k + 1)) for k in range(len(n))]


def test_quality_fit(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(["plain", "words", "$$$", "AAA!!"] if i % 3 else ["plain", "words", "of", "text"]) for _ in range(rng.randint(1, 30))) + rng.choice(["", ".", "\n"])) for i in range(120)]
    texts += [(200, "long words " * 20_000), (201, ""), (202, None), (3, texts[3][1])]
    labels = {i: int(rng.random() < (0.15 if i % 3 else 0.9)) for i, _ in texts}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    stats = quality.features(docs)
    got_stats = {r.doc_id: np.array(r.stats) for r in stats.collect()}
    model = quality.fit(stats.join(spark.createDataFrame(list(labels.items()), "label_id long, y int"), F.col("doc_id") == F.col("label_id")))
    x = np.array([got_stats[i] for i, _ in texts])
    y = np.array([labels[i] for i, _ in texts], float)
    fold = np.array([zlib.crc32(str(i).encode()) % quality.FOLDS for i, _ in texts])
    mean, sd = x.mean(axis=0), x.std(axis=0)
    gen = np.random.default_rng(quality.SEED)
    w, b = gen.normal(0, 0.22, (x.shape[1], quality.FEATURES)), gen.uniform(0, 2 * np.pi, quality.FEATURES)
    z = np.array([[*(math.cos(a) for a in np.clip((r - mean) / np.where(sd > 1e-9, sd, 1), -6, 6) @ w + b), 1.0] for r in x])

    def dense(own):  # ridge as least squares with rows for the penalty
        penalty = math.sqrt(quality.RIDGE * own.sum()) * np.eye(z.shape[1])
        return np.linalg.lstsq(np.vstack([z[own], penalty]), np.append(y[own], np.zeros(z.shape[1])), rcond=None)[0]

    raw = np.array([z[k] @ dense(fold != fold[k]) for k in range(len(x))])
    bins = np.clip(np.floor((raw + 1) / 3 * quality.BINS), 0, quality.BINS - 1).astype(int)
    used = sorted(set(bins.tolist()))
    n, p = ([float(v[bins == k].sum()) for k in used] for v in (np.ones(len(y)), y))
    values = [0.998 * v + 0.002 * (k + 0.5) / quality.BINS for k, v in zip(used, isotonic(n, p), strict=True)]
    want = np.clip(np.interp(z @ dense(fold >= 0), [(k + 0.5) / quality.BINS * 3 - 1 for k in used], values), 0, 1)
    got = sorted((r.doc_id, r.score) for r in quality.score(stats, model).collect())
    assert [i for i, _ in got] == sorted(i for i, _ in texts)
    assert [s for _, s in got] == pytest.approx([s for _, s in sorted(zip([i for i, _ in texts], want.tolist(), strict=True))], abs=1e-5)


def plain_features(text):
    stems = {}
    for word in re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or "")):
        for s in [word + "$", *(word[:k] for k in range(4, 8) if len(word) >= k)]:
            stems[s] = stems.get(s, 0) + 1
    return {f"{s}\0{k}".encode() for s, c in stems.items() for k in (1, 3, 6) if c >= k}


def likelihood(x, grades, free, weights):
    t = np.cumsum(np.append(free[0], np.exp(free[1:])))
    over = np.column_stack([np.ones(len(grades)), 1 / (1 + np.exp(-((x @ weights)[:, None] - t))), np.zeros(len(grades))])
    i = np.arange(len(grades))
    return np.log(over[i, grades] - over[i, grades + 1]).mean() - toxicity.L2 / 2 * (weights**2).sum()


def test_toxicity_fit(spark):
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice(["ab", "cd", "ef", "bad" if i % 3 == 0 else "ef", "vile" if i % 6 == 0 else "cd"]) for _ in range(rng.randint(2, 12)))) for i in range(90)]
    truth = {i: int(i % 3 == 0 and "bad" in t) for i, t in texts}
    long = "ab cd " * 30_000 + "bad bad vile"
    extra = [(500, None), (501, ""), (502, long), (None, "bad"), (3, texts[3][1])]
    docs = spark.createDataFrame(texts + extra, "doc_id long, text string")
    model = toxicity.fit(docs.where("doc_id < 90").dropDuplicates(), spark.createDataFrame(list(truth.items()), "label_id long, y int"))
    own = [plain_features(t) for _, t in texts]
    y = np.array([truth[i] for i, _ in texts])
    toxic, clean = int(y.sum()), int((1 - y).sum())
    ranked = []
    for f in set().union(*own):
        n = sum(f in o for o in own)
        t = sum(f in o and c for o, c in zip(own, y, strict=True))
        if n >= 3 and t * clean > (n - t) * toxic:
            table = [(t, n * toxic), (n - t, n * clean), (toxic - t, (90 - n) * toxic), (clean - n + t, (90 - n) * clean)]
            odds = math.log((t + 0.5) / (toxic - t + 0.5)) - math.log((n - t + 0.5) / (clean - n + t + 0.5))
            z = odds / math.sqrt(1 / (t + 0.5) + 1 / (n - t + 0.5))
            ranked.append((-round(sum(a * math.log(a * 90 / b) for a, b in table if a), 6), f, odds > 1.5 and z > 3))
    ranked.sort()
    assert list(model.weights) == [f for _, f, _ in ranked]  # equal ratios by the feature itself
    x = np.array([[f in o for _, f, _ in ranked] for o in own], float)
    hits = x @ np.array([s for _, _, s in ranked], float)
    cuts = np.quantile(hits[y == 1], [k / toxicity.GRADES for k in range(1, toxicity.GRADES)])
    grades = y * (1 + (hits[:, None] > cuts).sum(axis=1))
    weights, t = np.array(list(model.weights.values())), model.thresholds
    free = np.append(t[0], np.log(np.diff(t)))
    here = likelihood(x, grades, free, weights)
    # the weights are near the best: no small step in any direction gains more than a trifle, and random ones lose
    for k in range(len(weights) + len(free)):
        for step in (-0.05, 0.05):
            p = np.concatenate([weights, free])
            p[k] += step
            assert likelihood(x, grades, p[len(weights) :], p[: len(weights)]) < here + 5e-3
    assert here > likelihood(x, grades, free, 0 * weights)
    want = []
    for i, text in texts + extra:
        total = sum(model.weights.get(f, 0) for f in plain_features(text))
        p = [1 / (1 + math.exp(-(total - c))) for c in t]
        want.append((str(i), round(sum(p), 6), sum(v >= 0.5 for v in p)))
    assert sorted((str(r.doc_id), round(r.expected_severity, 6), r.grade) for r in toxicity.score(docs, model).collect()) == sorted(want)
    assert toxicity.score(docs.limit(0), model).count() == 0
