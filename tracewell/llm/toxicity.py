"""Toxicity by cumulative-link ordinal regression on sparse text features.

A feature is a word, or a stem (the first 4 to 7 letters of a word), and that it occurs once at least, or 3 or
6 times. The labels say only toxic or not, so severity grades are made from them: toxic training documents
have the grade 1, 2 or 3 by thirds of how many features they hold that toxic documents have far more often
than the others. The model is log P(grade >= k) / P(grade < k) = w.x - t_k: one
weight for each word, shared by all thresholds, and ordered thresholds. The result is the expected grade.

Labelled training rows are bounded by ``SAMPLE`` (those with the smallest hash of their id); counts of words
in them and the choice of ``FEATURES`` words are Spark aggregations. Every document is scored, whole.

Defined cases: null and empty texts have no words, and the score of a text without features; rows with no,
a null or another label are not learnt from; without toxic or without other labels all severities are 0;
repeated rows each get their row; null ids match no label; other columns are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_texts, saved, table, texts_of
from .quality import labels_of

SAMPLE, FEATURES, GRADES, STEPS, L2, CACHE = 20_000, 1024, 3, 300, 2e-4, 300_000
#: From which probability on a document counts as toxic: most clean documents hold no feature at all.
THRESHOLD = 0.2
#: Words are runs of ASCII letters and digits and of all bytes beyond ASCII; A-Z become lower case.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


def stems_of(word: bytes) -> list[bytes]:
    text = word.decode("utf-8", "replace")
    return [word + b"$", *(text[:n].encode() for n in range(4, 8) if len(text) >= n)]


def levels(stems: dict[bytes, int]) -> list[bytes]:
    """Features of a text with these counts of stems."""
    return [s + b"\0%d" % n for s, c in stems.items() for n in (1, 3, 6) if c >= n]


def features_of(text: bytes) -> list[bytes]:
    stems: Counter = Counter()
    for word, n in Counter(words_of(text)).items():
        for s in stems_of(word):
            stems[s] += n
    return sorted(levels(stems))


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"), *more)


def word_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, y, words``: the features of labelled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in texts_of(batch):
                words = [features_of(t) for t in texts]
                ends = np.append(0, np.cumsum([len(w) for w in words])).astype(np.int32)
                flat = pa.array([x for w in words for x in w], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "y", "words"])

    return map_texts(_texts(docs, "y"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, y int, words array<binary>")


class Model:
    def __init__(self, words: list[bytes], weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = dict(zip(words, weights.tolist(), strict=True)), thresholds
        self.stems = {w.rpartition(b"\0")[0] for w in words}
        self.known: dict[bytes, tuple[bytes, ...]] = {}  # stems of words that have some in the model; bounded

    def sum_of(self, text: bytes) -> float:
        known, stems = self.known, {}
        for word, n in Counter(words_of(text)).items():
            own = known.get(word)
            if own is None:
                if len(known) > CACHE:
                    known.clear()
                own = known[word] = tuple(s for s in stems_of(word) if s in self.stems)
            for s in own:
                stems[s] = stems.get(s, 0) + n
        return sum(self.weights.get(f, 0.0) for f in levels(stems))

    def severity(self, texts: list[bytes]) -> np.ndarray:
        """For each text the probabilities of a grade of 1, 2, ... at least; their sum is the expected grade."""
        x = np.array([self.sum_of(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(x[:, None] - self.thresholds, -40, 40)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by gradient ascent (Adam) on the likelihood of the grades; ``rows, cols``: which features each has."""
    k, n = GRADES, len(grades)
    share = np.array([np.clip((grades >= g).mean(), 1e-4, 1 - 1e-4) for g in range(1, k + 1)])
    first = -np.log(share / (1 - share))
    free = np.append(first[0], np.log(np.maximum(np.diff(first), 0.05)))  # thresholds: the first, then logs of the gaps
    p = np.concatenate([np.zeros(n_features), free])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, STEPS + 1):
        w, free = p[:n_features], p[n_features:]
        t = np.cumsum(np.append(free[0], np.exp(free[1:])))
        x = np.bincount(rows, w[cols], minlength=n)
        c = 1 / (1 + np.exp(-np.clip(x[:, None] - t, -40, 40)))
        full = np.column_stack([np.ones(n), c, np.zeros(n)])
        slope = np.column_stack([np.zeros(n), c * (1 - c), np.zeros(n)])
        i = np.arange(n)
        prob = np.maximum(full[i, grades] - full[i, grades + 1], 1e-12)
        dx = (slope[i, grades] - slope[i, grades + 1]) / prob
        dt = np.zeros(k)
        for g in range(1, k + 1):
            dt[g - 1] = (((grades + 1 == g) * 1.0 - (grades == g)) * slope[:, g] / prob).sum()
        dfree = np.append(dt.sum(), [np.exp(free[j]) * dt[j:].sum() for j in range(1, k)])
        grad = np.concatenate([np.bincount(cols, dx[rows], minlength=n_features), dfree]) / n
        grad[:n_features] -= L2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        p = p + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    free = p[n_features:]
    return p[:n_features], np.cumsum(np.append(free[0], np.exp(free[1:])))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From documents and ``label_id, y``; at most ``sample`` labelled rows are used."""
    chosen = labels.orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    chosen = saved(chosen, "sample")
    labelled = saved(word_rows(docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))), "words")
    total = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not total.get(0) or not total.get(1):
        return Model([], np.zeros(0), np.full(GRADES, 40.0))
    counts = labelled.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").alias("t"), F.count("*").alias("n"))
    odds = F.log((F.col("t") + 0.5) / (total[1] - F.col("t") + 0.5)) - F.log((F.col("n") - F.col("t") + 0.5) / (total[0] - F.col("n") + F.col("t") + 0.5))
    z = odds / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("n") - F.col("t") + 0.5))
    # log-likelihood ratio of the feature and the label, for features that toxic documents have more often
    both = total[0] + total[1]
    cell = lambda seen, wanted: F.when(seen > 0, seen * F.log(seen / wanted)).otherwise(0.0)
    t, n = F.col("t"), F.col("n")
    ratio = cell(t, n * total[1] / both) + cell(n - t, n * total[0] / both) + cell(total[1] - t, (both - n) * total[1] / both) + cell(total[0] - n + t, (both - n) * total[0] / both)
    some = counts.where("n >= 3").where(t * total[0] > (n - t) * total[1])
    best = some.select("word", odds.alias("odds"), z.alias("z"), ratio.alias("ratio")).orderBy(F.round("ratio", 6).desc(), "word").limit(FEATURES).collect()
    index = {bytes(r["word"]): k for k, r in enumerate(best)}
    strong = np.array([r["odds"] > 1.5 and r["z"] > 3 for r in best], bool)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(index[w] for w in words if w in index) for words in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32()))], ["y", "cols"])

    data = labelled.select("y", "words").mapInArrow(keep, "y int, cols array<int>").collect()  # ``sample`` short rows at most
    data.sort(key=lambda r: (r["y"], r["cols"]))
    hits = np.array([int(strong[r["cols"]].sum()) for r in data])
    toxic = np.array([r["y"] for r in data])
    thirds = np.quantile(hits[toxic == 1], [k / GRADES for k in range(1, GRADES)])
    grades = toxic * (1 + (hits[:, None] > thirds).sum(axis=1))
    rows = np.repeat(np.arange(len(data)), [len(r["cols"]) for r in data])
    cols = np.array([c for r in data for c in r["cols"]], np.int64)
    return Model(list(index), *fit_ordinal(rows, cols, grades, len(index)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, expected_severity, p_toxic, grade`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in texts_of(batch):
                p = model.severity(texts)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array((p >= 0.5).sum(axis=1).astype(np.int32))], ["doc_id", "expected_severity", "p_toxic", "grade"])

    source = _texts(docs)
    return map_texts(source, run, f"doc_id {dict(source.dtypes)['doc_id']}, expected_severity double, p_toxic double, grade int")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod(F.col("doc_id"), 5) == 0
    labels = labels_of(table(spark, sf_dir, "labels"), "toxic").where(crc_mod(F.col("label_id"), 5) != 0)
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held.alias("held_out"), "expected_severity", "p_toxic", "grade", (F.col("p_toxic") >= THRESHOLD).alias("toxic"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE_SQL: dict[str, str] = {}
