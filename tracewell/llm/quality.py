"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Twenty statistics of a text (shares of kinds of characters, word lengths, repetition of words and lines) are
standardised and mapped to cosines of random projections, which approximate a Gaussian kernel. Each partition
of labelled rows sums its part of the normal equations, by fold; the sums, of a fixed size, give the ridge
weights. Scores of each fold under the weights of the other folds are counted in bins, and pooling adjacent
violators on these counts calibrates the score.

Defined cases: null texts count as empty, and empty texts are scored like others; rows with no, a null or
another label are not learnt from; a document with several labels has their mean, rounded up; without labels
every score is 0.5; repeated rows each get their row; null ids match no label; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_texts, saved, table, texts_of

FEATURES, SEED, RIDGE, BINS, FOLDS, THRESHOLD = 160, 7, 1e-3, 1000, 5, 0.3
#: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 sentence mark, 7 other mark, 8 beyond ASCII
KIND = np.zeros(256, np.int64)
for _c in range(256):
    KIND[_c] = 8 if _c > 127 else 1 if chr(_c).islower() else 2 if chr(_c).isupper() else 3 if chr(_c).isdigit() else 5 if _c == 10 else 4 if chr(_c).isspace() else 6 if chr(_c) in ".,;:?!'\"()-" else 7 if _c > 32 else 0
N_STATS = 20


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of statistics for each text."""
    out = np.zeros((len(texts), N_STATS))
    sizes = np.array([len(t) for t in texts])
    data, doc = np.frombuffer(b"".join(texts), np.uint8), np.repeat(np.arange(len(texts)), sizes)
    kinds = np.bincount(doc * 9 + KIND[data], minlength=9 * len(texts)).reshape(-1, 9)
    out[:, :9] = kinds / np.maximum(sizes, 1)[:, None]
    out[:, 9] = np.log1p(sizes)
    for i, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        n, distinct = len(words), set(words)
        lines = text.split(b"\n")
        pairs = set(zip(words, words[1:]))
        out[i, 10:] = (
            np.log1p(n),
            sum(map(len, words)) / n,
            len(distinct) / n,
            np.log1p(n) * len(distinct) / n,
            len(pairs) / max(1, n - 1),
            len(set(lines)) / len(lines),
            np.log1p(n / len(lines)),
            sum(map(len, distinct)) / len(distinct),
            sum(a == b for a, b in zip(words, words[1:])) / n,
            (text.count(b". ") + text.count(b".\n") + text.endswith(b".")) / n,
        )
    return out


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, stats`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in texts_of(batch):
                flat = pa.array(statistics(texts).ravel(), pa.float64())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * N_STATS, flat)], ["doc_id", "stats"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return map_texts(source, run, f"doc_id {dict(source.dtypes)['doc_id']}, stats array<double>")


class Fourier:
    """cos(Wx + b) of standardised statistics, with a constant."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, width: float = 0.22):
        rng = np.random.default_rng(SEED)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.w, self.b = rng.normal(0, width, (len(mean), FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.sd, -6, 6)
        return np.hstack([np.cos(x @ self.w + self.b), np.ones((len(x), 1))])


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index("stats"))
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def pooled(n: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Isotonic means for bins in order, by pooling adjacent violators."""
    stack: list[list[float]] = []
    for k, (c, p) in enumerate(zip(n, positive, strict=True)):
        stack.append([c, p, k])
        while len(stack) > 1 and stack[-2][1] * stack[-1][0] >= stack[-1][1] * stack[-2][0]:
            c2, p2, _ = stack.pop()
            stack[-1][0] += c2
            stack[-1][1] += p2
    out, at = np.zeros(len(n)), [int(s[2]) for s in stack] + [len(n)]
    for s, a, b in zip(stack, at, at[1:], strict=False):
        out[a:b] = s[1] / max(s[0], 1e-12)
    return out


class Model:
    def __init__(self, fourier: Fourier | None, weights=None, edges=None, values=None):
        self.fourier, self.weights, self.edges, self.values = fourier, weights, edges, values

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(self.fourier(stats) @ self.weights, self.edges, self.values), 0, 1)


def fit(labelled: DataFrame) -> Model:
    """From ``doc_id, stats, y``; only sums of a fixed size come to the driver."""
    cols = [c for k in range(N_STATS) for c in (F.avg(F.col("stats")[k]).alias(f"m{k}"), F.stddev_pop(F.col("stats")[k]).alias(f"s{k}"))]
    head = labelled.agg(F.count("*").alias("n"), *cols).first()
    if not head["n"]:
        return Model(None)
    fourier = Fourier(*(np.array([head[f"{c}{k}"] for k in range(N_STATS)]) for c in "ms"))
    size = FEATURES + 1
    data = labelled.select("stats", F.col("y").cast("double").alias("y"), crc_mod(F.col("doc_id"), FOLDS).cast("int").alias("fold"))

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z, y = fourier(_stats(batch)), batch.column(1).to_numpy()
            folds = batch.column(2).to_numpy()
            for f in np.unique(folds).tolist():
                own = folds == f
                sums[f] = sums.get(f, 0) + z[own].T @ np.column_stack([z[own], y[own]])
        keys = [(f, r) for f in sums for r in range(size)]
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in keys], pa.int32()), pa.array([r for _, r in keys], pa.int32()), pa.array([sums[f][r].tobytes() for f, r in keys], pa.binary())], ["fold", "row", "part"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x) for x in rows.column("part").to_pylist())
        return pa.table({"fold": rows.column("fold")[:1], "row": rows.column("row")[:1], "part": pa.array([total.tobytes()], pa.binary())})

    kind = "fold int, row int, part binary"
    sums = np.zeros((FOLDS, size, size + 1))
    for r in data.mapInArrow(equations, kind).groupBy("fold", "row").applyInArrow(add, kind).collect():  # FOLDS * size rows
        sums[r["fold"], r["row"]] = np.frombuffer(r["part"])
    total = sums.sum(axis=0)
    solve = lambda m: np.linalg.solve(m[:, :-1] + RIDGE * max(m[-1, -2], 1) * np.eye(size), m[:, -1])
    without = [solve(total - sums[f]) for f in range(FOLDS)]

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, folds = fourier(_stats(batch)), batch.column(2).to_numpy()
            raw = np.zeros(len(folds))
            for f in np.unique(folds).tolist():
                raw[folds == f] = z[folds == f] @ without[f]
            bins = np.clip(np.floor((raw + 1) / 3 * BINS), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], ["bin", "y"])

    counts = data.mapInArrow(held, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("p")).orderBy("bin").collect()  # BINS rows at most
    bins, n, p = (np.array([r[c] for r in counts], float) for c in ("bin", "n", "p"))
    prior = total[-1, -1] / total[-1, -2]
    values = pooled(n, p)
    values = (values * n + 2 * prior) / (n + 2) if len(n) < 3 else values
    # a slope too small to change an order makes ties of pooled bins follow the raw score
    return Model(fourier, solve(total), (bins + 0.5) / BINS * 3 - 1, 0.998 * values + 0.002 * (bins + 0.5) / BINS)


def score(docs_stats: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model(_stats(batch)), pa.float64())], ["doc_id", "score"])

    return docs_stats.select("doc_id", "stats").mapInArrow(run, f"doc_id {dict(docs_stats.dtypes)['doc_id']}, score double")


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """One label for each id: ``label_id, y``."""
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
    return known.groupBy(F.col("doc_id").alias("label_id")).agg((F.avg(column) >= 0.5).cast("int").alias("y"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = saved(features(table(spark, sf_dir, "documents")), "stats")
    held = crc_mod(F.col("doc_id"), FOLDS) == 0
    labels = labels_of(table(spark, sf_dir, "labels"), "quality")
    model = fit(stats.where(~held).join(labels, F.col("doc_id") == F.col("label_id")).select("doc_id", "stats", "y"))
    found = score(stats, model)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op8_quality": op8_quality}
ORACLE_SQL: dict[str, str] = {}
