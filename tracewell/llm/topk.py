"""Exact top-k by inner product with an impact-ordered, score-at-a-time index.

Components become integers, floor(scale * x). Blocks of vectors are indexed: each component is a term, its
postings are cut into segments of equal quantised impact, and a segment keeps ids only. A query takes the
segments of all terms by descending upper impact (weight times the segment's best value) and adds that impact
to the ids' accumulators, so an accumulator plus the best impacts still to come is an upper bound. From time to
time the leaders are scored exactly; their k-th score is a floor. The query stops when the segments that could
add are used up, or when only a few ids can still reach the floor, which proves the rest out; those that can
are scored exactly. Queries meet vectors block by block, and the blocks' tops are merged.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows
with a null id; only vectors of the same length are compared; ties go to the smaller id; all rows with the
query's id are its own and no candidates; a repeated query row is one query, one id with several vectors is as many
queries, each with its own ranks, repeated candidates each count; vectors with components so large that sums of their products could
exceed 64 bits are left out of the index and scored one by one in Python's integers, and only a score that is beyond 64 bits itself is an error; ids
must be integers; empty tables give no rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import integral, partitions, saved, table

#: Vectors of a block at most, and at least if there are fewer blocks than partitions; queries of a block. Each pair of blocks makes one index.
VECTORS, LEAST_VECTORS, QUERY_BLOCK, LEVELS, FEW = 32_768, 4096, 32_768, 16, 8


class ImpactIndex:
    """Postings of a block of integer vectors, by term and quantised value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.postings, self.heads, self.high, self.low = [], [], [], []
        for column in self.vectors.T:
            step = max(1, -(-int(np.abs(column).max(initial=0)) // (levels // 2)))
            by = np.argsort(column, kind="stable")
            level = column[by] // step
            heads = np.flatnonzero(np.append(True, level[1:] != level[:-1]))
            ends = np.append(heads[1:], len(by))
            self.postings.append(by)
            self.heads.append((heads, ends))
            self.low.append(column[by][heads])
            self.high.append(column[by][ends - 1])

    def top(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the block's k best, the query's own rows left out."""
        impact, segment = [], []
        for t, q in enumerate(query.tolist()):
            best = q * (self.high[t] if q > 0 else self.low[t])
            impact.append(best)
            segment += [(t, s) for s in range(len(best))]
        impact = np.concatenate(impact)
        order = np.argsort(-impact, kind="stable")
        order = order[: np.searchsorted(-impact[order], 0)]  # what can only lower a score stays unread
        acc = np.zeros(len(self.ids), np.int64)
        acc[self.ids == query_id] = np.iinfo(np.int64).min // 2
        left: dict[int, list[int]] = {}  # impacts of each term still to come, the best last
        for o in order[::-1].tolist():
            left.setdefault(segment[o][0], []).append(int(impact[o]))
        to_come = sum(x[-1] for x in left.values())
        check = max(1, len(order) // 6)
        possible = None
        for n, o in enumerate(order.tolist(), 1):
            t, s = segment[o]
            heads, ends = self.heads[t]
            acc[self.postings[t][heads[s] : ends[s]]] += impact[o]
            own = left[t]
            to_come -= own.pop()
            to_come += own[-1] if own else 0
            if n % check == 0 and n >= len(order) // 2:
                possible = self.possible(acc, query, k, to_come)
                if len(possible) <= FEW * k:
                    break
                possible = None
        if possible is None:
            possible = self.possible(acc, query, k, 0)
        scores = self.vectors[possible] @ query
        best = np.lexsort((self.ids[possible], -scores))[:k]
        return self.ids[possible][best], scores[best]

    def possible(self, acc: np.ndarray, query: np.ndarray, k: int, to_come: int) -> np.ndarray:
        """Those whose upper bound reaches the k-th exact score among the leaders."""
        live = acc > np.iinfo(np.int64).min // 4
        if live.sum() <= k:
            return np.flatnonzero(live)
        leaders = np.argpartition(-acc, k - 1)[:k]
        floor = (self.vectors[leaders] @ query).min()
        return np.flatnonzero(live & (acc + to_come >= floor))


def integer_vectors(rows: DataFrame, scale: float, id_col: str, vec_col: str) -> DataFrame:
    x = F.col(vec_col)
    scaled = lambda v: F.lit(float(scale)) * v.cast("double")
    whole = F.transform(x, lambda v: F.when(F.abs(scaled(v)) < F.lit(2.0**62), F.floor(scaled(v))).otherwise(F.raise_error(F.lit("components are too large: one is beyond 64 bits")).cast("long")))
    fine = F.col(id_col).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return rows.where(fine).select(integral(rows, id_col).alias("vec_id"), whole.alias("v"), F.size(x).alias("dims"))


def _arrays(rows: pa.Table, ids: str) -> tuple[np.ndarray, np.ndarray]:
    v = rows.column("v").combine_chunks()
    v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
    return rows.column(ids).to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in Python's integers, for components of any size."""
    scores = [sum(int(a) * int(b) for a, b in zip(v, query, strict=True)) for v in vectors]
    if any(abs(x) >= 1 << 63 for x in scores):
        raise ValueError("components are too large: a score exceeds 64 bits")
    return np.array(scores, np.int64)


class Block:
    """A block of vectors: an index of those whose sums of products stay within 64 bits, and the few others beside it."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.most = ids, vectors, int((2**61 // vectors.shape[1]) ** 0.5)
        self.wide = np.abs(vectors).max(axis=1) > self.most
        self.index = ImpactIndex(ids[~self.wide], vectors[~self.wide]) if not self.wide.all() else None

    def top(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        apart = self.wide if np.abs(query).max() <= self.most else np.ones(len(self.ids), bool)
        apart = apart & (self.ids != query_id)
        parts = [(self.ids[apart], exact_scores(self.vectors[apart], query))]
        if self.index is not None and np.abs(query).max() <= self.most:
            parts.append(self.index.top(query, query_id, k))
        ids, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best]


def exact_top_k(rows: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k highest scores of each query against all rows but its own."""
    vectors = saved(integer_vectors(rows, scale, id_col, vec_col), "vectors")
    asked = saved(integer_vectors(queries, scale, id_col, vec_col).dropDuplicates().withColumnRenamed("vec_id", "query_id"), "queries")
    rows_, m = vectors.count(), max(1, -(-asked.count() // QUERY_BLOCK))
    n = max(1, -(-rows_ // VECTORS), min(-(-rows_ // min(LEAST_VECTORS, VECTORS)), partitions(rows.sparkSession)))
    # each block of vectors meets each block of queries once
    left = vectors.withColumn("vb", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    right = asked.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))

    def search(block: pa.Table, batch: pa.Table) -> pa.Table:
        from xxhash import xxh3_64_intdigest

        out = []
        if len(block) and len(batch):
            own = Block(*_arrays(block, "vec_id"))
            for query_id, query in zip(*_arrays(batch, "query_id"), strict=True):
                out.append((query_id, *own.top(query, query_id, k), xxh3_64_intdigest(query.tobytes()) >> 1))
        sizes = [len(x[1]) for x in out]
        flat = lambda c, kind: np.concatenate([np.zeros(0, kind), *[x[c] for x in out]])
        return pa.table({"query_id": np.repeat(np.array([x[0] for x in out], np.int64), sizes), "query": np.repeat(np.array([x[3] for x in out], np.int64), sizes), "vec_id": flat(1, np.int64), "score": flat(2, np.int64)})

    found = left.groupBy("dims", "vb", "qb").cogroup(right.groupBy("dims", "vb", "qb")).applyInArrow(search, "query_id long, query long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return exact_top_k(rows, rows.where("vec_id % 100 = 0"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
QUERIES = {"op3_exact_topk": op3_exact_topk}
ORACLE_SQL = {"op3_exact_topk": SQL}
