"""Exact k-means over integer vectors with Hamerly bounds.

Components become integers, floor(scale * x); the seeds are the vectors with the smallest hash of their id. In each
round every vector goes to the nearest centroid (squared distance, ties to the smaller number), then centroids become
floor(sum / count) of their vectors, by component.

A vector keeps two numbers from round to round: an upper bound of the distance to its own centroid and a lower bound of
the distance to every other one, the second-nearest's when it was last scanned. When centroids move, the upper bound
grows by the drift of the own centroid and the lower one falls by the largest drift of the others. A vector whose upper
bound is under its lower one, or under half the way from its centroid to the next, stays where it is, unread but for
that. For the others the own distance is measured, and if that does not settle it, all centroids are: in exact
integers. Bounds are floating-point numbers widened by more than they can be wrong by, and only strict order proves
anything, so ties are always scanned.

The state of a round (vector, cluster, bounds) is a table in the shared folder that cuts lineage; the one before is deleted.
Sums change only by vectors that moved, so a round adds and subtracts those, as partial sums of each batch. The driver
holds ``k`` centroids and nothing else.

Defined cases: only vectors with exactly ``dims`` components take part, none of them null or non-finite; rows with a
null id don't either; repeated rows count, and get a row, each; with fewer vectors than ``k`` each is a seed; a
centroid without vectors stays; a squared distance beyond 64 bits is an error; empty tables give no rows; other columns are
never read. The table that the result is read from stays in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, integral, saved, table

#: Below this, squared distances of 64 components and all terms of them are whole numbers that doubles hold exactly.
EXACT, WIDER = 1 << 22, 1e-9
STATE = "vec_id long, v array<long>, cluster int, before int, upper double, lower double, distance long, scanned boolean"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def whole_vectors(rows: DataFrame, dims: int, scale: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: the rows that take part, with integer components; components beyond 64 bits raise an error."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    fine = F.col(id_col).isNotNull() & (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = lambda c: F.when(F.abs(c * F.lit(float(scale))) < F.lit(2.0**62), F.floor(c * F.lit(float(scale)))).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("long"))
    return rows.where(fine).select(integral(rows, id_col).alias("vec_id"), F.transform(x, whole).alias("v"))


def squared(vectors: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances of ``vectors`` (rows) to ``centroids`` (columns)."""
    most = max([0, *(abs(x) for c in centroids for x in c)])
    out = np.zeros((len(vectors), len(centroids)), np.int64)
    small = (np.abs(vectors).max(axis=1, initial=0) < EXACT) & (most < EXACT)
    if small.any():
        v, c = vectors[small].astype(np.float64), np.array(centroids, np.float64)
        out[small] = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)
    for i in np.flatnonzero(~small):
        row = [sum((int(a) - b) ** 2 for a, b in zip(vectors[i], c, strict=True)) for c in centroids]
        if max(row) >= 1 << 63:
            raise ValueError("a squared distance exceeds 64 bits")
        out[i] = row
    return out


def own_squared(vectors: np.ndarray, cluster: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    out = np.zeros(len(vectors), np.int64)
    for j in np.unique(cluster):
        out[cluster == j] = squared(vectors[cluster == j], [centroids[j]])[:, 0]
    return out


class Step:
    """What a round needs to know: the centroids, how far each has moved, and half the way from each to the next one."""

    def __init__(self, centroids: list[list[int]], former: list[list[int]]):
        k = len(centroids)
        moved = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) ** 0.5 for x, y in zip(centroids, former, strict=True)]
        apart = [[sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) ** 0.5 for y in centroids] for x in centroids]
        self.centroids = centroids
        self.drift = np.array(moved) * (1 + WIDER)
        self.others = np.array([max([0.0, *(self.drift[j] for j in range(k) if j != a)]) for a in range(k)])
        self.half = np.array([min([np.inf, *(apart[a][j] for j in range(k) if j != a)]) / 2 for a in range(k)]) * (1 - WIDER)

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, last: bool) -> tuple[np.ndarray, ...]:
        """New cluster, upper and lower bound, exact own distance (0 where it isn't known, unless ``last``), and whether all centroids were scanned."""
        cluster, distance, scanned = cluster.copy(), np.zeros(len(v), np.int64), cluster < 0
        old = ~scanned
        upper, lower = np.where(old, upper, np.inf), np.where(old, lower, -np.inf)
        upper[old] += self.drift[cluster[old]]
        lower[old] -= self.others[cluster[old]]
        settled = np.zeros(len(v), bool)
        settled[old] = upper[old] * (1 + WIDER) < np.maximum(lower[old], self.half[cluster[old]])
        near = np.flatnonzero(old & (~settled | last))
        distance[near] = own_squared(v[near], cluster[near], self.centroids)
        upper[near] = np.sqrt(distance[near].astype(np.float64)) * (1 + WIDER)
        open_ = near[~settled[near]]
        scanned[open_] = ~(upper[open_] * (1 + WIDER) < np.maximum(lower[open_], self.half[cluster[open_]]))
        at = np.flatnonzero(scanned)
        d = squared(v[at], self.centroids)
        best = d.argmin(axis=1) if len(at) else np.zeros(0, np.int64)  # the first of equal ones
        cluster[at], distance[at] = best, d[np.arange(len(at)), best]
        upper[at] = np.sqrt(distance[at].astype(np.float64)) * (1 + WIDER)
        lower[at] = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64)) * (1 - WIDER) if d.shape[1] > 1 else np.inf
        return cluster, upper, lower, distance, scanned


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def assigned(state: DataFrame, step: Step, last: bool = False) -> DataFrame:
    """The state of the next round, from that of the last one."""
    dims = len(step.centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"), dims)
            before = b.column("cluster").to_numpy()
            new, upper, lower, distance, scanned = step.assign(v, before, b.column("upper").to_numpy(), b.column("lower").to_numpy(), last)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(new, pa.int32()), pa.array(before, pa.int32()), pa.array(upper), pa.array(lower), pa.array(distance), pa.array(scanned)], ["vec_id", "v", "cluster", "before", "upper", "lower", "distance", "scanned"])

    return state.mapInArrow(run, STATE)


def changes(state: DataFrame, dims: int) -> list:
    """``cluster, at, total``: what the moved vectors add to the sum of each component, and to the count (at ``dims``); k * (dims + 1) rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"), dims)
            if len(v) and np.abs(v).max() >= 1 << 48:
                v = v.astype(object)
            cols: tuple = ([], [], [])
            for sign, side in ((1, "cluster"), (-1, "before")):
                own = b.column(side).to_numpy()
                for j in np.unique(own[own >= 0]).tolist():
                    here = own == j
                    sums = [sign * int(x) for x in (*v[here].sum(axis=0), here.sum())]
                    for c, x in zip(cols, ([j] * (dims + 1), range(dims + 1), map(Decimal, sums)), strict=True):
                        c.extend(x)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.decimal128(38, 0))], ["cluster", "at", "total"])

    moved = state.where("cluster <> before").select("v", "cluster", "before")
    return moved.mapInArrow(run, "cluster int, at int, total decimal(38,0)").groupBy("cluster", "at").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()


def seeds(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest hash of ``salt:id``; equal ids by their components."""
    by = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["v"]) for r in vectors.orderBy(by, "v").limit(k).select("v").collect()]


def k_means(rows: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024, salt: str = "3", id_col: str = "vec_id", vec_col: str = "embedding", report: list | None = None) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that takes part. ``report`` gets, for each round, (vectors, scanned ones)."""
    spark = rows.sparkSession
    vectors = whole_vectors(rows, dims, scale, id_col, vec_col)
    centroids = seeds(vectors, k, salt)
    if not centroids:
        return spark.createDataFrame([], RESULT)
    k, former = len(centroids), centroids
    none = F.lit(-1)
    state, old = vectors.select("vec_id", "v", none.alias("cluster"), none.alias("before"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).cast("long").alias("distance"), F.lit(False).alias("scanned")), None
    sums = [[0] * (dims + 1) for _ in range(k)]
    for n in range(rounds + 1):
        state = saved(assigned(state, Step(centroids, former), last=n == rounds), "clusters")
        if old is not None:
            discard(old)
        old, former = state, centroids
        if report is not None:
            report.append(tuple(state.agg(F.count("*"), F.count_if("scanned")).first()))
        if n < rounds:
            for r in changes(state, dims):
                sums[r["cluster"]][r["at"]] += int(r["total"])
            centroids = [[x // s[dims] for x in s[:dims]] if s[dims] else c for s, c in zip(sums, centroids, strict=True)]
    found = {r["cluster"]: int(r["total"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    long = lambda x: F.lit(Decimal(x)).cast("long")
    return state.select("vec_id", "cluster", "distance", of([long(found.get(j, 0)) for j in range(k)]).alias("cluster_inertia"), long(sum(found.values())).alias("inertia"), of(digest).alias("centroid_sha256"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k_means(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Lloyd's rounds one after the other; all distances are whole numbers that doubles hold."""
    out = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS j, v AS c FROM v QUALIFY j < {k}),"""
    for n in range(rounds + 1):
        out += f"""
a{n} AS MATERIALIZED (SELECT i, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c), 'j': j}}) AS m FROM v, c{n} GROUP BY i),"""
        if n < rounds:
            out += f"""
s{n} AS MATERIALIZED (SELECT j, list(floor(s / n) ORDER BY p) AS c FROM (SELECT m.j AS j, p, sum(x) AS s, count(*) AS n FROM (SELECT m, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{n}) GROUP BY m.j, p) GROUP BY j),
c{n + 1} AS MATERIALIZED (SELECT o.j, coalesce(s{n}.c, o.c) AS c FROM c{n} o LEFT JOIN s{n} ON o.j = s{n}.j),"""
    return out + f"""
h AS (SELECT j, sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS h FROM c{rounds})
SELECT vec_id, CAST(m.j AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.j) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN h ON h.j = m.j"""


QUERIES = {"op11_centroid_clustering": op11_centroid_clustering}
ORACLE_SQL = {"op11_centroid_clustering": _sql()}
