"""PCA whitening by the singular values of the centred rows.

Each component c of a vector becomes the integer x = floor(scale * c) + offset. With n vectors and the sums S of each
dimension, both exact, the centred row is (n * x - S) / n: the integer in the numerator is exact, so nothing is lost to
a large offset. Spark MLlib's ``computeSVD`` takes the distributed centred rows; its singular values s belong to
the sums of squares, so the eigenvalues of the covariance with divisor n are s^2 / n, and a whitened coordinate is the
centred row times the right singular vector, by sqrt(n) / s. The total variance does not come from the
singular values but from the deviations, the exact sums of (n * x - S)^2, by n^3.

The whitened rows are written once; their own covariance is then measured, centred by their own means before
anything is multiplied, as partial sums of each batch, and its largest distance from the identity comes with the result.

The driver holds sums, singular vectors and values of the dimensions, and no rows. MLlib builds the sums of products of one
vector length in an executor, dims * (dims + 1) / 2 numbers, and solves them on the driver: meant for thousands of dimensions at most.

Defined cases: vectors that are null, empty or hold null or non-finite components have no rows and take no part; vectors of
different lengths are fitted apart, each length by itself; components whose variance is under ``RANK`` of
the largest one can't be told from none in doubles and have no rows, so vectors that are all equal have none; null ids and
repeated rows count, and get their rows, as any other; a component beyond 2^52 is an error; empty tables give no rows;
other columns are never read. The table that the result is read from stays in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, integral, saved, table

#: Least variance of a component, as a share of the largest: sums of products are exact to about 1e-15 of the largest one.
RANK = 1e-11
RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whole_vectors(rows: DataFrame, scale: float, offset: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, x, dims``: the rows that take part, with integer components."""
    c = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    fine = (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = lambda v: F.when(F.abs(v * F.lit(float(scale))) < F.lit(2.0**52), F.floor(v * F.lit(float(scale))) + F.lit(offset)).otherwise(F.raise_error(F.lit("a component is beyond 2^52")).cast("long"))
    return rows.where(fine).select(integral(rows, id_col).alias("vec_id"), F.transform(c, whole).alias("x"), F.size(c).alias("dims"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def summed(rows: DataFrame, column: str, dims: int, values, kind: str) -> list:
    """The sums over all rows of ``values(matrix)``, an array of any fixed size: partial sums of each batch, then one row for each of its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                out = values(_matrix(b.column(column), dims))
                out = pa.array(list(map(Decimal, out)), pa.decimal128(38, 0)) if kind != "double" else pa.array(np.asarray(out, np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), out], ["at", "value"])

    parts = rows.select(column).mapInArrow(run, f"at int, value {kind}").groupBy("at").agg(F.sum("value").cast(kind).alias("value"))
    return [r["value"] for r in sorted(parts.collect(), key=lambda r: r["at"])]


def exact_sums(x: np.ndarray) -> list[int]:
    if len(x) * float(np.abs(x).max()) < 2.0**62:
        return x.sum(axis=0).tolist()
    return [sum(map(int, column)) for column in x.T]


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in 64 bits where they hold it, else in Python's integers."""
    fits = n * (float(np.abs(x).max()) + max(abs(s) / n for s in sums)) < 2.0**62
    return x * n - np.array(sums, np.int64) if fits else x.astype(object) * n - np.array(sums, object)


def deviations(d: np.ndarray) -> list[int]:
    if d.dtype != object and d.shape[1] * float(np.abs(d).max()) ** 2 < 2.0**62:
        return (d * d).sum(axis=1).tolist()
    return [sum(int(a) ** 2 for a in row) for row in d]


def centred(rows: DataFrame, dims: int, n: int, sums: list[int]) -> DataFrame:
    """``vec_id, deviation, y``: the centred rows and their exact sums of squares, by n^2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                d = numerators(_matrix(b.column("x"), dims), n, sums)
                y = (d / n).astype(np.float64)
                ends = np.arange(0, (len(b) + 1) * dims, dims, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(list(map(Decimal, deviations(d))), pa.decimal128(38, 0)), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], ["vec_id", "deviation", "y"])

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation decimal(38,0), y array<double>")


def components(rows: DataFrame, dims: int, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors (columns) of the covariance of the centred rows: ``most`` at most."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("y").alias("y")), "y")
    svd = RowMatrix(vectors, n, dims).computeSVD(min(most, dims), computeU=False, rCond=RANK**0.5)
    return np.array(svd.s.toArray()) ** 2 / n, svd.V.toArray()


def projected(rows: DataFrame, axes: np.ndarray) -> DataFrame:
    """``vec_id, deviation, w``: whitened coordinates."""
    dims, k = axes.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = _matrix(b.column("y"), dims) @ axes
            ends = np.arange(0, (len(b) + 1) * k, k, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("deviation"), pa.ListArray.from_arrays(ends, pa.array(w.ravel()))], ["vec_id", "deviation", "w"])

    return rows.mapInArrow(run, "vec_id long, deviation decimal(38,0), w array<double>")


def identity_error(whitened: DataFrame, k: int, n: int) -> float:
    """Largest absolute entry of the covariance of ``w``, centred by its own means, minus the identity."""
    mean = np.array(summed(whitened, "w", k, lambda w: w.sum(axis=0), "double")) / n
    products = summed(whitened, "w", k, lambda w: ((w - mean).T @ (w - mean)).ravel(), "double")
    return float(np.abs(np.array(products).reshape(k, k) / n - np.eye(k)).max())


def whitened_rows(rows: DataFrame, most: int = 32, scale: float = 64, offset: int = 1_000_000, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component; ``deviation`` is a whole decimal."""
    spark = rows.sparkSession
    vectors = whole_vectors(rows, scale, offset, id_col, vec_col)
    out = []
    for dims, n in sorted(tuple(r) for r in vectors.groupBy("dims").count().collect()):  # one length, unless the table mixes models
        own = vectors.where(F.col("dims") == dims)
        sums = [int(s) for s in summed(own, "x", dims, exact_sums, "decimal(38,0)")]
        rows_ = saved(centred(own, dims, n, sums), "centred")
        total = int(rows_.agg(F.sum("deviation").cast("decimal(38,0)")).first()[0])
        if total:
            values, vectors_ = components(rows_, dims, n, most)
            done = saved(projected(rows_, vectors_ / np.sqrt(values)), "whitened")
            error = identity_error(done, len(values), n)
            explained = F.array(*[F.lit(float(e * n**3 / total)) for e in values])
            out.append(done.select("vec_id", F.posexplode("w").alias("at", "whitened"), "deviation").select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error")))
        discard(rows_)
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], RESULT)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviation is a long here; the operator's own has no such bound."""
    return whitened_rows(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {"op13_embedding_whitening": op13_embedding_whitening}
#: Eigenvectors have no SQL form; a dense solution in numpy is the test.
ORACLE_SQL: dict[str, str] = {}
