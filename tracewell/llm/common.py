"""Helpers that the operators share: the shared folder, row keys, tables that cut lineage."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share, from ``spark.checkpoint.dir``; one of our own where that is unset and there is one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return found or "/tmp/checkpoints"


def held(df: DataFrame) -> DataFrame:
    """Keep ``df`` on the executors' disks, until ``unpersist``; lineage stays, so what a lost executor held is computed anew."""
    return df.persist(StorageLevel.DISK_ONLY)


def integral(docs: DataFrame, column: str) -> Column:
    """The id column as a long; other types would lose ids silently."""
    if not isinstance(docs.schema[column].dataType, T.IntegralType | T.NullType):
        raise TypeError(f"{column} must be of an integer type, not {docs.schema[column].dataType.simpleString()}")
    return F.col(column).cast("long")


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``saved`` made and nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.saved_path)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_KEPT: dict = {}


def kept(name, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps across its tasks, for one operator at a time: the next one's caches replace it, and what it held goes back to the system."""
    if name not in _KEPT:
        _KEPT.clear()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
        _KEPT[name] = make()
    return _KEPT[name]


def slices(sizes, limit: int, rows: int = 10_000):
    """Bounds of runs of ``rows`` rows at most whose sizes add up to about ``limit``; a larger row is a run of its own."""
    start = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > limit or k - start == rows:
            yield start, k
            start, total = k, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


#: Rows of an Arrow batch of texts, where the session doesn't set them: Spark's own 10,000 rows of long texts take hundreds of MB on both sides.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_texts(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` over rows with texts, in batches of ``BATCH_ROWS``. The setting holds for the session from here on; one that is not Spark's default stays as it is."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING) == "10000":
        conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def texts_of(batch, column: str = "text", limit: int = 2 << 20, rows: int = 10_000):
    """From an Arrow batch with a binary column: (rows, list of bytes) for runs of about ``limit`` bytes and of ``rows`` rows at most; null: empty."""
    import pyarrow.compute as pc

    col = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    for a, b in slices(sizes, limit, rows):
        yield batch.slice(a, b - a), [x or b"" for x in col.slice(a, b - a).to_pylist()]


#: Keys are broadcast up to this many rows; beyond, the same join shuffles.
BROADCAST_KEYS = 1_000_000


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``doc_id`` and text hash are in ``gone`` (``gone_id, gone_hash``)."""
    gone = saved(gone.distinct(), "gone")
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_hash"]), "left_anti")
