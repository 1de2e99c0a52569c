"""The whole analysis of documents, lines to edges, with results that are kept under a hash of their input and used again.

A document's step is done when the store has its rows under the same hash (of the step, its version and the text); only documents
without that are read again. What covers the whole table, entities and edges, is kept under the hash of all documents' hashes.
A run that finds everything there reads stored rows and writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import facts, lines

#: Raise a step's version when its rules change: its rows are then made anew.
VERSIONS = {"PARSE": 1, "EXTRACT": 1, "NORMALIZE": 1, "CORRELATE": 1}


class Store:
    """Parquet tables by step under one shared folder. A table is written under the hash it is known by, and only whole ones count."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.written: list[str] = []
        self.reused: list[str] = []

    def has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def folders(self, step: str) -> list[str]:
        jvm = self.spark._jvm
        top = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{step}")
        files = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [x.getPath().getName() for x in files.listStatus(top)] if files.exists(top) else []
        return sorted(f"{step}/{x}" for x in found if self.has(f"{step}/{x}"))

    def whole(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of that name: as it is there, or made and written."""
        if self.has(name):
            self.reused.append(name)
        else:
            make().write.mode("overwrite").parquet(f"{self.path}/{name}")
            self.written.append(name)
        return self.spark.read.parquet(f"{self.path}/{name}")

    def rows(self, step: str) -> DataFrame | None:
        """All rows of a step so far; None before the first."""
        names = self.folders(step)
        return self.spark.read.parquet(*[f"{self.path}/{x}" for x in names]) if names else None


def input_hash(step: str, *parts) -> F.Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(f"{step}:{VERSIONS[step]}"), *parts).cast("binary"), 256)


def table_hash(rows: DataFrame, column: str) -> str:
    """One hash for a set of hashes, whatever their order: their number, sums of their parts, in one small row."""
    part = lambda n: F.sum(F.conv(F.substring(column, 15 * n + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    found = rows.agg(F.count("*").cast("string").alias("n"), *[F.coalesce(part(n), F.lit("0")).alias(f"p{n}") for n in range(4)])
    return found.select(F.sha2(F.concat_ws(":", *found.columns).cast("binary"), 256).alias("h")).first().h


def by_document(store: Store, step: str, inputs: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A step of documents (``doc_id, input_hash, ...``): rows of ``make`` for those that the store lacks, kept rows for the others.

    Which documents were done is kept beside the rows, as many have none.
    """
    asked = inputs.select("doc_id", "input_hash").distinct()
    done = store.rows(f"{step}-done")
    missing = asked if done is None else asked.join(done, ["doc_id", "input_hash"], "left_anti")
    if not missing.isEmpty():
        name = table_hash(missing.withColumn("h", F.sha2(F.concat_ws(":", "doc_id", "input_hash").cast("binary"), 256)), "h")
        fresh = inputs.join(missing, ["doc_id", "input_hash"], "left_semi")
        store.whole(f"{step}/{name}", lambda: make(fresh).join(missing, "doc_id"))
        store.whole(f"{step}-done/{name}", lambda: missing)  # last: rows without it are made again
    else:
        store.reused.append(step)
    kept = store.rows(step)
    return kept.join(asked, ["doc_id", "input_hash"], "left_semi").drop("input_hash")


def analyze(docs: DataFrame, path: str, text_col: str = "text") -> tuple[dict[str, DataFrame], Store]:
    """``lines, facts, entities, edges`` of ``docs`` (``doc_id`` and a text), and the store that tells what was written and what was used again.

    Null texts count as empty; a document that is repeated counts once. The store's folder must be one that all machines share.
    """
    store = Store(docs.sparkSession, path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = docs.select("doc_id", text.alias("text")).distinct()
    parse = some.withColumn("input_hash", input_hash("PARSE", "text"))
    found_lines = by_document(store, "PARSE", parse, lambda d: lines.redact(lines.split_lines(d)).select("doc_id", "line_number", "text"))
    # lines follow from the text, so the text's hash and the step's stand for the lines
    extract = parse.select("doc_id", input_hash("EXTRACT", "input_hash").alias("input_hash"))
    found_facts = by_document(store, "EXTRACT", extract, lambda d: facts.extract(found_lines.join(d.select("doc_id"), "doc_id", "left_semi")))
    name = table_hash(extract.withColumn("h", F.sha2(F.concat_ws(":", "doc_id", "input_hash").cast("binary"), 256)), "h")
    entities = store.whole(f"NORMALIZE/{VERSIONS['NORMALIZE']}-{name}", lambda: facts.entities(found_facts))
    edges = store.whole(f"CORRELATE/{VERSIONS['CORRELATE']}-{name}", lambda: facts.hosted_on(found_facts).select(F.col("url").alias("from_value"), F.lit("HOSTED_ON").alias("relation"), F.col("host").alias("to_value"), "n_docs").unionByName(
        facts.single_pair_edges(found_facts, "AMOUNT", "TRANSACTION", "AMOUNT_OF").select("from_value", "relation", "to_value", "n_docs")))
    return {"lines": found_lines, "facts": found_facts, "entities": entities, "edges": edges}, store
