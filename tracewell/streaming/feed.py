"""The audit trail as a feed: what each micro-batch of new files adds to the counts, written once however often it is tried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

AUDIT = "action string, outcome string, at timestamp"


def new_entries(spark: SparkSession, path: str, schema: str = AUDIT) -> DataFrame:
    """Entries of the files that are new under ``path``; the trail is only ever appended to."""
    return spark.readStream.schema(schema).parquet(path)


def counted(entries: DataFrame) -> DataFrame:
    return entries.groupBy("action", "outcome", F.to_date("at").alias("day")).agg(F.count("*").alias("n"), F.max("at").alias("last_at"))


def follow(entries: DataFrame, sink: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write what each micro-batch adds under ``sink/batch=N``. A batch that is tried again replaces its own folder, so a restart neither loses nor repeats."""

    def write(batch: DataFrame, batch_id: int) -> None:
        counted(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def totals(spark: SparkSession, sink: str) -> DataFrame:
    """``action, outcome, day, n, last_at`` over all batches so far."""
    return spark.read.parquet(sink).groupBy("action", "outcome", "day").agg(F.sum("n").alias("n"), F.max("last_at").alias("last_at"))
