"""The corpus pipeline: language ID, near-dedup, decontamination, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the result of each is
written as Parquet to the shared folder and read again as the next one's documents.

1. ``language``: documents without letters go, and those far from the profiles of all languages; short clean texts can be
   far from them too and stay. Where no language can be learnt, all with letters stay.
2. ``near_dedup``: of each group of near-duplicates (five-word shingles, similarity 0.8 or more) the
   document with the smallest id stays.
3. ``decontaminate``: documents that hold a ten-word window of a benchmark item go.
4. ``secrets``: secrets in the text are replaced by a mark; all documents stay.
5. ``pack``: the texts' tokens are packed into sequences of at most 2048.

Null texts have no letters and go in the first stage; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontaminate, language, neardup, packing, secret_scan
from tracewell.llm.common import shared_dir, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs, size=5, percent=80)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language_stage), ("near_dedup", near_dedup_stage), ("decontaminate", decontaminate_stage), ("secrets", secrets_stage), ("pack", pack_stage)]
#: Language profiles, the compressor and the tokenizer have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, top = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
    return docs
