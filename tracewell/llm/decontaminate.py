"""Benchmark decontamination by a broadcast hash set of normalised test n-grams, in DataFrame functions only.

Words are maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. A window is
``n`` consecutive words of a benchmark item; an item with fewer words, but not none, is one window. Each
position of a document is hashed over the next words and probed against the windows' hashes; every hit
is then verified word by word, so hash collisions cannot make a result.

Defined cases: a null or empty text has no words and is clean; null item texts have no windows; null ids
are kept as ids of their own (an item without an id counts as item ``""``); repeated rows each get their
row; empty tables give clean or no documents; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, table, without

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words, in lower case and in any case.
GAP, GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows are broadcast up to this many rows and bytes of words; beyond, the same join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def _window(length) -> Column:
    """The words from a position on; a short expression, so that the generated code stays small enough to be compiled."""
    return F.slice("w", F.col("pos") + 1, length)


def windows_of(benchmark: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: ``length``, ``window`` (words) and ``items`` (ids as strings, distinct)."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("length", F.least(F.size("w"), F.lit(n)))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)).alias("i")
    cut = items.select("item", "length", "w", starts).select("item", "length", F.slice("w", F.col("i"), F.col("length")).alias("window"))
    return cut.groupBy("length", "window").agg(F.collect_set("item").alias("items"))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Verified occurrences: ``doc_id``, ``text_hash``, ``pos`` (word index from 0), ``length``, ``items``."""
    windows = windows_of(benchmark, n)
    size = windows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.length(F.array_join("window", " ")) + F.length(F.array_join("items", " "))), F.lit(0)).alias("bytes"), F.collect_set("length").alias("lengths")).first()
    lengths = sorted(size["lengths"])  # n values at most
    windows = windows.select(F.xxhash64("window").alias("h"), "window", F.col("length").alias("win_length"), "items")
    small = size["rows"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES
    if small:
        windows = F.broadcast(windows)
    text = F.col(text_col)
    spots = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words_of(text).alias("w"))
    spots = spots.select("doc_id", "text_hash", "w", F.posexplode("w").alias("pos", "word")).drop("word")
    if len(lengths) == 1:
        spots = spots.withColumn("length", F.lit(lengths[0])).where(F.col("pos") + F.col("length") <= F.size("w")).withColumn("h", F.xxhash64(_window(lengths[0])))
    else:
        probes = [F.struct(F.lit(k).alias("length"), F.xxhash64(_window(k)).alias("h")) for k in lengths]
        probes = F.array(*probes) if probes else F.expr("cast(array() as array<struct<length:int,h:bigint>>)")
        spots = spots.select("*", F.inline(probes)).where(F.col("pos") + F.col("length") <= F.size("w"))
    seen = _window(F.col("length"))
    if not small:  # a position takes its own words along, not those of the whole document
        spots, seen = spots.select("doc_id", "text_hash", "pos", "length", "h", seen.alias("seen")), F.col("seen")
    same = (F.col("length") == F.col("win_length")) & (seen == F.col("window"))
    return spots.join(windows, "h").where(same).select("doc_id", "text_hash", "pos", "length", "items")


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of words and hit words, the items found, and ``contaminated``."""
    hits = find_hits(docs, benchmark, n, id_col, text_col).groupBy("doc_id", "text_hash")
    hits = hits.agg(F.array_sort(F.collect_set(F.struct("pos", "length"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["pos"] + s["length"] - F.greatest(a["end"], s["pos"]))).alias("n"), F.greatest(a["end"], s["pos"] + s["length"]).alias("end"))
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), F.aggregate("spans", zero, step, lambda a: a["n"]).alias("n_hit"), "items", "spans")
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP_ANY_CASE), "")).cast("long").alias("n_words"))
    out = base.join(hits, base["doc_id"].eqNullSafe(hits["hit_id"]) & (base["text_hash"] == hits["hit_hash"]), "left")
    items = F.coalesce(F.col("items"), F.expr("cast(array() as array<string>)"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), items.alias("items"), "spans")


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """``docs`` without the contaminated ones; columns as they were."""
    return without(docs, find_hits(docs, benchmark, n).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def contamination_sql(documents: str = "documents", benchmark: str = "benchmark") -> str:
    """DuckDB SQL for the report over the given tables; also the base of the pipeline's SQL."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM {documents}),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words} AS w FROM {benchmark}),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS l, array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') AS s
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM i WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM iw),
dw AS (SELECT rid, k, l, array_to_string(list_slice(w, k, k + l - 1), ' ') AS s
       FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d, ls WHERE len(w) >= l)),
h AS (SELECT rid, k, l, item FROM dw JOIN iw USING (l, s)),
p AS (SELECT rid, count(DISTINCT x) AS n FROM (SELECT rid, unnest(range(k, k + l)) AS x FROM (SELECT DISTINCT rid, k, l FROM h)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(p.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.s, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN t USING (rid)"""


QUERIES = {"op2_decontaminate": op2_decontaminate}
ORACLE_SQL = {"op2_decontaminate": contamination_sql()}
