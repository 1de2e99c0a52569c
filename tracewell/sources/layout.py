"""Lines from positioned text: items of a page's text layer, and words that a recogniser has recorded.

Parsing a PDF or recognising an image needs an engine; what it gives, places and texts, is the input here. Everything is
native. A page's baselines meet in one row, and a line's words in another; nothing else is gathered. Null texts count as
empty; items without a place are no text; empty tables give no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import S
from .items import MIN_READABLE, readable_size

# How far a baseline may lie below the first of its row, which gap is a blank, points in a unit of length, the size of text without one.
SAME_ROW, WORD_GAP, POINTS_PER_UNIT, USUAL_SIZE = 0.25, 0.1, 16, 12


def _within(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def trimmed(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^{S}+|{S}+$", "")


def row_starts(baselines: Column) -> Column:
    """The baselines that start a row, from sorted distinct ones: each that lies more than ``SAME_ROW`` below the last start."""
    return F.aggregate(baselines, F.array().cast("array<double>"), lambda a, y: F.when((F.size(a) == 0) | (y - F.element_at(a, F.greatest(F.size(a), F.lit(1))) > SAME_ROW), F.concat(a, F.array(y))).otherwise(a))


def in_rows(placed: DataFrame) -> DataFrame:
    """Items (``item_id, page, x, y, ...``) with ``row``, from 1 down the page; an item belongs to the last row that starts at or above it."""
    starts = placed.groupBy("item_id", "page").agg(row_starts(F.array_sort(F.collect_set("y"))).alias("_starts"))
    return placed.join(starts, ["item_id", "page"]).withColumn("row", F.size(F.filter("_starts", lambda s: s <= F.col("y")))).drop("_starts")


def row_text(words: Column) -> Column:
    """The texts of a row from left to right, with a blank where a gap is wider than ``WORD_GAP`` and none is there yet. ``words``: sorted ``x, y, ordinal, end_x, text``."""
    zero = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("end"))

    def step(a, w):
        blank = F.when((w["x"] - a["end"] > WORD_GAP) & ~a["text"].endswith(" "), " ").otherwise("")
        return F.struct(F.concat(a["text"], blank, w["text"]).alias("text"), w["end_x"].alias("end"))

    return F.aggregate(words, zero, step, lambda a: trimmed(a["text"]))


def text_rows(texts: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (``item_id, page, line_number, text, x, y, w, h``) and failures (``item_id, failure, pages_without_text``).

    ``texts``: ``item_id, page, ordinal, x, y, end_x, size, text``; ``pages``: ``item_id, page, width, height`` in the same units.
    Items on one baseline are a row; boxes are shares of the page, from 0 to 1. If any page of an item has fewer than
    ``MIN_READABLE`` characters that are no white space, the whole item fails and has no lines.
    """
    text = F.coalesce("text", F.lit(""))
    counts = texts.groupBy("item_id", "page").agg(F.sum(readable_size(F.col("text"))).alias("n"))
    gate = pages.select("item_id", "page").distinct().join(counts, ["item_id", "page"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    gate = gate.groupBy("item_id").agg(F.array_sort(F.collect_set(F.when(F.col("n") < MIN_READABLE, F.col("page")))).alias("pages_without_text"))
    failures = gate.where(F.size("pages_without_text") > 0).select("item_id", F.lit("PDF_NO_TEXT_LAYER").alias("failure"), "pages_without_text")
    placed = texts.where("x is not null and y is not null").join(gate.where(F.size("pages_without_text") == 0).select("item_id"), "item_id", "left_semi")
    placed = placed.select("item_id", "page", "ordinal", F.col("x").cast("double"), F.col("y").cast("double"), F.coalesce("end_x", "x").cast("double").alias("end_x"), F.coalesce("size", F.lit(USUAL_SIZE)).cast("double").alias("size"), text.alias("text"))
    words = F.array_sort(F.collect_list(F.struct("x", "y", "ordinal", "end_x", "text")))
    rows = in_rows(placed).groupBy("item_id", "page", "row").agg(row_text(words).alias("text"), F.min("x").alias("x0"), F.max("end_x").alias("x1"), F.min("y").alias("y0"), F.max("size").alias("size")).where("text <> ''")
    boxed = rows.join(pages.dropDuplicates(["item_id", "page"]), ["item_id", "page"])
    number = F.row_number().over(Window.partitionBy("item_id", "page").orderBy("row"))
    width, height = F.col("width").cast("double"), F.col("height").cast("double")
    box = [_within(F.col("x0") / width).alias("x"), _within(F.col("y0") / height).alias("y"), _within((F.col("x1") - F.col("x0")) / width).alias("w"), _within(F.col("size") / POINTS_PER_UNIT / height).alias("h")]
    return boxed.select("item_id", "page", number.alias("line_number"), "text", *box), failures


def recorded_lines(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines (``item_id, line_number, text, confidence, x, y, w, h``) and failures (``item_id, failure``) of recorded words.

    ``words``: ``item_id, block, line, word, text, confidence`` (0 to 100), ``x0, y0, x1, y1, width, height`` (of the image).
    A line is as sure as its least sure word; lines go by block, then top, then left. Items with fewer than
    ``MIN_READABLE`` characters that are no white space fail.
    """
    said = words.withColumn("text", F.coalesce("text", F.lit("")))
    own = F.array_sort(F.collect_list(F.struct("word", "text")))
    text = F.regexp_replace(F.array_join(F.transform(own, lambda w: w["text"]), " "), f"{S}+$", "")
    lines = said.groupBy("item_id", "block", "line").agg(text.alias("text"), F.min("confidence").alias("least"), *[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"), (F.max, "width"), (F.max, "height"))])
    lines = lines.where(trimmed(F.col("text")) != "")
    enough = lines.groupBy("item_id").agg(F.sum(readable_size(F.col("text"))).alias("n")).where(F.col("n") >= MIN_READABLE).select("item_id")
    failures = words.select("item_id").distinct().join(enough, "item_id", "left_anti").withColumn("failure", F.lit("NO_READABLE_TEXT"))
    share = lambda part, whole: F.col(part).cast("double") / F.col(whole)
    box = [share("x0", "width").alias("x"), share("y0", "height").alias("y"), ((F.col("x1") - F.col("x0")).cast("double") / F.col("width")).alias("w"), ((F.col("y1") - F.col("y0")).cast("double") / F.col("height")).alias("h")]
    placed = lines.join(enough, "item_id", "left_semi").select("item_id", "block", "line", "text", F.round(_within(F.coalesce("least", F.lit(0)).cast("double") / 100), 3).alias("confidence"), *box)
    number = F.row_number().over(Window.partitionBy("item_id").orderBy("block", "y", "x", "line"))
    return placed.select("item_id", number.alias("line_number"), "text", "confidence", "x", "y", "w", "h"), failures
