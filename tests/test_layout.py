"""Rows of positioned items and of recorded words against small models."""

import random

from pyspark.sql import functions as F

from tracewell.operators import facts
from tracewell.sources import layout

ITEM = "item_id int, page int, ordinal int, x double, y double, end_x double, size double, text string"
PAGE = "item_id int, page int, width double, height double"


def first_fit(items):
    """Rows of (text, x, y, end_x, size): each item goes to the first row whose first item's baseline is within a quarter."""
    rows = []
    for item in sorted(items, key=lambda i: (i[4], i[3], i[2])):
        fits = [r for r in rows if abs(r[0][4] - item[4]) <= 0.25]
        fits[0].append(item) if fits else rows.append([item])
    out = []
    for row in rows:
        text, end = "", None
        for i in sorted(row, key=lambda i: (i[3], i[4], i[2])):
            text += " " if end is not None and i[3] - end > 0.1 and not text.endswith(" ") else ""
            text, end = text + (i[7] or ""), i[5]
        if text.strip():
            out.append((text.strip(), min(i[3] for i in row), min(i[4] for i in row), max(i[5] for i in row), max(i[6] or 12 for i in row)))
    return out


def test_rows_of_items(spark):
    rng = random.Random(3)
    items = []
    for item in range(12):
        for page in (1, 2):
            for k in range(60):
                x, text = rng.choice([0.0, 3.0, 5.5, 9.0]) + rng.random(), rng.choice(["alpha", "b ", " c", "", "𝄞é", "delta", None])
                items.append((item, page, k, x, round(rng.random() * 3, 2), x + rng.random() * 3, rng.choice([9.0, 14.0, None]), text))
    items += [(50, 1, 0, 1.0, 1.0, 2.0, 9.0, "enough text here"), (50, 2, 0, 1.0, 1.0, 2.0, 9.0, " too few "), (51, 1, 0, None, None, None, None, "no place at all"), (52, 1, 0, -3.0, 1.0, 90.0, 900.0, "out of the page")]
    pages = [(i, p, 20.0, 30.0) for i in range(12) for p in (1, 2)] + [(50, p, 20.0, 30.0) for p in (1, 2, 3)] + [(51, 1, 20.0, 30.0), (52, 1, 20.0, 30.0), (53, 1, 1.0, 1.0)]
    lines, failures = layout.text_rows(spark.createDataFrame(items, ITEM).withColumn("row", F.lit(1)), spark.createDataFrame(pages, PAGE))
    got = {}
    for r in lines.orderBy("item_id", "page", "line_number").collect():
        got.setdefault((r.item_id, r.page), []).append((r.line_number, r.text, r.x, r.y, r.w, r.h))
    clamp = lambda v: min(1, max(0, v))
    for item in range(12):
        for page in (1, 2):
            want = first_fit([i for i in items if i[:2] == (item, page)])
            assert got[item, page] == [(n, t, clamp(x / 20), clamp(y / 30), clamp((e - x) / 20), clamp(s / 16 / 30)) for n, (t, x, y, e, s) in enumerate(want, 1)]
    assert sorted(tuple(r) for r in failures.collect()) == [(50, "PDF_NO_TEXT_LAYER", [2, 3]), (53, "PDF_NO_TEXT_LAYER", [1])]
    assert got[52, 1] == [(1, "out of the page", 0.0, 1 / 30, 1.0, 1.0)] and (51, 1) not in got and (50, 1) not in got
    assert all(x.count() == 0 for x in layout.text_rows(spark.createDataFrame([], ITEM), spark.createDataFrame([], PAGE)))


def test_a_row_starts_anew_a_quarter_below_its_first(spark):
    """0.2, 0.4 and 0.6 lie 0.2 apart: the third is too far below the first, whatever lies between."""
    items = [(1, 1, k, float(k), y, k + 0.5, 12.0, f"word{k}") for k, y in enumerate((0.2, 0.4, 0.6, 0.45, 0.7))]
    lines, _ = layout.text_rows(spark.createDataFrame(items, ITEM), spark.createDataFrame([(1, 1, 10.0, 10.0)], PAGE))
    assert [r.text for r in lines.orderBy("line_number").collect()] == ["word0 word1 word3", "word2 word4"]


WORD = "item_id int, block int, line int, word int, text string, confidence double, x0 int, y0 int, x1 int, y1 int, width int, height int"


def test_lines_of_recorded_words(spark):
    words = [
        (1, 0, 0, 0, "second", 91.26, 10, 50, 40, 60, 100, 200), (1, 0, 0, 1, "line ", 88.0, 42, 50, 60, 62, 100, 200),
        (1, 0, 1, 0, "first", 99.0, 10, 20, 40, 30, 100, 200), (1, 1, 0, 0, "later block", 140.0, 0, 0, 40, 10, 100, 200),
        (1, 1, 1, 0, " ", 3.0, 0, 11, 40, 20, 100, 200), (1, 1, 2, 0, None, 3.0, 0, 11, 40, 20, 100, 200),
        (2, 0, 0, 0, "too few", 50.0, 0, 0, 1, 1, 10, 10), (3, 0, 0, 0, "confidence unknown", None, 0, 0, 1, 1, 10, 10),
    ]
    lines, failures = layout.recorded_lines(spark.createDataFrame(words, WORD))
    got = [tuple(r) for r in lines.orderBy("item_id", "line_number").collect()]
    assert got == [(1, 1, "first", 0.99, 0.1, 0.1, 0.3, 0.05), (1, 2, "second line", 0.88, 0.1, 0.25, 0.5, 0.06), (1, 3, "later block", 1.0, 0.0, 0.0, 0.4, 0.05), (3, 1, "confidence unknown", 0.0, 0.0, 0.0, 0.1, 0.1)]
    assert [tuple(r) for r in failures.collect()] == [(2, "NO_READABLE_TEXT")]
    ocr = lines.where("item_id = 1").agg(facts.confidence(F.collect_list("confidence")).alias("c")).first().c
    assert ocr == 0.88
    assert all(x.count() == 0 for x in layout.recorded_lines(spark.createDataFrame([], WORD)))
