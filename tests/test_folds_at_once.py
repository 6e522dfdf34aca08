"""Folds that numpy makes for all pages of a batch give what the fold of one page gives, and texts are read as the Column functions read them."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.catalog import library_queries
from recordloom.functions import text as X
from recordloom.functions import validators as V
from recordloom.operators import folds, layout, pages

SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "no", "No.", "número no", "xno", "no\n", "no\r\n", "no ", "NO\x85", "no\n\n", "noſ", "ID:", "a_b c", "_x", "x_", "straße ok", "•- *Bill  No.:*-", "12/03/2026", "1,234.50/-", "12", "12\n", " 7 ", "a:b", "ab: c", "ab:", "ab : - c d", "12:34", "http://x", "ab: ",
    "a\nb: c", "ab: c\n", "ab: c\nd", " Date ", "[P12]", "(A1)", "p1\n", "ıa1", "KK1", "✓", " v ", "l'eau", "éa: é", "İ9", "x" * 61 + ": y",
]


def test_texts_are_read_as_columns_read_them(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    pair = X.inline_pair("t")
    label = (X.strip("t").endswith(":") | F.col("t").rlike(layout.SUFFIX)) & ~V.looks_like_value("t")
    want = df.select("t", X.field_key("t").alias("key"), label.alias("label"), pair["label"].alias("a"), pair["value"].alias("b"), (X.strip("t") != "").alias("some")).orderBy("i").collect()
    texts = pa.array(ODD)
    assert layout._field_keys(texts).to_pylist() == [r.key for r in want]
    assert layout._is_label(np.zeros(len(ODD), bool), np.ones(len(ODD)), texts).tolist() == [r.label for r in want]
    assert [layout._inline(t) for t in ODD] == [None if r.a is None else (r.a, r.b) for r in want]
    assert folds.nonblank(texts).tolist() == [r.some for r in want]
    code, bare, tick = layout._codes(texts)
    assert bare.to_pylist() == [layout._code(t) for t in ODD] and code.tolist() == [bool(re.match(layout.CODE, layout._code(t), re.IGNORECASE)) for t in ODD]
    assert tick.tolist() == [t.strip() in layout.TICKS for t in ODD]


WORDS = ("Bill No:", "Date", "7.50", "Acme", "x:", "[P1]", "(Q22)", "R3", "S4|", "v", "✓", ":", "Ship to", "12/03/2026", "State", "State 2", "State_2")


def boxes(rng, n, unit, words=WORDS):
    out = []
    for i in rng.sample(range(10 * n), n):
        x, y, w, h = rng.randint(0, 300), rng.randint(0, 120), rng.randint(0, 60), rng.randint(4, 14)
        out.append({"seg_id": i, "left": x, "top": y, "right": x + w, "bottom": y + h, "width": w, "height": h, "cx": x + w / 2, "cy": y + h / 2, "unit": unit, "is_label": rng.random() < 0.3, "text": rng.choice(words)})
    return out


def arrays(pages):
    return folds.ends([len(p) for p in pages]), [pa.array([x[c] for p in pages for x in p]) for c in layout.FOLDED]


def test_labels_of_many_pages(monkeypatch):
    rng = random.Random(8)
    leaves = [boxes(rng, rng.choice((0, 1, 3, 17, 60, 130)), rng.choice((6.0, 10.0, 14.0))) for _ in range(60)]
    leaves[5] = [{**x, "seg_id": 1} for x in leaves[5]] or leaves[6]  # ids that are not their own
    numbers = pa.array(range(len(leaves)), pa.int32())
    want = []
    for p, page in enumerate(leaves):
        for x in page:
            x["key"] = layout._field_keys(pa.array([x["text"]]))[0].as_py()
        want += [(p, k, v) for k, v in (layout._pairs_of_page(p, layout._with_rows([dict(x) for x in page])) if page else [])]
    for small in (256, 20):  # leaves of more boxes are folded one by one
        monkeypatch.setattr(layout, "SMALL", small)
        off, columns = arrays(leaves)
        got = layout._pairs_of_pages(numbers, off, *columns)
        assert list(zip(got[0].tolist(), got[1].to_pylist(), got[2].to_pylist(), strict=True)) == want
    assert {k.split("_")[0] for _, k, _ in want} > {"PO", "Stamp", "Unmatched", "Bill"} and any(" | " in (v or "") for _, _, v in want)


@pytest.mark.parametrize("name", ["stamps", "nearest_tick", "generic_form", "values_under", "values_beside", "page_header", "label_value_pairs", "merge_rows"])
def test_boxes_are_made_and_folded_in_batches(spark, name):
    """No function of a single box or text, run by an interpreter, stands between a page's tokens and what is found."""
    plan = library_queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(") <= (2 if name in ("nearest_tick", "page_header") else 1) and "aggregate(" not in plan and "zip_with(" not in plan and "rlike" not in plan.lower()


def test_crowds_and_ticks_of_many_pages():
    rng = random.Random(9)
    leaves = [boxes(rng, rng.choice((0, 2, 40, 90)), 8.0) for _ in range(30)]
    off, columns = arrays(leaves)
    of = dict(zip(layout.FOLDED, columns, strict=True))
    cx, cy = folds.floats(of["cx"], of["cy"])
    crowd = folds.crowds(off, cx, cy, np.ones(len(cx), bool), np.full(len(leaves), 30.0), 4)
    for p, page in enumerate(leaves):
        mine = crowd[off[p] : off[p + 1]]
        assert [[x["seg_id"] for x in g] for g in layout.densest(page, 6.0)] == [[page[i]["seg_id"] for i in np.flatnonzero(mine == k)] for k in range(mine.max(initial=-1) + 1)]
    rows = folds.row_numbers(off, cy, np.full(len(cx), 8.0), layout.ROW_BAND)
    assert rows.tolist() == [x["row_no"] for page in leaves for x in layout._with_rows(page)]


def test_phrases_of_odd_words(spark):
    words = [(1, 0, 0, 0, 0, 0, 10, 0, 20, 10, 90.0, "a"), (1, 0, 0, 0, 0, 1, 32, 1, 20, 12, 80.0, "b"), (1, 0, 0, 0, 0, 2, 80, 0, 5, 9, 70.0, "c"), (1, 0, 0, 0, 1, 0, 85, 30, 5, 9, 70.0, "d"), (1, 1, 0, 0, 0, 0, 5, 0, 5, 9, -1.0, "e"), (1, 1, 0, 0, 0, 1, 12, 0, 5, 9, 60.0, " "), (2, 0, None, 0, 0, 0, 5, 0, 5, 9, 60.0, "f"), (2, 0, None, 0, 0, 1, 10, 0, 5, 9, 60.0, "g"), (2, 1, 0, 0, 0, 0, None, 0, 5, 9, 60.0, "h"), (2, 1, 0, 0, 0, 1, 7, 0, 5, 9, None, "i")]
    w = spark.createDataFrame(words, "doc_id int, page_no int, block int, par int, line int, word int, left int, top int, width int, height int, conf double, text string")
    got = {(r.doc_id, r.page_no, r.text): (r.x1, r.y1, r.x2, r.y2, r.confidence) for r in layout.merge_words(w).collect()}
    assert got == {(1, 0, "a b"): (10, 0, 52, 13, 0.8), (1, 0, "c"): (80, 0, 85, 9, 0.7), (1, 0, "d"): (85, 30, 90, 39, 0.7), (2, 0, "f g"): (5, 0, 15, 9, 0.6), (2, 1, "h"): (None, 0, None, 9, 0.6)}


def test_phrases_of_pages_at_once_are_those_of_each_page(spark):
    rng = random.Random(11)
    word = lambda: (None, rng.choice((0, 0, 1)), 0, rng.choice((0, 1, None)), rng.randint(0, 60), rng.randint(0, 9), rng.randint(0, 20), rng.randint(0, 30), rng.randint(0, 14), rng.choice((90.0, 55.5, 0.0, -1.0, None)), rng.choice(("a", "bé", "", " ", None, "c:")))
    pages_ = [(k, sorted((word() for _ in range(rng.choice((0, 1, 25)))), key=lambda w: (w[1], w[3] or 0, w[4]))) for k in range(120)]
    df = spark.createDataFrame(pages_, f"k int, words array<{pages.WORD}>").localCheckpoint()
    got = df.withColumn("_now", pages.phrases_at_once(F.col("words"), 0.8)).withColumn("_one", pages.phrases(F.col("words"), 0.8)).collect()
    assert all(r["_now"] == r["_one"] for r in got) and sum(len(r["_one"]) for r in got) > 100


def test_receipts_of_any_layout_find_phrases_at_once(spark):
    plan = library_queries()["legacy_receipt"](spark, SF)
    assert plan.columns
    flow = pages.better_words(spark.createDataFrame([(1, [])], f"doc_id int, words array<{pages.WORD}>"))
    assert "aggregate(words" not in flow.select("phrases")._jdf.queryExecution().optimizedPlan().toString() and flow.select("phrases").first().phrases == []
