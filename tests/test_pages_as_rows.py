"""A page's boxes move once at most: no query over word boxes joins boxes with boxes, and pages as rows give what boxes as rows give."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.catalog import library_queries
from recordloom.operators import layout, zones

SF = "/root/testdata/sf0.001"
ONE = ("gutter_labels", "values_beside", "values_under", "value_continuation", "zone_box", "label_value_pairs", "stamps", "merge_rows", "page_segments", "nearest_tick", "reading_order", "sections", "merge_words")


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    return plan.count("Exchange"), plan.count("Join")


@pytest.mark.parametrize("name", ONE)
def test_boxes_move_once(spark, name):
    assert exchanges(library_queries()[name](spark, SF)) == (1, 0)


def test_pages_of_a_form_and_headers_move_no_boxes_again(spark):
    assert exchanges(library_queries()["generic_form"](spark, SF)) == (2, 0)  # the second one has a row a page
    assert exchanges(library_queries()["page_header"](spark, SF)) == (2, 1)  # the other one has the pages' rules


def rows(spark, seed=5):
    rng = random.Random(seed)
    boxes = [(d, p, i, rng.randint(0, 600), rng.randint(0, 300), rng.randint(1, 80), rng.randint(5, 14), rng.choice((0.9, 0.5)), rng.choice(("Bill No:", "Date", "7.50", "Acme", "x:"))) for d in range(3) for p in range(4) for i in range(rng.choice((1, 12, 70)))]
    s = spark.createDataFrame(boxes, "doc_id long, page_no int, seg_id int, left int, top int, width int, height int, conf double, text string")
    return layout.geometry(s.withColumn("unit", F.lit(10.0)))


def test_bands_find_what_all_pairs_find(spark):
    lab = layout.labels(rows(spark)).localCheckpoint()
    of = {}
    for r in lab.collect():
        of.setdefault((r.doc_id, r.page_no), []).append(r)

    def until(found):
        out = []
        for s in found:
            if s.is_label:
                break
            out.append(s.seg_id)
        return out

    beside, under, right = {}, {}, {}
    for key, page in of.items():
        for a in (x for x in page if x.is_label):
            row = [s for s in page if s.seg_id != a.seg_id and abs(s.cy - a.cy) <= 10]
            right[(*key, a.seg_id)] = any(s.left >= a.right for s in row)
            beside[(*key, a.seg_id)] = until(sorted((s for s in row if 0 <= s.left - a.right <= 200), key=lambda s: (s.left, s.top, s.seg_id)))
            under[(*key, a.seg_id)] = until(sorted((s for s in page if s.seg_id != a.seg_id and a.bottom <= s.cy <= a.bottom + 30 and abs(s.left - a.left) <= 27), key=lambda s: (s.top, s.left, s.seg_id)))
    got = lambda df: {(r.doc_id, r.page_no, r.seg_id): [x.seg_id for x in r.found] for r in df.collect()}
    assert got(layout.beside(lab)) == {k: v for k, v in beside.items() if v}
    assert got(layout.under(lab)) == {k: v for k, v in under.items() if v}
    box = {(r.doc_id, r.page_no, r.seg_id): r for r in layout.zone_box(lab).collect()}
    sides = {(r.doc_id, r.page_no, r.seg_id): r.right for r in lab.collect()}
    assert box.keys() == right.keys() and all((r.x1 == sides[k]) == right[k] for k, r in box.items())


def test_sections_of_pages(spark):
    s = rows(spark, 6)
    boxes = F.array(F.struct(F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.lit(200).alias("x2"), F.lit(40).alias("y2")))
    one = {tuple(r) for r in zones.sections(s, boxes, 1.0).select("doc_id", "page_no", "seg_id", "section").collect()}
    other = {tuple(r) for r in zones.sections(layout.paged(s), boxes, 1.0).select("doc_id", "page_no", "seg_id", "section").collect()}
    assert one == other and len({r[3] for r in one}) > 2
