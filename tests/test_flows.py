"""Flows from pages, golden pages by hand; long runs in segments; large pages; bounds of ratios; many clients."""

import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.functions import fuzzy
from recordloom.operators import infer, layout, matching, pages, tables
from recordloom.plans import books, legacy, receipts

WORDS = "doc_id long, page_no int, variant string, line int, word int, left int, top int, width int, height int, conf double, text string"
RULES, BOXES = "doc_id long, page_no int, axis string, at double, first double, last double", "doc_id long, page_no int, kind string, x1 double, y1 double, x2 double, y2 double"
TILES, SIZES = "doc_id long, page_no int, x1 double, y1 double, x2 double, y2 double, levels array<bigint>", "doc_id long, page_no int, width double, height double"


def words(spark, *texts, doc=1, page=0, variant=None, conf=90.0):
    rows = []
    for x, y, text in texts:
        for i, w in enumerate(text.split()):
            rows.append((doc, page, variant, y, x + i, x + 8 * (len(" ".join(text.split()[:i])) + (i > 0)), y, 8 * len(w), 14, conf, w))
    return spark.createDataFrame(rows, WORDS)


def parts(spark, w, rules=(), boxes=(), tiles=(), size=(1000.0, 1000.0)):
    keys = [(r.doc_id, r.page_no) for r in w.select("doc_id", "page_no").distinct().collect()]
    make = lambda rows, ddl: spark.createDataFrame([(*k, *r) for k in keys for r in rows], ddl)
    return {"words": w, "rules": make(rules, RULES), "boxes": make(boxes, BOXES), "tiles": make(tiles, TILES), "sizes": make([size], SIZES)}


def levels(dark):
    return [dark if i == 20 else 100 - dark if i == 230 else 0 for i in range(256)]


def test_a_page_is_one_row_by_one_shuffle(spark):
    p = parts(spark, words(spark, (40, 40, "LR NO"), (40, 70, "b")), [("h", 30.0, 0.0, 1000.0)])
    page = pages.gathered(**p)
    plan = receipts.zoned(page)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    r = page.collect()[0]
    assert [w.text for w in r.words] == ["LR", "NO", "b"] and (r.width, r.height) == (1000.0, 1000.0) and r.boxes == [] and len(r.rules) == 1
    assert pages.gathered(words=p["words"]).collect()[0].width == 40 + 8 * 3 + 8 * 2


def test_golden_receipt(spark):
    w = words(
        spark, (40, 40, "LR NO"), (220, 40, "L8400001"), (40, 70, "LR DATE : 05.03.2026"), (40, 100, "goods to the order of somebody far away from here"), (520, 40, "TRUCK NO"), (700, 40, "MH12AB1234"), (520, 70, "FREIGHT"), (700, 70, "TOPAY"),
        (40, 330, "ROUTE"), (220, 330, "R1-COAST"), (40, 420, "LORRY TARE WT"), (200, 420, "NET WT"), (340, 420, "GROSS WT"), (50, 460, "14.5OO"), (195, 460, "30.25"), (330, 460, "44.75 T"),
        (30, 545, "PACKAGES"), (210, 545, "DESCRIPTION"), (510, 545, "NET WT"), (30, 585, "7"), (210, 585, "STEEL COIL"), (40, 680, "STO NO : 44"), (40, 870, "AUTHORISED SIGNATORY"), (520, 710, "CUSTOMER'S SEAL AND SIGN"), (530, 760, "received ok"),
    )
    rules = [("h", y, 10.0, 990.0) for y in (10.0, 320.0, 395.0, 530.0, 570.0, 610.0, 700.0)] + [("v", x, 530.0, 610.0) for x in (20.0, 200.0, 500.0, 650.0)]
    boxes = [("section", 20.0, 20.0, 490.0, 310.0), ("section", 500.0, 20.0, 980.0, 310.0), ("section", 20.0, 325.0, 480.0, 390.0), ("section", 20.0, 530.0, 200.0, 570.0), ("section", 200.0, 530.0, 500.0, 570.0), ("section", 500.0, 530.0, 650.0, 570.0), ("section", 20.0, 700.0, 480.0, 900.0)]
    tiles = [(100.0, 780.0, 200.0, 820.0, levels(30)), (530.0, 740.0, 600.0, 780.0, levels(2))]
    worse = words(spark, (40, 40, "LR N0"), (220, 40, "smear"), variant="processed", conf=20.0)
    r = receipts.receipt_flow(**parts(spark, w.withColumn("variant", F.lit("original")).unionByName(worse), rules, boxes, tiles)).collect()
    assert len(r) == 1
    got = {k: v for k, v in r[0].asDict().items() if v is not None}
    assert got == {
        "doc_id": 1, "page_no": 0, "lr_no": "L8400001", "lr_date": "05.03.2026", "truck_no": "MH12AB1234", "freight": "TOPAY", "route": "R1-COAST", "lorry_tare_wt": "14.5", "net_wt": "30.25", "gross_wt": "44.75",
        "text_above_transporter_stamp": "STO NO : 44", "transporter_stamp_present": True, "customer_seal_text_handwritten": "received ok", "customer_seal_present": False,
    }  # fmt: skip  - the table of goods has three columns of five, so none is read
    none = receipts.receipt_flow(**parts(spark, words(spark, (40, 40, "nothing to see")))).collect()[0]
    assert [k for k, v in none.asDict().items() if v is not None] == ["doc_id", "page_no", "customer_seal_present"]


def test_a_number_goes_to_the_first_field_only(spark):
    w = words(spark, (40, 600, "NET WT"), (40, 640, "GROSS WT"), (300, 630, "30.25"), (300, 700, "44.75"), (40, 40, "LR NO"), (40, 80, "31000001"), (40, 120, "8400123"), (40, 900, "12.34"))
    page = matching.with_anchors(pages.better_words(pages.gathered(words=w, sizes=parts(spark, w)["sizes"])), "phrases", {n: legacy.SYNONYMS[n] for n, *_ in legacy.TARGETS}, guard=None)
    r = legacy.targeted(page).collect()[0]
    assert (r.found_net_wt, r.found_gross_wt, r.found_lr_no, r.found_shipment_no) == ("30.25", "44.75", "31000001", None)
    r = legacy.targeted(page.withColumn("phrases", F.filter("phrases", lambda p: p["text"] != "31000001"))).collect()[0]
    assert (r.found_lr_no, r.found_shipment_no) == ("8400123", None)


def test_sections_and_acknowledgement(spark):
    w = words(spark, (40, 40, "LR NO"), (220, 40, "L8400001"), (600, 40, "STATE"), (700, 40, "MH 27"), (40, 500, "STATE"), (140, 500, "GJ 24"), (40, 700, "RECEIVED WT"), (240, 700, "DATE"), (340, 700, "REMARK")).unionByName(words(spark, (45, 730, "9.5 T"), (245, 730, "1/2/26"), (345, 730, "torn bag"), variant="ink", conf=50.0))
    r = legacy.legacy_flow(**{k: v for k, v in parts(spark, w, boxes=[("section", 20.0, 20.0, 400.0, 300.0)]).items() if k in ("words", "boxes", "sizes")}).collect()[0]
    assert r.lr_no == "L8400001" and {k: v for k, v in r.fields.items() if k.startswith("State")} == {"State": "MH 27", "State_2": "GJ 24"}
    assert not r.acknowledgement_zone_found  # the heading is one of the captions: none is below it
    w = w.unionByName(words(spark, (40, 660, "CUSTOMER ACKNOWLEDGEMENT")))
    r = legacy.legacy_flow(**{k: v for k, v in parts(spark, w).items() if k in ("words", "boxes", "sizes")}).collect()[0]
    assert (r.received_wt_handwritten, r.received_date_handwritten, r.remark_handwritten, r.remark_handwritten_low_confidence) == ("9.5", "1/2/26", "torn bag", True)


def test_rows_of_a_long_bill_are_numbered_by_page_sums(spark):
    many = spark.range(10_000).selectExpr("1L AS doc_id", "CAST(id AS INT) AS page_no", "transform(sequence(1, CAST(id % 3 AS INT) + 1), i -> array(CAST(id AS STRING), CAST(i AS STRING))) AS cells").withColumn("cells", F.when(F.col("page_no") % 5 == 0, F.array().cast("array<array<string>>")).otherwise(F.col("cells")))
    rows = books.numbered_rows(many)
    got = rows.orderBy("row_idx").collect()
    assert [r.row_idx for r in got] == list(range(len(got))) and [int(r.cells[0]) for r in got] == sorted(int(r.cells[0]) for r in got)
    assert [r.carried for r in got[:4]] == [False, False, True, True]


def test_long_runs_in_segments_equal_a_window(spark):
    rng = random.Random(1)
    xs = sorted(rng.sample(range(6_000), 900))
    points = spark.createDataFrame([(k, x) for k in (1, 2, None) for x in xs if k != 2 or x % 3], "k int, x int")
    for span in (30, 100_000):  # 200 segments, and one
        got = {(r.k, r.line_no, r.first, r.last, r.line) for r in tables.group_lines(points, ["k"], 9, span).collect()}
        w = Window.partitionBy("k").orderBy("x")
        run = points.withColumn("line_no", F.sum(F.coalesce((F.col("x") - F.lag("x").over(w) > 9).cast("int"), F.lit(0))).over(w))
        want = {(r.k, r.line_no, r.a, r.b, (r.a + r.b) // 2) for r in run.groupBy("k", "line_no").agg(F.min("x").alias("a"), F.max("x").alias("b")).collect()}
        assert got == want and len(want) > 300
        groups = tables.gap_groups(points, ["k"], "x", F.lit(3.0), 3.0, span)
        assert {(r.k, r.x, r.group_no) for r in groups.collect()} == {(r.k, r.x, r.line_no) for r in run.collect()}
    cells = spark.createDataFrame([(t, i, c, str(i * (1 if c == 0 else rng.choice([1, 2, 900])) if (t, c, i) != (2, 0, 55) else "x")) for t in (1, 2) for c in (0, 1) for i in range(400)], "table_id int, row_idx int, col_idx int, text string")
    whole = sorted(map(tuple, infer.sequential(cells).collect()))
    assert sorted(map(tuple, infer.sequential(cells, 2).collect())) == whole and {r[2] for r in whole} == {True, False}


def plain_densest(segments, unit, least, size):
    out = []
    while len(segments) >= least:
        groups = [[x for x in segments if abs(x["cx"] - a["cx"]) <= size * unit / 2 and abs(x["cy"] - a["cy"]) <= size * unit / 2] for a in segments]
        best = max(groups, key=len)
        if len(best) < least:
            break
        out.append(best)
        segments = [x for x in segments if all(x is not y for y in best)]
    return out


def plain_merge(p, joined):
    changed = True
    while changed:
        changed = False
        for i in range(len(p)):
            for j in range(i + 1, len(p)):
                if m := joined(p[i], p[j]):
                    p[i], changed = m, True
                    del p[j]
                    break
            if changed:
                break
    return p


def test_grids_of_a_page_change_nothing(spark):
    rng = random.Random(3)
    for unit in (1.0, 0.0, 7.5):
        s = [{"cx": rng.randint(0, 60), "cy": rng.randint(0, 60), "i": i} for i in range(150)]
        assert layout.densest(list(s), unit) == plain_densest(list(s), unit, layout.STAMP_LEAST, layout.STAMP_BOX)

    def joined(a, b):
        low, high = sorted((a[3] - a[1], b[3] - b[1]))
        left, right = (a, b) if a[0] <= b[0] else (b, a)
        if min(a[3], b[3]) - max(a[1], b[1]) < 0.5 * low or not 0 <= right[0] - left[2] <= 1.2 * high:
            return None
        return (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), min(a[4], b[4]), f"{left[5]} {right[5]}")

    rows = []
    for page in range(6):
        for i in range(120):
            x, y, w, h = rng.randint(0, 500), rng.randint(0, 200), rng.randint(1, 30), rng.randint(0, 14)
            rows.append((1, page, x, y, x + w, y + h, rng.random(), f"t{i}"))
    got = layout.merge_rows(spark.createDataFrame(rows, "doc_id int, page_no int, x1 int, y1 int, x2 int, y2 int, confidence double, text string")).collect()
    for page in range(6):
        p = sorted(((r[2:]) for r in rows if r[1] == page), key=lambda x: (x[1], x[0], x[7 - 2]))
        assert sorted(tuple(r)[2:] for r in got if r.page_no == page) == sorted(plain_merge(p, joined))


def test_a_page_of_twenty_thousand_boxes():
    rng = random.Random(4)
    s = [{"cx": rng.randint(0, 40_000), "cy": rng.randint(0, 40_000)} for _ in range(20_000)]
    began = time.time()
    layout.densest(s, 20.0)
    names = layout.numbered(["a"] * 20_000 + ["a_3"])
    assert time.time() - began < 20 and names[:3] == ["a", "a_2", "a_3"] and names[-1] == "a_3_2"


def test_no_ratio_is_above_its_bound(spark):
    rng = random.Random(5)
    pool = {"f": ["lr no", "e way bill no"], "g": ["stamp and signature of the transporter", "to", "amount"]}
    texts = ["".join(rng.choice("lrno ewaybistm") for _ in range(rng.randint(0, 14))) for _ in range(250)] + ["lr no", "lrno", "l r  n o", "the amount", "amonut", "stamp signature transporter", "to", "t", "", "ẞé lr nö"]
    flat = [s for ss in pool.values() for s in ss]
    letters = fuzzy.alphabet(flat)
    t = F.col("t")
    bounds = spark.createDataFrame([(x,) for x in texts], "t string").select("t", F.array(*[fuzzy.score_bound(F.length(t), fuzzy.solid_length(t), fuzzy.char_counts(t, letters), s, letters) for s in flat]).alias("b")).collect()
    scored = reached = 0
    for r in bounds:
        for s, b in zip(flat, r.b, strict=True):
            if r.t.strip():
                assert fuzzy.score(r.t, s) <= b + 1e-9
                scored, reached = scored + (b >= 82), reached + (fuzzy.score(r.t, s) >= 82)
    assert 0 < reached <= scored


def test_few_pairs_are_scored(spark):
    texts = ["lr no", "l8400001", "lr date", "05.03.2026", "goods to the order of somebody", "truck no", "mh12ab1234", "freight", "topay", "route", "r1-coast", "lorry tare wt", "net wt", "gross wt", "14.500", "packages", "steel coil", "authorised signatory", "received ok", "incoterm", "shipment no"]
    possible = matching.possible_pairs(F.col("t"), receipts.ANCHORS, 82.0)
    guarded = F.filter(possible, lambda s: matching.guarded(F.col("t"), s["field"], receipts.ANCHORS, "alnum"))
    names = lambda c: F.transform(c, lambda s: s["synonym"])
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", names(possible).alias("s"), names(guarded).alias("g")).collect()
    kept, sent = ({(r.t, s) for r in rows for s in r[k]} for k in ("s", "g"))
    flat = [s for ss in receipts.ANCHORS.values() for s in ss]
    assert {(t, s) for t in texts for s in flat if fuzzy.score(t, s) >= 82} <= kept
    # 189 pairs; what letters cannot rule out is mostly a short text against a long synonym, which the guard of lengths takes
    assert len(kept) < 0.5 * len(texts) * len(flat) and len(sent) < 0.25 * len(texts) * len(flat)


def test_five_thousand_clients(spark):
    clients = [f"carrier_{i}" for i in range(5_000)] + ["ab"]
    texts = spark.createDataFrame([("M/s Carrier 4999 Ltd",), ("CARRIER-12 and carrier_1",), ("nobody",), (None,), ("x AB y",)], "text string")
    began = time.time()
    out = matching.detect_client(texts, clients)
    out._jdf.queryExecution().executedPlan()
    assert time.time() - began < 15
    # "carrier12" has the names of carriers 1 and 12 in it: the one configured first wins
    assert {r.text: r.client for r in out.collect()} == {"M/s Carrier 4999 Ltd": "carrier_4", "CARRIER-12 and carrier_1": "carrier_1", "nobody": "", None: "", "x AB y": "ab"}


def test_page_roles_join_by_equality(spark):
    p = spark.range(1, 400).selectExpr("1L AS doc_id", "CAST(id AS INT) AS page_no")
    lay = spark.createDataFrame([("a", 1, 3), ("b", 60, 2**31 - 1), ("c", 5, 4)], "role string, first_page int, last_page int")
    out = tables.page_roles(p, lay)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.page_no: r.role for r in out.collect()} == {k: "a" if k <= 3 else "b" if k >= 60 else None for k in range(1, 400)}
    assert tables.page_roles(p.where("false"), lay).count() == 0


@pytest.mark.parametrize("text", ["ciónos", "número no", "no", "x.no", "xno", "_no"])
def test_borders_of_label_words(spark, text):
    found = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(layout.SUFFIX)).first()[0]
    assert found == (text in ("número no", "no", "x.no"))
