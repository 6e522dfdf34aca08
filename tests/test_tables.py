"""Inference, table rows, matching, layout, zones, reports and sources on small inputs."""

import zipfile

from pyspark.sql import functions as F

from recordloom.operators import infer, layout, matching, report, tables, zones
from recordloom.sources import tables as sources


def cells(spark, rows, table=1):
    return spark.createDataFrame([(table, i, j, t) for i, row in enumerate(rows) for j, t in enumerate(row)], "table_id long, row_idx long, col_idx int, text string")


DATA = [[str(i + 1), f"{i + 1:02d}.05.2026", f"{30 + i}.50", "10.25", f"{(30.5 + i) * 10.25:.2f}", f"AB{i}7", "some place", ""] for i in range(6)]


def test_classification(spark):
    c = cells(spark, DATA)
    types = {r.col_idx: r.column_type for r in infer.column_types(c).collect()}
    assert types == {0: "small_sequential_int", 1: "date_like", 2: "decimal_currency", 3: "decimal_currency", 4: "decimal_currency", 5: "alphanumeric_code", 6: "free_text"}
    assert tuple(infer.product_triples(c).first())[:4] == (1, 2, 3, 4)
    names = {r.col_idx: r.name for r in infer.classify_columns(c).collect()}
    assert names[4] == "amount" and names[2] == names[3] == "qty_or_rate" and names[7] == "unclassified_col_8"
    caps = spark.createDataFrame([(1, 3, "Rate"), (1, 1, "LR Date"), (1, 4, "Party Name")], "table_id long, col_idx int, caption string")
    named = {r.col_idx: r.name for r in infer.classify_columns(c, matching.match_captions(caps)).collect()}
    assert (named[1], named[2], named[3], named[4]) == ("lr_date", "gross_qty", "rate", "amount")
    full = {r.col_idx: r.name for r in infer.column_names(infer.classify_columns(c), caps).collect()}
    assert full[1] == "lr_date" and full[0] == "small_sequential_int"


def test_a_lost_leading_digit(spark):
    row = spark.sql("SELECT 33.96D x, 2043.18D y, 9386.39D z, 500.0D w")
    assert row.select(infer.product_matches(F.col("x"), F.col("y"), F.col("z")), infer.product_matches(F.col("x"), F.col("y"), F.col("w"))).first()[:] == (True, False)


def test_unique_names(spark):
    n = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a", "a", "a_2", "b", "a"])], "t int, pos int, name string")
    assert [r.name for r in infer.unique_names(n, ["t"], "pos").orderBy("pos").collect()] == ["a", "a_3", "a_2", "b", "a_4"]


def test_rows(spark):
    rows = tables.rows_of(cells(spark, [["12345678", "x", ""], ["Sr", "LR No", "Amount"], ["1", "7", "2"], ["", "Total", ""]]))
    assert tables.caption_rows(rows).first().caption_row == 1
    kept = rows.where(tables.not_footer(F.col("cells"))).select("row_idx").collect()
    assert {r.row_idx for r in kept} == {0, 1, 2}
    good = rows.where(tables.bill_data_row(F.get("cells", F.lit(0)), F.col("cells"))).collect()
    assert {r.row_idx for r in good} == {0, 1, 2}
    numbers = tables.column_number_rows(tables.rows_of(cells(spark, [["1", "2", ""], ["Sr", "LR", "x"]])), spark.createDataFrame([(1, 1)], "table_id long, caption_row long"))
    assert numbers.first().numbers == ["1", "2"]


def test_rules(spark):
    p = spark.createDataFrame([(1, x) for x in (5, 6, 7, 30, 31, 60, 200)], "g int, x long")
    g = tables.group_lines(p, ["g"]).orderBy("line").collect()
    assert [r.line for r in g] == [6, 30, 60, 200]
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    out = spark.range(1).select(tables.trim_outliers(arr(0, 50, 100, 150, 1700)), tables.trim_outliers(arr(0, 900)), tables.trim_outliers(arr(0, 10, 900, 1800)), tables.upper_median(arr(1, 2, 3, 4)), tables.leftmost(arr(1, 2), 3), tables.width_split(F.lit(55), F.lit(0), F.lit(100), 4)).first()
    assert (out[0], out[1], out[3], out[4], out[5]) == ([0, 50, 100, 150], [0, 900], 3, None, 2)


def test_page_runs(spark):
    rows = [(1, 0, False, 5), (1, 1, True, 8), (1, 2, False, 9), (1, 3, False, None), (1, 4, False, 8), (1, 6, True, 4)]
    got = tables.page_runs(spark.createDataFrame(rows, "doc_id int, page_no int, is_title boolean, n_cols int")).orderBy("page_no").collect()
    assert [(r.start_page, r.page_no) for r in got] == [(1, 1), (1, 2), (6, 6)]


def test_matching(spark):
    t = spark.createDataFrame([(1, 0, "lr number"), (1, 1, "lr no"), (1, 2, "amount"), (1, 3, "")], "table_id int, idx int, text string")
    found = matching.greedy_assign(matching.synonym_matches(t, matching.FIELD_SYNONYMS, ["table_id"]), ["table_id"]).collect()
    by = {r.idx: r.field for r in found}
    assert by[0] == "lr_no" and by[2] == "amount" and len(set(by.values())) == len(by)
    bands = spark.createDataFrame([(1, 0, 0.1, "GST TAX INVOICE"), (1, 1, 0.5, "tax invoice"), (1, 2, 0.1, "tax invoice " + "x" * 200)], "doc_id int, page_no int, top double, text string")
    assert [r.page_no for r in matching.title_pages(bands).collect()] == [0]
    c = matching.detect_client(spark.createDataFrame([("M/s BLUE river Ltd",), (None,), ("red",)], "text string"), ["blue_river", "red"])
    assert {r.text: r.client for r in c.collect()} == {"M/s BLUE river Ltd": "blue_river", None: "", "red": "red"}
    p = spark.createDataFrame([(1, 0, "the lr no x"), (1, 1, "LR No."), (1, 2, "zzz")], "page int, idx int, text string")
    assert matching.locate_anchor(p, ["lr no"], ["page"]).first().idx == 1


WORD = "doc_id long, page_no int, block int, par int, line int, word int, left int, top int, width int, height int, conf double, text string"


def test_phrases(spark):
    w = [(1, 0, 0, 0, 0, 0, 0, 0, 20, 10, 90.0, "Lr"), (1, 0, 0, 0, 0, 1, 26, 0, 20, 10, 80.0, "No"), (1, 0, 0, 0, 0, 2, 90, 0, 20, 10, 70.0, "77"), (1, 0, 0, 0, 1, 0, 0, 30, 20, 10, -1.0, "x")]
    got = layout.merge_words(spark.createDataFrame(w, WORD)).orderBy("x1").collect()
    assert [(r.text, r.x1, r.x2, round(r.confidence, 2)) for r in got] == [("Lr No", 0, 46, 0.8), ("77", 90, 110, 0.7)]
    p = spark.createDataFrame([(1, 0, 0, 0, 10, 10, 0.9, "a"), (1, 0, 30, 1, 40, 11, 0.8, "c"), (1, 0, 15, 0, 25, 10, 0.7, "b")], "doc_id long, page_no int, " + layout.PHRASE)
    assert [r.text for r in layout.merge_rows(p).collect()] == ["a b c"]


def segments(spark, rows):
    s = spark.createDataFrame([(1, 0, i, *r) for i, r in enumerate(rows)], "doc_id long, page_no int, seg_id int, left int, top int, width int, height int, conf double, text string")
    return layout.geometry(s.withColumns({"unit": F.lit(10.0), "pass_ord": F.lit(0)}))


def test_labels_and_values(spark):
    s = segments(spark, [(0, 0, 60, 10, 0.9, "Vendor Name"), (100, 0, 60, 10, 0.9, "Acme"), (170, 1, 60, 10, 0.9, "Ltd"), (0, 30, 60, 10, 0.9, "Bill Date:"), (0, 50, 60, 10, 0.9, "05.09.2026"), (400, 0, 50, 10, 0.9, "stray")])
    lab = layout.labels(s)
    assert {r.text for r in lab.where("is_label").collect()} >= {"Vendor Name", "Bill Date:"}
    got = {r.key: r.value for r in layout.label_values(lab.withColumn("is_label", F.col("text").isin("Vendor Name", "Bill Date:"))).collect()}
    assert got["Vendor_Name"] == "Acme Ltd" and got["Bill_Date"] == "05.09.2026" and got["Unmatched_Text_1_5"] == "stray"


def test_values_beside_below_and_continued(spark):
    s = segments(spark, [(0, 0, 60, 10, 0.9, "Vendor Name:"), (100, 9, 60, 10, 0.9, "Acme"), (0, 100, 60, 10, 0.9, "Remark:"), (5, 134, 60, 10, 0.9, "late"), (0, 300, 60, 10, 0.9, "Approver:"), (100, 300, 60, 10, 0.9, "A B"), (100, 320, 60, 10, 0.9, "Head of"), (100, 360, 60, 10, 0.9, "Accounts"), (0, 500, 60, 10, 0.9, "**:"), (100, 500, 60, 10, 0.9, "nameless")])
    got = {r.key: r.value for r in layout.label_values(s.withColumn("is_label", F.col("text").endswith(":"))).collect()}
    assert got == {"Vendor_Name": "Acme", "Remark": "late", "Approver": "A B | Head of | Accounts"}


def test_tick_boxes_stamps_and_numbered_names(spark):
    page = [(0, 0, 40, 10, 0.9, "PO1X"), (60, 0, 40, 10, 0.9, "PO2X"), (120, 0, 40, 10, 0.9, "PO3O"), (125, 12, 8, 8, 0.9, "v"), (0, 100, 60, 10, 0.9, "Bill No: 7"), (0, 140, 60, 10, 0.9, "Bill No: 8")]
    crowd = [(600 + 12 * k, 20 + 15 * k, 10, 10 + k, 0.5, f"w{k}") for k in range(4)]
    rows = [(1, p, *r) for p in (0, 1) for r in (page + crowd if p == 0 else page[4:5])]
    boxes = spark.createDataFrame(rows, "doc_id long, page_no int, left int, top int, width int, height int, conf double, text string")
    form = [(r.page_no, r.key, r.value) for r in layout.generic_form(boxes).orderBy("key_ord").collect()]
    assert form == [(0, "PO_Type_Selected", "PO3O"), (0, "PO_Type_Options", "PO1X PO2X PO3O"), (0, "Bill_No", "7"), (0, "Bill_No_2", "8"), (0, "Stamp_W3", "w0 w1 w2 w3"), (1, "Bill_No_3", "7")]
    cut = spark.createDataFrame([(1, 0, [125], 1000), (1, 1, [], 1000)], "doc_id long, page_no int, lines array<int>, height int")
    assert {(r.page_no, r.key) for r in layout.page_header(boxes, cut).collect()} == {(0, "PO_Type_Selected"), (0, "PO_Type_Options"), (0, "Bill_No"), (0, "Stamp_W3"), (1, "Bill_No")}


def test_width_split_at_the_edges(spark):
    got = spark.createDataFrame([(99,), (100,), (5099,), (5100,), (814,), (815,)], "x int").select("x", tables.width_split(F.col("x"), F.lit(100), F.lit(5000), 7).alias("s")).collect()
    assert {r.x: r.s for r in got} == {99: None, 100: 0, 5099: 6, 5100: None, 814: 0, 815: 1}


def test_sheet_names_fit(spark):
    rows = spark.createDataFrame([(k, "9" * 40) for k in range(1, 121)] + [(500, "0000")], "lr_idx int, lr_no string")
    names = [r.sheet for r in report.sheet_names(rows).collect()]
    assert len(set(names)) == 121 and max(map(len, names)) == 31 and "LR_0000" in names


def test_bands_duplicates_pairs_and_stamps(spark):
    s = segments(spark, [(0, 0, 20, 10, 0.9, "a"), (2, 1, 20, 10, 0.9, "b"), (0, 40, 20, 10, 0.9, "Amount: 7")])
    assert {r.text for r in layout.drop_duplicates(s).collect()} == {"a", "Amount: 7"}
    assert [r.row_no for r in layout.row_bands(s).orderBy("seg_id").collect()] == [0, 0, 1]
    assert {r.text for r in layout.split_inline_pairs(s).collect()} == {"a", "b", "Amount:", "7"}
    crowd = segments(spark, [(i * 5, i * 5, 5, 10 + i, 0.9, f"w{i}") for i in range(5)] + [(900, 900, 5, 10, 0.9, "far")])
    got = layout.stamps(crowd).collect()
    assert len(got) == 1 and got[0].name == "Stamp_W4" and len(got[0].members) == 5


def test_zones(spark):
    a = F.struct(F.lit(100).alias("x1"), F.lit(120).alias("y1"), F.lit(160).alias("x2"), F.lit(140).alias("y2"))
    lines = F.array(F.lit(100), F.lit(200))
    box = F.array(F.struct(F.lit(50).alias("x1"), F.lit(90).alias("y1"), F.lit(400).alias("x2"), F.lit(210).alias("y2")))
    z = spark.range(1).select(zones.zone_crop(a, lines, box, F.lit(1000), F.lit(1000)).alias("z"), zones.weight_crop(a, lines, F.lit(900), F.lit(1000), F.lit(1000)).alias("w")).first()
    assert tuple(z.z) == (50.0, 100.0, 400.0, 200.0) and tuple(z.w) == (88.0, 110.0, 298.0, 200.0)
    labels = spark.createDataFrame([(1, "a", 10, 0, 20, 10), (1, "b", 100, 5, 20, 10), (1, "z", 0, 900, 20, 10)], "p int, text string, left int, top int, width int, height int")
    assert [(r.text, r.until) for r in zones.header_columns(labels, ["p"]).orderBy("left").collect()] == [("a", 100), ("b", 180)]
    words = spark.createDataFrame([(1, "12", 0, 50), (1, "34", 400, 1)], "p int, text string, left int, top int")
    assert zones.nearest_match(words, F.lit(0), F.lit(0), "^[0-9]+$", ["p"]).first().text == "34"


def test_report(spark, tmp_path):
    rows = spark.createDataFrame([(0, {"sr_no": "1", "amount": "5", "validation_flags": ""}), (1, {"sr_no": "2", "extra": "x", "validation_flags": "bad"})], "row_idx int, fields map<string,string>")
    assert [r.header for r in report.bill_columns(rows).orderBy("col").collect()] == ["Sr No", "Amount", "Extra"]
    c = report.bill_cells(rows)
    assert {r.style for r in c.where("row = 2").collect()} == {"yellow"}
    assert {r["col"]: r.width for r in report.column_widths(c).collect()} == {0: 7, 1: 8, 2: 7}
    lrs = spark.createDataFrame([(1, "0000001350"), (2, None), (3, "0000001350")], "lr_idx int, lr_no string")
    assert [r.sheet for r in report.sheet_names(lrs).orderBy("lr_idx").collect()] == ["LR_1350", "LR_page_2", "LR_1350_2"]
    one = report.record_cells(spark.createDataFrame([(1, "a", None)], "lr_idx int, lr_no string, net_wt string"), ["lr_idx"], F.lit("LR"), F.lit(2))
    assert {(r["row"], r["col"], r.value, r.style) for r in one.collect()} == {(1, 0, "Lr No", ""), (1, 1, "a", ""), (2, 0, "Net Wt", ""), (2, 1, "", "red")}
    path = report.write_workbook([r.asDict() for r in c.collect()], str(tmp_path / "a.xlsx"))
    assert "Sr No" in zipfile.ZipFile(path).read("xl/worksheets/sheet1.xml").decode()
    assert "No data" in zipfile.ZipFile(report.write_workbook([], str(tmp_path / "b.xlsx"))).read("xl/worksheets/sheet1.xml").decode()


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "in/b.pdf").write_bytes(b"nope")
    (tmp_path / "in/c.txt").write_bytes(b"%PDF-")
    good, bad = sources.documents(spark, str(tmp_path / "in"))
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["content", "extension"]
    assert sources.rendered_pages(good, lambda b: [b, b]).count() == 2
    cells(spark, [["a"]]).write.parquet(str(tmp_path / "t/cells"))
    assert sources.TableProvider(spark, str(tmp_path / "t")).cells().count() == 1
    pages = spark.createDataFrame([(1, 0), (1, 2), (1, 9)], "doc_id int, page_no int")
    roles = spark.createDataFrame([("form", 0, 0), ("bill", 1, 2)], "role string, first_page int, last_page int")
    with_roles = tables.page_roles(pages, roles)
    assert [r.role for r in with_roles.orderBy("page_no").collect()] == ["form", "bill", None]
    assert tables.layout_warnings(with_roles).first().warnings == ["no_lr_pages"]
