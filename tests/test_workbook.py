import zipfile

from pyspark.sql import functions as F

from recordloom.operators import report, workbook

FORM = "vendor string, invoice_date string, column_numbers array<string>"


def placed(cells):
    return {(r.sheet, r["row"], r["col"]): (r.value, r.style) for r in cells.collect()}


def test_whole_report(spark, tmp_path):
    form = spark.createDataFrame([("ACME", None, ["1", "2"])], FORM)
    rows = spark.createDataFrame([(0, {"sr_no": "1", "amount": "5", "validation_flags": ""}), (1, {"sr_no": "2", "raw": "x", "validation_flags": "bad"})], "row_idx int, fields map<string,string>")
    lrs = spark.createDataFrame([(1, "0000001350", "41"), (2, None, None)], "lr_idx int, lr_no string, net_wt string")
    none = rows.where("row_idx > 5")
    cells = workbook.report_cells(form, rows, form.select("vendor"), none, form.select("vendor"), lrs, ("no total",))
    got = placed(cells)
    assert got["Invoice", 0, 0] == ("WARNING: no total", "warning") and got["Invoice", 1, 1] == ("Invoice Date", "header")
    assert [got["Invoice", 2, k] for k in range(3)] == [("ACME", ""), ("", "red"), ("1, 2", "")]
    assert got["Bill", 0, 0] == ("Field", "title") and got["Bill", 1, 1] == ("ACME", "blue") and ("Bill", 2, 0) not in got
    assert [got["Bill", 3, k][0] for k in range(3)] == ["Sr No", "Amount", "Raw"] and got["Bill", 5, 1] == ("", "yellow")
    assert not any(s == "Tax Invoice" for s, _, _ in got)
    assert got["LR_1350", 0, 1] == ("Value", "title") and got["LR_1350", 2, 1] == ("41", "")
    assert got["LR_page_2", 0, 0] == (workbook.NO_NUMBER, "banner") and got["LR_page_2", 1, 0] == ("Field", "title") and got["LR_page_2", 3, 1] == ("", "")
    with zipfile.ZipFile(report.write_workbook([r.asDict() for r in cells.collect()], str(tmp_path / "new" / "a.xlsx"))) as z:
        assert [z.read("xl/workbook.xml").decode().index(f'"{n}"') for n in ("Invoice", "Bill", "LR_1350", "LR_page_2")] == sorted(z.read("xl/workbook.xml").decode().index(f'"{n}"') for n in ("Invoice", "Bill", "LR_1350", "LR_page_2"))
        bill, last = z.read("xl/worksheets/sheet2.xml").decode(), z.read("xl/worksheets/sheet4.xml").decode()
    assert 'ySplit="4"' in bill and '<c r="A2" s="3"' in bill and 'mergeCell ref="A1:B1"' in last and "pane" not in last


def test_empty_parts_say_so(spark):
    form, rows = spark.createDataFrame([], FORM), spark.createDataFrame([], "row_idx int, fields map<string,string>")
    assert placed(workbook.form_cells(form)) == {("Invoice", 0, 0): (workbook.NO_FORM, "")}
    got = placed(workbook.section_cells(rows))
    assert got == {("Bill", 0, 0): ("Field", "title"), ("Bill", 0, 1): ("Value", "title"), ("Bill", 2, 0): (workbook.NO_ROWS, "")}
    one = rows.sparkSession.createDataFrame([(0, {"a": "1"})], rows.schema)
    assert placed(workbook.section_cells(one, None, "Tax Invoice", 2, optional=True))["Tax Invoice", 3, 0] == ("1", "")
    assert workbook.receipt_cells(spark.createDataFrame([], "lr_idx int, lr_no string")).where(F.lit(True)).count() == 0
