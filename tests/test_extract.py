"""Composite extractors."""

from pyspark.sql import functions as F

from recordloom.plans import extract
from tests.test_tables import cells


def test_bill_and_tax_invoice(spark):
    head = ["S-NO", "LR NO", "Vehicle No", "Invoice Qty", "Rate", "Amount"]
    rows = [["", "", "05.05.2026", "", "", ""], head] + [[str(i + 1), str(8400001 + i), f"MH12AB{i}", f"{30 + i}.50", "10.25", f"{(30.5 + i) * 10.25:.2f}"] for i in range(5)] + [["Total", "", "", "", "", "1.00"], ["", "sum", "", "", "", ""]]
    c = cells(spark, rows)
    got = extract.bill_rows(c).orderBy("row_idx").collect()
    assert [r.fields["sr_no"] for r in got] == ["1", "2", "3", "4", "5"]
    assert set(got[0].fields) == {"sr_no", "lr_no", "vehicle_no", "gross_qty", "rate", "amount"} and got[0].fields["amount"] == "312.62"
    assert extract.tax_invoice_rows(c).count() == 5
    names = spark.createDataFrame([(1, k, n) for k, n in enumerate(["sr_no", "a", "b", "c", "d", "e"])], "table_id long, col_idx int, name string")
    assert set(extract.bill_rows(c, names).first().fields) == {"sr_no", "a", "b", "c", "d", "e"}


def test_cells_of_a_table_are_read_once_for_all_its_steps(spark):
    head = ["S NO", "LR NO", "Rate"]
    c = cells(spark, [head] + [[str(i + 1), str(8400001 + i), "10.25"] for i in range(6)])
    times = spark.sparkContext.accumulator(0)

    def told(batches):
        for b in batches:
            times.add(b.num_rows)
            yield b

    n = c.count()
    assert extract.bill_rows(c.mapInArrow(told, c.schema)).count() == 6
    assert times.value <= 2 * n  # for the caption row, and for the rows that have it


def test_cover_and_receipt(spark):
    p = spark.createDataFrame([(1, 0, "Vendor Name *", "| Acme Ltd."), (1, 1, "PO Number", "4500237065 A"), (1, 2, "Invoice Date", "on 10.06.2026"), (1, 3, "zzz", "q")], "doc_id long, idx int, label string, value string")
    r = extract.cover_records(p, spark.createDataFrame([(1, "x strhpo6x260001146")], "doc_id long, text string")).first()
    assert (r.vendor_name, r.po_number, r.invoice_date, r.invoice_amount, r.barcode_number) == ("Acme Ltd", "4500237065", "10.06.2026", None, "STRHPO6X260001146")
    p = spark.createDataFrame([(1, 0, 0, "Lr_No", "7"), (1, 0, 1, "Truck_No", "MH"), (1, 0, 2, "Other", "z")], "doc_id long, page_no int, idx int, key string, value string")
    w = spark.createDataFrame([(1, 0, ["1", "2", "3", "4"])], "doc_id long, page_no int, cells array<string>")
    r = extract.receipt_records(p, weights=w).first()
    assert (r.lr_no, r.truck_no, r.lorry_tare_wt, r.gross_wt, r.amount, r.customer_seal_present) == ("7", "MH", "1", "3", None, None)
    assert len(r) == 26


def test_trusted_fields(spark):
    rows = [("State", "37"), ("Unmatched_Text_1_2", "abc"), ("Stamp_X", "abc"), ("A_B_C_D_E_F", "abc"), ("K", "."), ("L", "x" + " y" * 21), ("M", "One. Two."), ("Date", "13.05.2026")]
    f = spark.createDataFrame(rows, "key string, value string")
    assert sorted(r.key for r in extract.trusted_fields(f).collect()) == ["Date", "State"]
    assert f.select(extract.shaped(F.lit("MH-12 ab"), "^[A-Z]{2}[0-9]{2}[A-Z]{2}$")).first()[0] == "MH-12 ab"
