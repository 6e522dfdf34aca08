"""Normalisation, reconciliation and validation: the golden scenario, edges, and streams."""

from recordloom.operators import records as R
from recordloom.plans import pipeline
from recordloom.streaming import batches

BILL = "bill_idx long, lr_no string, shipment_no string, lr_date string, vehicle_no string, gross_qty string, charge_qty string, rate string, amount string"
LR = "lr_idx long, lr_no string, shipment_no string, lr_date string, truck_no string, net_wt string, gross_wt string, lorry_tare_wt string, amount string"


def bill(i, lr_no, **kw):
    row = {"shipment_no": "SHP1", "lr_date": "05.09.2026", "vehicle_no": "MH 12 AB 1234", "gross_qty": "1200", "charge_qty": "1200", "rate": "8.5", "amount": "10200"} | kw
    return (i, lr_no, *row.values())


def lr(i, lr_no, **kw):
    row = {"shipment_no": "SHP1", "lr_date": "5-9-2026", "truck_no": "MH-12-AB-1234", "net_wt": "1200 KG", "gross_wt": "2000", "lorry_tare_wt": "800", "amount": "10,200.00"} | kw
    return (i, lr_no, *row.values())


def reconcile(spark, bills, lrs):
    b, r = spark.createDataFrame(bills, BILL), spark.createDataFrame(lrs, LR)
    return R.ordered(R.reconcile(R.normalise_bills(b), R.normalise_receipts(r))).collect()


def test_good_and_bad_rows(spark):
    good = ("L848501350", "S", "05.09.2026", "MH 12 AB 1234", "1,200 MT", "1250", "8.50", "RS. 10,625.00")
    bad = ("0000001350", "S", "31/02/2026", None, "eight hundred", "", "12.00", "9,600.00")
    a, b = R.normalise_bills(spark.createDataFrame([(1, *good), (2, *bad)], BILL)).orderBy("bill_idx").collect()
    assert (a.lr_no_norm, a.lr_no_digits, a.lr_date_norm, a.gross_qty_num, a.charge_qty_num, a.rate_num, a.amount_num, a.vehicle_no_norm, a.parse_warnings) == ("848501350", "8501350", "2026-09-05", 1200.0, 1250.0, 8.5, 10625.0, "MH12AB1234", [])
    assert (b.lr_no_norm, b.lr_date_norm, b.gross_qty_num, b.charge_qty_num, b.parse_warnings) == ("1350", "31/02/2026", None, None, ["lr_date", "gross_qty"])
    rec = R.normalise_receipts(spark.createDataFrame([(1, "LR 0848501350", "S", "5-9-2026", "MH-12-AB-1234", "12,000 KG", "20500", "8,500 KG", "INR 98,750.00")], LR)).first()
    assert (rec.lr_no_norm, rec.lr_date_norm, rec.net_wt_num, rec.gross_wt_num, rec.lorry_tare_wt_num, rec.amount_num, rec.truck_no_norm) == ("848501350", "2026-09-05", 12000.0, 20500.0, 8500.0, 98750.0, "MH12AB1234")


def test_golden_scenario(spark):
    bills = [bill(0, "L848501350"), bill(1, "L99848501351", gross_qty="700", amount="8200"), bill(2, "L999999999"), bill(3, "848501352", gross_qty="1199.996", amount="10199.3"), bill(4, "848501353"), bill(5, "")]
    lrs = [lr(0, "0000848501350"), lr(1, "8501351"), lr(2, "848501352"), lr(3, "848501353", amount="unreadable"), lr(4, "848509999")]
    got = reconcile(spark, bills, lrs)
    assert [(r.category, r.status) for r in got] == [("A", "clear"), ("A", "mismatch"), ("B", "missing_lr"), ("A", "clear"), ("A", "clear"), ("B", "missing_lr"), ("C", "unbilled")]
    assert [r.flags for r in got] == [[], ["lr_no_fuzzy_matched"], [], [], ["unverified_fields", "lr_parse_warnings"], ["bill_lr_no_missing"], []]
    assert (got[0].net_wt_diff, got[0].amount_diff, got[1].net_wt_diff, got[1].amount_diff, got[3].net_wt_diff, got[3].amount_diff) == (0.0, 0.0, -500.0, -2000.0, -0.004, -0.7)
    assert got[1].vehicle_match and got[4].amount_match is None and got[2].shipment_match is None


def test_duplicates_and_twins(spark):
    got = reconcile(spark, [bill(0, "848501350"), bill(1, "848501350")], [lr(0, "848501350")])
    assert [(r.category, r.flags) for r in got] == [("A", []), ("A", ["duplicate_bill_for_lr"])]
    got = reconcile(spark, [bill(0, "848501350")], [lr(0, "848501350"), lr(1, "0848501350")])
    assert [(r.category, r.lr_idx, r.flags) for r in got] == [("A", 0, ["ambiguous_lr_match"]), ("C", 1, [])]


def test_tolerances(spark):
    got = reconcile(spark, [bill(0, "1", gross_qty="100.01", amount="501"), bill(1, "2", gross_qty="100.02", amount="502")], [lr(0, "1", net_wt="100", amount="500"), lr(1, "2", net_wt="100", amount="500")])
    assert [(r.weight_match, r.amount_match) for r in got] == [(True, True), (False, False)]


def test_empty_sides(spark):
    assert reconcile(spark, [], []) == []
    assert [r.status for r in reconcile(spark, [bill(0, "1")], [])] == ["missing_lr"]
    assert [(r.status, r.flags) for r in reconcile(spark, [], [lr(0, "", amount="x")])] == [("unbilled", ["lr_lr_no_missing", "lr_parse_warnings"])]


def test_validation(spark):
    rows = [bill(0, "1", gross_qty="2", rate="10", amount="20"), bill(1, "1", gross_qty="2", rate="10", amount="30", vehicle_no="MH1", lr_date=""), bill(2, "1", vehicle_no=None, lr_date=None, rate=None, amount="RS. 1.00")]
    got = [r.validation_flags for r in R.validate_bills(spark.createDataFrame(rows, BILL)).orderBy("bill_idx").collect()]
    assert got == [["vehicle_no_invalid"], ["amount_mismatch", "lr_date_invalid"], ["amount_invalid"]]
    strict = R.strict_bills(spark.createDataFrame(rows, BILL)).orderBy("bill_idx").collect()
    assert strict[1].lr_date is None and "lr_date_invalid" in strict[1].field_flags and strict[2].amount is None


def test_batch_total(spark):
    rows = spark.createDataFrame([("10.00",), ("20.01",), ("x",)], "amount string")
    t = R.batch_total(rows, "30.00").first()
    assert (t.n_rows, t.computed_total, t.stated_total, t.difference, t.flagged) == (3, 30.01, 30.0, 0.01, False)
    assert R.batch_total(rows, None).first().flagged and R.batch_total(rows.where("false"), "1").first().flagged


def test_pipeline_and_invariants(spark):
    from recordloom.plans import derive

    d = "/root/testdata/sf0.001"
    out = pipeline.run(derive.bills(spark, d), derive.receipts(spark, d))
    rows = out.result.select("section", "bill_idx", "lr_idx", "category").collect()
    n_bills, lrs = out.bills.count(), {r.lr_idx for r in out.receipts.select("lr_idx").collect()}
    used = {r.lr_idx for r in rows if r.category == "A"}
    assert len(rows) == n_bills + len(lrs - used)
    assert {r.lr_idx for r in rows if r.category == "C"} == lrs - used
    assert sum(r.n for r in out.summary().collect()) == len(rows)


def test_stream(spark, tmp_path):
    spark.createDataFrame([bill(0, "1"), bill(1, "77")], BILL).write.parquet(str(tmp_path / "bills"))
    schema = spark.read.parquet(str(tmp_path / "bills")).schema
    receipts = R.normalise_receipts(spark.createDataFrame([lr(0, "1")], LR)).cache()
    got = []
    q = batches.reconcile_stream(batches.normalised_bills(spark, str(tmp_path / "bills"), schema), lambda: receipts, lambda df, n: got.extend(df.collect()), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert sorted((r.bill_idx, r.status) for r in got) == [(0, "clear"), (1, "missing_lr")]
