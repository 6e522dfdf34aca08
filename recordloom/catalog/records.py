"""Queries of normalisation, reconciliation and validation over the derived bills and receipts."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.catalog import duck as D
from recordloom.functions import text as X
from recordloom.operators import records as R
from recordloom.operators import report as P
from recordloom.operators import workbook as W
from recordloom.plans import derive

MATCHES = ("shipment_match", "vehicle_match", "date_match", "weight_match", "amount_match")


def normalised(s, d):
    return R.normalise_bills(derive.bills(s, d)), R.normalise_receipts(derive.receipts(s, d))


def reconciled(s, d):
    return R.reconcile(*normalised(s, d)).withColumn("flags", F.array_join("flags", ","))


def recon_summary(s, d):
    return R.status_counts(reconciled(s, d))


def _result(*columns: str, where: str = "true"):
    return lambda s, d: reconciled(s, d).where(where).select(*columns), f"WITH {D.RECONCILED} SELECT {', '.join(columns)} FROM r WHERE {where}"


def _candidates(*columns: str, where: str):
    return lambda s, d: R.candidates(*normalised(s, d)).withColumnRenamed("repeat", "repeated").where(where).select(*columns), f"WITH {D.CANDIDATES} SELECT {', '.join(columns)} FROM w WHERE {where}"


def _normalised_columns(fields, key, vehicle):
    return [key, "lr_no_norm", "lr_no_digits", "lr_date_norm", *[f"{f}_num" for f in fields], f"{vehicle}_norm"]


BILL_COLUMNS = _normalised_columns(R.BILL_NUMBERS, "bill_idx", "vehicle_no")
RECEIPT_COLUMNS = _normalised_columns(R.RECEIPT_NUMBERS, "lr_idx", "truck_no")
CHECKS = D.flags(
    ("amount_mismatch", f"coalesce(abs({D.to_float('gross_qty')} * {D.to_float('rate')} - {D.to_float('amount')}) > 0.02 * abs({D.to_float('amount')}), false)"),
    ("lr_date_invalid", f"lr_date IS NOT NULL AND NOT ({D.strip('lr_date')} <> '' AND {D.date_ok('lr_date')})"),
    ("delivery_date_invalid", f"delivery_date IS NOT NULL AND NOT regexp_full_match({D.strip('delivery_date')}, '(?i)[0-9]{{1,2}} \\w{{3}} [0-9]{{2}} [0-9]{{2}}:[0-9]{{2}} (am|pm)')"),
    ("rate_invalid", f"rate IS NOT NULL AND NOT {D.amount_ok('rate')}"),
    ("amount_invalid", f"amount IS NOT NULL AND NOT {D.amount_ok('amount')}"),
    ("vehicle_no_invalid", f"vehicle_no IS NOT NULL AND NOT regexp_full_match({D.strip('vehicle_no')}, '[A-Za-z0-9]+')"),
)

def _totals(s, d):
    """Three batches: a total far off, one stated as so much a row, and one that cannot be read."""
    b = derive.bills(s, d)
    part = lambda k: b.where(F.col("bill_idx") % 3 == k)
    near = F.concat(F.lit("Rs "), (F.count("*") * 150000).cast("string"))
    first, last = R.batch_total(part(0), "1,000.00"), R.batch_total(part(2), "n.a.")
    return first.unionByName(R.batch_total(part(1), part(1).agg(near.alias("t")).first()[0])).unionByName(last)


QUERIES = {
    "bill_normalise": (lambda s, d: normalised(s, d)[0].select(*BILL_COLUMNS), f"WITH {D.NORM_BILLS} SELECT {', '.join(BILL_COLUMNS)} FROM nb"),
    "lr_normalise": (lambda s, d: normalised(s, d)[1].select(*RECEIPT_COLUMNS), f"WITH {D.NORM_RECEIPTS} SELECT {', '.join(RECEIPT_COLUMNS)} FROM nr"),
    "parse_warnings": (
        lambda s, d: normalised(s, d)[0].selectExpr("'bill' AS side", "bill_idx AS idx", "array_join(parse_warnings, ',') AS warned").union(normalised(s, d)[1].selectExpr("'lr'", "lr_idx", "array_join(parse_warnings, ',')")),
        f"WITH {D.NORM_BILLS}, {D.NORM_RECEIPTS} SELECT 'bill' AS side, bill_idx AS idx, warned FROM nb UNION ALL SELECT 'lr', lr_idx, warned FROM nr",
    ),
    "recon_primary_join": _candidates("bill_idx", "lr_idx", where="lr_idx is not null and not by_digits"),
    "recon_fallback_join": _candidates("bill_idx", "lr_idx", "lr_no_digits", where="by_digits"),
    "recon_ambiguous": _candidates("bill_idx", "lr_idx", "n_candidates", where="n_candidates > 1"),
    "recon_duplicates": _candidates("bill_idx", "lr_idx", where="repeated"),
    "recon_missing_lr": _result("bill_idx", "lr_no", "category", where="status = 'missing_lr'"),
    "recon_unbilled": _result("lr_idx", "lr_no", "flags", where="section = 1"),
    "recon_matches": _result("bill_idx", "lr_idx", *MATCHES, where="section = 0"),
    "recon_diffs": _result("bill_idx", "net_wt_diff", "amount_diff", where="section = 0"),
    "recon_status": _result("section", "bill_idx", "lr_idx", "category", "status"),
    "recon_flags": _result("section", "bill_idx", "lr_idx", "flags"),
    "reconcile_full": _result("section", "bill_idx", "lr_idx", "lr_no", "category", "status", *MATCHES, "net_wt_diff", "amount_diff", "flags"),
    "recon_summary": (recon_summary, f"WITH {D.RECONCILED} SELECT status, count(*) AS n FROM r GROUP BY status"),
    "validate_row": (lambda s, d: R.validate_bills(derive.bills(s, d)).select("bill_idx", F.array_join("validation_flags", ",").alias("flags")), f"WITH {D.BILLS} SELECT bill_idx, {CHECKS} AS flags FROM bills"),
    "amount_mismatch": (
        lambda s, d: R.validate_bills(derive.bills(s, d)).select("bill_idx", F.array_contains("validation_flags", "amount_mismatch").alias("wrong")),
        f"WITH {D.BILLS} SELECT bill_idx, coalesce(abs({D.to_float('gross_qty')} * {D.to_float('rate')} - {D.to_float('amount')}) > 0.02 * abs({D.to_float('amount')}), false) AS wrong FROM bills",
    ),
    "strict_fields": (
        lambda s, d: R.strict_bills(derive.bills(s, d)).select("bill_idx", "amount", "gross_qty", F.array_join("field_flags", ",").alias("flags")),
        f"WITH {D.BILLS} SELECT bill_idx, CASE WHEN {D.amount_ok('amount')} THEN amount END AS amount, gross_qty, "
        + D.flags(("shipment_no_invalid", "true"), ("lr_date_invalid", f"NOT ({D.strip('lr_date')} <> '' AND {D.date_ok('lr_date')})"), ("amount_invalid", f"NOT {D.amount_ok('amount')}")) + " AS flags FROM bills",
    ),
    "batch_total": (
        lambda s, d: _totals(s, d),
        f"""WITH {D.BILLS}, b AS (SELECT bill_idx % 3 AS part, {D.to_float('amount')} AS a FROM bills), t AS (SELECT part, count(*) AS n_rows, round(sum(a), 2) AS computed_total FROM b GROUP BY part)
SELECT n_rows, computed_total, stated_total, round(computed_total - stated_total, 2) AS difference, coalesce(abs(round(computed_total - stated_total, 2)) > 1.0 * n_rows, true) AS flagged
FROM (SELECT *, CASE part WHEN 0 THEN 1000.0 WHEN 1 THEN n_rows * 150000.0 END::DOUBLE AS stated_total FROM t)""",
    ),
    "sheet_names": (
        lambda s, d: P.sheet_names(derive.receipts(s, d)).select("lr_idx", "sheet"),
        f"WITH {D.RECEIPTS}, b AS (SELECT lr_idx, CASE WHEN t = '' THEN concat('LR_page_', lr_idx) ELSE concat('LR_', t) END AS base FROM (SELECT lr_idx, regexp_replace(lr_no, '^0+', '') t FROM receipts)) "
        "SELECT lr_idx, CASE WHEN n = 1 THEN base ELSE concat(base, '_', n) END AS sheet FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY lr_idx) n FROM b)",
    ),
    "field_value_unpivot": (
        lambda s, d: P.field_values(derive.receipts(s, d).select("lr_idx", "lr_no", "amount", "net_wt"), ["lr_idx"]),
        f"WITH {D.RECEIPTS} SELECT lr_idx, CAST(0 AS INTEGER) AS field_no, 'Lr No' AS field, lr_no AS value, lr_no IS NULL AS missing FROM receipts UNION ALL SELECT lr_idx, 1, 'Amount', amount, amount IS NULL FROM receipts UNION ALL SELECT lr_idx, 2, 'Net Wt', net_wt, net_wt IS NULL FROM receipts",
    ),
    "column_union": (
        lambda s, d: P.union_of_columns(derive.bills(s, d).select("bill_idx", "lr_no"), derive.receipts(s, d).select("lr_no", "net_wt")),
        f"WITH {D.BILLS}, {D.RECEIPTS} SELECT bill_idx, lr_no, CAST(NULL AS VARCHAR) AS net_wt FROM bills UNION ALL SELECT NULL, lr_no, net_wt FROM receipts",
    ),
    "missing_fields": (
        lambda s, d: P.field_values(derive.bills(s, d), ["bill_idx"]).where("missing").groupBy("field").agg(F.count("*").alias("n")),
        f"WITH {D.BILLS} SELECT 'Delivery Date' AS field, count(*) AS n FROM bills WHERE delivery_date IS NULL",
    ),
    "report_cells": (
        lambda s, d: P.bill_cells(_fields(s, d)),
        f"WITH {D.BILLS}, t AS (SELECT *, bill_idx + 1 AS rn, CASE WHEN bill_idx % 3 = 0 THEN 'yellow' ELSE '' END AS style FROM bills) SELECT CAST(1 AS INTEGER) AS sheet_ord, 'Bill' AS sheet, rn AS \"row\", CAST(0 AS INTEGER) AS col, lr_no AS value, style FROM t UNION ALL SELECT 1, 'Bill', rn, 1, amount, style FROM t "
        "UNION ALL SELECT 1, 'Bill', 0, 0, 'Lr No', 'header' UNION ALL SELECT 1, 'Bill', 0, 1, 'Amount', 'header'",
    ),
    "invoice_sheet": (
        lambda s, d: W.form_cells(_form(s, d), ("page 2 has no rows",)),
        f"WITH {D.BILLS}, t AS (SELECT count(*) AS n, max(lr_no) AS last FROM bills) SELECT CAST(0 AS INTEGER) AS sheet_ord, 'Invoice' AS sheet, CAST(0 AS INTEGER) AS \"row\", CAST(0 AS INTEGER) AS col, 'WARNING: page 2 has no rows' AS value, 'warning' AS style "
        "UNION ALL SELECT 0, 'Invoice', 1, 0, 'Bill Rows', 'header' UNION ALL SELECT 0, 'Invoice', 1, 1, 'Last No', 'header' UNION ALL SELECT 0, 'Invoice', 1, 2, 'Remark', 'header' "
        "UNION ALL SELECT 0, 'Invoice', 2, 0, CAST(n AS VARCHAR), '' FROM t UNION ALL SELECT 0, 'Invoice', 2, 1, last, '' FROM t UNION ALL SELECT 0, 'Invoice', 2, 2, '', 'red'",
    ),
    "bill_sheet": (
        lambda s, d: W.section_cells(_fields(s, d), _form(s, d).select("bill_rows", "last_no")),
        f"WITH {D.BILLS}, h AS (SELECT count(*) AS n, max(lr_no) AS last FROM bills), t AS (SELECT *, CAST(bill_idx + 5 AS BIGINT) AS rn, CASE WHEN bill_idx % 3 = 0 THEN 'yellow' ELSE '' END AS style FROM bills) "
        "SELECT CAST(1 AS INTEGER) AS sheet_ord, 'Bill' AS sheet, rn AS \"row\", CAST(0 AS INTEGER) AS col, coalesce(lr_no, '') AS value, style FROM t UNION ALL SELECT 1, 'Bill', rn, 1, coalesce(amount, ''), style FROM t "
        "UNION ALL SELECT 1, 'Bill', 4, 0, 'Lr No', 'header' UNION ALL SELECT 1, 'Bill', 4, 1, 'Amount', 'header' UNION ALL SELECT 1, 'Bill', 0, 0, 'Field', 'title' UNION ALL SELECT 1, 'Bill', 0, 1, 'Value', 'title' "
        "UNION ALL SELECT 1, 'Bill', 1, 0, 'Bill Rows', 'blue' UNION ALL SELECT 1, 'Bill', 1, 1, CAST(n AS VARCHAR), 'blue' FROM h UNION ALL SELECT 1, 'Bill', 2, 0, 'Last No', 'blue' UNION ALL SELECT 1, 'Bill', 2, 1, last, 'blue' FROM h",
    ),
    "receipt_sheets": (
        lambda s, d: W.receipt_cells(derive.receipts(s, d).select("lr_idx", "lr_no", "net_wt")),
        f"WITH {D.RECEIPTS}, b AS (SELECT *, CASE WHEN regexp_replace(lr_no, '^0+', '') = '' THEN concat('LR_page_', lr_idx) ELSE concat('LR_', regexp_replace(lr_no, '^0+', '')) END AS base FROM receipts), "
        "t AS (SELECT *, CASE WHEN n = 1 THEN base ELSE concat(base, '_', n) END AS sheet, CASE WHEN lr_no = '' THEN 1 ELSE 0 END AS \"at\" FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY lr_idx) n FROM b)), "
        "c AS (SELECT lr_idx, sheet, 0 AS \"row\", 0 AS col, '" + W.NO_NUMBER + "' AS value, 'banner' AS style FROM t WHERE \"at\" = 1 UNION ALL SELECT lr_idx, sheet, \"at\", 0, 'Field', 'title' FROM t UNION ALL SELECT lr_idx, sheet, \"at\", 1, 'Value', 'title' FROM t "
        "UNION ALL SELECT lr_idx, sheet, \"at\" + 1, 0, 'Lr No', '' FROM t UNION ALL SELECT lr_idx, sheet, \"at\" + 1, 1, coalesce(lr_no, ''), '' FROM t UNION ALL SELECT lr_idx, sheet, \"at\" + 2, 0, 'Net Wt', '' FROM t UNION ALL SELECT lr_idx, sheet, \"at\" + 2, 1, coalesce(net_wt, ''), '' FROM t) "
        "SELECT lr_idx + 3 AS sheet_ord, sheet, CAST(\"row\" AS INTEGER) AS \"row\", CAST(col AS INTEGER) AS col, value, style FROM c",
    ),
    "column_widths": (
        lambda s, d: P.column_widths(P.bill_cells(_fields(s, d))),
        f"WITH {D.BILLS} SELECT 'Bill' AS sheet, CAST(0 AS INTEGER) AS col, CAST(least(greatest(max(len(lr_no)), 5) + 2, 50) AS INTEGER) AS width FROM bills UNION ALL SELECT 'Bill', 1, CAST(least(greatest(max(len(amount)), 6) + 2, 50) AS INTEGER) FROM bills",
    ),
}


def _fields(s, d):
    b = derive.bills(s, d)
    fields = F.create_map(F.lit("lr_no"), "lr_no", F.lit("amount"), "amount", F.lit("validation_flags"), F.when(F.col("bill_idx") % 3 == 0, "x").otherwise(""))
    return b.select(F.col("bill_idx").alias("row_idx"), fields.alias("fields"))


def _form(s, d):
    return derive.bills(s, d).agg(F.count("*").alias("bill_rows"), F.max("lr_no").alias("last_no"), F.lit(None).cast("string").alias("remark"))
