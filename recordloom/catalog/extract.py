"""Queries of the composite extractors. Their fuzzy matching has no SQL; tests hold them against small cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.catalog import duck as D
from recordloom.catalog.tables import captions
from recordloom.operators import zones
from recordloom.plans import derive, extract


def captioned(s, d):
    """The derived tables with their captions as row 0."""
    head = captions(s, d).select("table_id", F.lit(0).cast("int").alias("row_idx"), "col_idx", F.col("caption").alias("text"))
    return derive.cells(s, d).unionByName(head)


def _fields(rows):
    return rows.select("table_id", "row_idx", F.explode("fields").alias("name", "value"))


def _pairs(s, d):
    r = derive.receipts(s, d)
    names = ("lr_no", "lr_date", "shipment_no", "truck_no", "net_wt", "amount")
    entries = F.array(*[F.struct(F.lit(k).alias("idx"), F.lit(n.title()).alias("key"), F.col(n).alias("value")) for k, n in enumerate(names)])
    return r.select(F.col("lr_idx").alias("doc_id"), F.lit(0).alias("page_no"), F.explode(entries).alias("e")).select("doc_id", "page_no", "e.*")


def _zoned(s, d):
    """Short keys that mean something in one zone only."""
    r = derive.receipts(s, d)
    keys = (("zone1", "From", "lr_no"), ("zone1", "To", "lr_date"), ("zone3", "Route", "shipment_no"), ("zone3", "From", "truck_no"), ("zone2", "To", "amount"))
    entries = F.array(*[F.struct(F.lit(k).alias("idx"), F.lit(z).alias("zone"), F.lit(n).alias("key"), F.col(v).alias("value")) for k, (z, n, v) in enumerate(keys)])
    return r.select(F.col("lr_idx").alias("doc_id"), F.lit(0).alias("page_no"), F.explode(entries).alias("e")).select("doc_id", "page_no", "e.*")


def _cover(s, d):
    c = derive.table(s, d, "customer")
    entries = F.array(*[F.struct(F.lit(k).alias("idx"), F.lit(label).alias("label"), F.expr(v).alias("value")) for k, (label, v) in enumerate((("* Vendor Name", "c_name"), ("PO Number :", "concat('4500', c_custkey, ' A')"), ("Invoice Amount", "concat(c_custkey % 90 + 10, ',', 100 + c_custkey % 900, ' /-')")))])
    return c.select(F.col("c_custkey").alias("doc_id"), F.explode(entries).alias("e")).select("doc_id", "e.*")


def _kinds(s, d):
    """Labels and values of every kind that is kept or goes."""
    return derive.table(s, d, "orders").selectExpr(
        "o_orderkey AS doc_id", "CASE o_orderkey % 9 WHEN 1 THEN 'Unmatched_Text_1_20' WHEN 2 THEN 'Stamp_Ok' WHEN 3 THEN 'One_Two_Three_Four_Five_Six' WHEN 4 THEN 'One_Two_Three_Four_Five' ELSE concat('Key_', o_orderkey % 7) END AS key",
        "CASE o_orderkey % 8 WHEN 0 THEN concat('v', o_orderkey) WHEN 1 THEN '37' WHEN 2 THEN 'x' WHEN 3 THEN 'ab' WHEN 4 THEN repeat('word ', 20) WHEN 5 THEN repeat('word ', 21) WHEN 6 THEN 'First. Then 1.5 more.' ELSE 'one end.' END AS value",
    )


def _refined(s, d):
    """receipts' numbers filled up from the bills of the same index, and shipments overridden by theirs."""
    r = derive.receipts(s, d).selectExpr("lr_idx AS k", "nullif(lr_no, '') AS lr_no", "shipment_no")
    b = derive.bills(s, d).selectExpr("bill_idx AS k", "nullif(lr_no, '') AS lr_no", "nullif(shipment_no, '') AS shipment_no")
    return zones.refined(zones.refined(r, b, ["k"], "lr_no"), b, ["k"], "shipment_no", override=True)


QUERIES = {
    "bill_extract": (lambda s, d: _fields(extract.bill_rows(captioned(s, d))), None),
    "tax_invoice_extract": (lambda s, d: _fields(extract.tax_invoice_rows(captioned(s, d))), None),
    "cover_extract": (
        lambda s, d: extract.cover_records(_cover(s, d)),
        "SELECT c_custkey AS doc_id, c_name AS vendor_name, CAST(NULL AS VARCHAR) AS vendor_code, concat('4500', c_custkey) AS po_number, CAST(NULL AS VARCHAR) AS grn_srn_number, CAST(NULL AS VARCHAR) AS invoice_number, CAST(NULL AS VARCHAR) AS invoice_date, CAST(NULL AS VARCHAR) AS penalty_amount, concat(c_custkey % 90 + 10, ',', 100 + c_custkey % 900, '/-') AS invoice_amount, CAST(NULL AS VARCHAR) AS barcode_number FROM customer",
    ),
    "receipt_extract": (
        lambda s, d: extract.receipt_records(_pairs(s, d)).select("doc_id", "page_no", "lr_no", "lr_date", "shipment_no", "truck_no", "amount"),
        f"WITH {D.RECEIPTS} SELECT lr_idx AS doc_id, CAST(0 AS INTEGER) AS page_no, lr_no, lr_date, shipment_no, truck_no, CAST(NULL AS VARCHAR) AS amount FROM receipts",
    ),
    "receipt_zones": (
        lambda s, d: extract.receipt_records(_zoned(s, d)).select("doc_id", "page_no", "from_origin", "to_destination", "route"),
        f"WITH {D.RECEIPTS} SELECT lr_idx AS doc_id, CAST(0 AS INTEGER) AS page_no, lr_no AS from_origin, lr_date AS to_destination, shipment_no AS route FROM receipts",
    ),
    "trusted_fields": (
        lambda s, d: extract.trusted_fields(_kinds(s, d)).select("doc_id", "key", "value"),
        """SELECT k AS doc_id, key, value FROM (SELECT o_orderkey AS k, CASE o_orderkey % 9 WHEN 1 THEN 'Unmatched_Text_1_20' WHEN 2 THEN 'Stamp_Ok' WHEN 3 THEN 'One_Two_Three_Four_Five_Six' WHEN 4 THEN 'One_Two_Three_Four_Five' ELSE concat('Key_', o_orderkey % 7) END AS key,
  CASE o_orderkey % 8 WHEN 0 THEN concat('v', o_orderkey) WHEN 1 THEN '37' WHEN 2 THEN 'x' WHEN 3 THEN 'ab' WHEN 4 THEN repeat('word ', 20) WHEN 5 THEN repeat('word ', 21) WHEN 6 THEN 'First. Then 1.5 more.' ELSE 'one end.' END AS value FROM orders)
WHERE k % 9 NOT IN (1, 2, 3) AND k % 8 NOT IN (2, 3, 5, 6)""",
    ),
    "shaped_values": (
        lambda s, d: derive.receipts(s, d).select("lr_idx", extract.shaped("lr_no", r"^[A-Z]{0,3}[0-9]{7,12}$").alias("lr_no"), extract.shaped("truck_no", r"^[A-Z]{2}[0-9]{2}[A-Z]{2}[0-9]{4}$").alias("truck_no"), extract.shaped("amount", "^[0-9]{6,}$").alias("amount")),
        f"WITH {D.RECEIPTS}, j AS (SELECT lr_idx, " + ", ".join(f"{c}, upper(regexp_replace({c}, '[^A-Za-z0-9]', '', 'g')) AS {c}_j" for c in ("lr_no", "truck_no", "amount")) + " FROM receipts) SELECT lr_idx, CASE WHEN regexp_matches(lr_no_j, '^[A-Z]{0,3}[0-9]{7,12}$') THEN lr_no END AS lr_no, CASE WHEN regexp_matches(truck_no_j, '^[A-Z]{2}[0-9]{2}[A-Z]{2}[0-9]{4}$') THEN truck_no END AS truck_no, CASE WHEN regexp_matches(amount_j, '^[0-9]{6,}$') THEN amount END AS amount FROM j",
    ),
    "refined_fields": (
        lambda s, d: _refined(s, d),
        f"WITH {D.RECEIPTS}, {D.BILLS}, r AS (SELECT lr_idx AS k, nullif(lr_no, '') AS lr_no, shipment_no FROM receipts), b AS (SELECT bill_idx AS k, nullif(lr_no, '') AS lr_no, nullif(shipment_no, '') AS shipment_no FROM bills) SELECT r.k, coalesce(r.lr_no, b.lr_no) AS lr_no, coalesce(b.shipment_no, r.shipment_no) AS shipment_no FROM r LEFT JOIN b ON r.k = b.k",
    ),
    "public_jobs": (
        lambda s, d: extract.public_jobs(derive.table(s, d, "orders").selectExpr("o_orderkey AS job_id", "o_orderstatus AS status", "concat('/in/', o_orderkey) AS combined_path", "'p' AS bill_image_path", "array(o_clerk) AS bill_ocr" if "o_clerk" in derive.table(s, d, "orders").columns else "array(o_orderstatus) AS bill_ocr")),
        "SELECT o_orderkey AS job_id, o_orderstatus AS status FROM orders",
    ),
}
