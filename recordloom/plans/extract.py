"""Extractors: whole tables, cover forms and receipts from cells and label/value pairs, composed of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text as X
from recordloom.functions import validators as V
from recordloom.operators import infer, matching, tables
from recordloom.session import written

#: The fields of a cover form and their captions.
COVER_SYNONYMS = {
    "vendor_name": ["vendor name"],
    "vendor_code": ["vendor code"],
    "po_number": ["po number", "purchase order number"],
    "grn_srn_number": ["grn / srn number", "grn/srn number", "grn srn number", "grn number", "srn number"],
    "invoice_number": ["invoice number"],
    "invoice_date": ["invoice date"],
    "penalty_amount": ["penalties any other deduction applicable", "penalties or any other deduction applicable", "penalty amount"],
    "invoice_amount": ["invoice amount incl taxes", "invoice amount"],
}
#: The fields of a receipt, in order, and the captions of those that are read beside one.
RECEIPT_FIELDS = (
    "lr_no", "lr_date", "shipment_no", "from_origin", "to_destination", "truck_no", "truck_type", "incoterm", "freight", "eway_bill_no", "mwr", "route",
    "lorry_tare_wt", "net_wt", "gross_wt", "packages", "description_of_product", "net_wt_2", "gross_wt_2", "amount",
    "text_above_transporter_stamp", "transporter_stamp_present", "customer_seal_text_handwritten", "customer_seal_present",
)
RECEIPT_SYNONYMS = {
    "lr_no": ["lr no"], "lr_date": ["lr date"], "shipment_no": ["shipment no"], "from_origin": ["from origin", "from"], "to_destination": ["to destination", "to"],
    "truck_no": ["truck no"], "truck_type": ["truck type"], "incoterm": ["incoterm"], "freight": ["freight"], "eway_bill_no": ["eway bill no", "e way bill no", "eway bill number"], "mwr": ["mwr"], "route": ["route"],
}
#: The zone of the page in which each of these is read.
RECEIPT_ZONES = {
    "zone1": ("lr_no", "lr_date", "shipment_no", "from_origin", "to_destination"), "zone2": ("truck_no", "truck_type", "incoterm", "freight", "eway_bill_no", "mwr"), "zone3": ("route",),
}
WEIGHTS = ("lorry_tare_wt", "net_wt", "gross_wt")
GOODS = ("packages", "description_of_product", "net_wt_2", "gross_wt_2", "amount")


def _named_rows(cells: DataFrame, search: int, configured: DataFrame | None, reread: DataFrame | None = None) -> DataFrame:
    """(table_id, row_idx, cells, fields) of the rows under each table's caption row, columns named from captions, content or configuration.

    With a column `carried`, rows for which it holds are named by the others: they neither have the captions nor decide what a column is. Captions that were read again
    (table_id, col_idx, caption) take the place of those in the cells.

    A row's cells meet once and are written with their table's caption row: captions, columns and fields are read of these rows, and names come to them as one map a table.
    """
    carried = "carried" in cells.columns
    entry = F.struct("col_idx", X.strip("text").alias("t"), "text")
    rows = cells.groupBy("table_id", "row_idx").agg(F.array_sort(F.collect_list(entry)).alias("_row"), *([F.max("carried").alias("carried")] if carried else []))
    rows = rows.withColumn("cells", F.transform("_row", lambda x: x["t"]))
    own = (lambda r: r.where("not carried")) if carried else (lambda r: r)
    whole = written(rows.join(tables.caption_rows(own(rows), search), "table_id"))
    long = lambda r: r.select("table_id", "row_idx", F.explode("_row").alias("x")).select("table_id", "row_idx", "x.col_idx", "x.text")
    captions = long(whole.where("row_idx = caption_row")).select("table_id", "col_idx", F.col("text").alias("caption"))
    if reread is not None:
        again = reread.select("table_id", "col_idx", F.nullif(X.strip("caption"), F.lit("")).alias("_again"))
        captions = captions.join(again, ["table_id", "col_idx"], "left").select("table_id", "col_idx", F.coalesce("_again", "caption").alias("caption"))
    body = whole.where("row_idx > caption_row")
    inferred = infer.classify_columns(long(own(body).where(tables.not_footer(F.col("cells")))), matching.match_captions(captions))
    names = infer.column_names(inferred, captions, configured).where("col_idx is not null").groupBy("table_id", "col_idx").agg(F.sort_array(F.collect_list("name")).alias("names"))
    names = names.groupBy("table_id").agg(F.map_from_entries(F.collect_list(F.struct("col_idx", "names"))).alias("_names"))
    known = lambda x: F.transform(F.coalesce(F.col("_names")[x["col_idx"]], F.array().cast("array<string>")), lambda n: F.struct(n.alias("key"), X.blank_to_null(x["text"]).alias("value")))
    named = body.join(names, "table_id").withColumn("_pairs", F.flatten(F.transform("_row", known))).where(F.size("_pairs") > 0)
    return named.select("table_id", "row_idx", "cells", F.map_from_entries("_pairs").alias("fields"))


def _serial() -> Column:
    return F.coalesce(F.col("fields")["sr_no"], F.when(~F.map_contains_key("fields", "sr_no"), F.get("cells", F.lit(0))), F.lit(""))


def bill_rows(cells: DataFrame, configured: DataFrame | None = None, captions: DataFrame | None = None) -> DataFrame:
    """(table_id, row_idx, fields) of a bill's data rows; rows run over the table's pages in order. captions: those that were read again, if any."""
    rows = _named_rows(cells, 4, configured, captions)
    return rows.where(tables.bill_data_row(_serial(), F.col("cells"))).select("table_id", "row_idx", "fields")


def tax_invoice_rows(cells: DataFrame) -> DataFrame:
    """As bill_rows with a caption among the first 15 rows, without footers and long cells, and only rows with an amount."""
    rows = _named_rows(cells, 15, None).where(tables.not_footer(F.col("cells")))
    return rows.where(tables.invoice_data_row(_serial(), F.col("cells")) & F.col("fields")["amount"].isNotNull()).select("table_id", "row_idx", "fields")


def cover_records(pairs: DataFrame, barcodes: DataFrame | None = None) -> DataFrame:
    """(doc_id and nine fields) of cover forms from their rows (doc_id, idx, label, value) and barcode texts (doc_id, text); fields not found are null."""
    wide = matching.assigned_values(pairs, ["doc_id"], COVER_SYNONYMS, X.row_label("label"), matching.CAPTION_THRESHOLD, "solid", cleaners=X.COVER_CLEANERS)
    if barcodes is None:
        return wide.withColumn("barcode_number", F.lit(None).cast("string"))
    return wide.join(barcodes.select("doc_id", X.barcode("text").alias("barcode_number")), "doc_id", "left")


def zone_fields(pairs: DataFrame) -> DataFrame:
    """(doc_id, page_no and the fields of RECEIPT_SYNONYMS) of pairs (doc_id, page_no, zone, idx, key, value), each zone's keys aliased to its own fields."""
    page = ["doc_id", "page_no"]
    text = F.lower(F.replace("key", F.lit("_"), F.lit(" ")))
    own = F.coalesce(*[F.when(F.col("zone") == z, F.array(*[F.lit(n) for n in names])) for z, names in RECEIPT_ZONES.items()])
    found = matching.assigned_values(pairs.where(F.col("zone").isin(list(RECEIPT_ZONES))), [*page, "zone"], RECEIPT_SYNONYMS, text, matching.RECORD_THRESHOLD, "alnum", own)
    return found.groupBy(*page).agg(*[F.max(n).alias(n) for n in RECEIPT_SYNONYMS])


def receipt_records(pairs: DataFrame, weights: DataFrame | None = None, goods: DataFrame | None = None, marks: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_no and the 24 fields) of receipts.

    pairs (doc_id, page_no, idx, key, value and, if they were read zone by zone, zone) are aliased to fields, each zone's keys to its own; weights and goods (doc_id, page_no, cells) are table rows read by position; marks
    (doc_id, page_no, the four of stamp and seal) come from a reader of ink. What is not found is null.
    """
    page = ["doc_id", "page_no"]
    key = F.lower(F.replace("key", F.lit("_"), F.lit(" ")))
    if "zone" in pairs.columns:
        named = zone_fields(pairs)
    else:
        named = matching.assigned_values(pairs, page, RECEIPT_SYNONYMS, key, matching.RECORD_THRESHOLD, "alnum")
    wide = pairs.select(*page).distinct().join(named, page, "left") if "zone" in pairs.columns else named
    for names, part in ((WEIGHTS, weights), (GOODS, goods)):
        if part is not None:
            first = tables.leftmost(F.col("cells"), len(names))
            wide = wide.join(part.select(*page, *[X.blank_to_null(F.get(first, F.lit(k))).alias(n) for k, n in enumerate(names)]), page, "left")
    if marks is not None:
        wide = wide.join(marks, page, "left")
    missing = {n: F.lit(None).cast("boolean" if n.endswith("_present") else "string") for n in RECEIPT_FIELDS if n not in wide.columns}
    return wide.withColumns(missing).select(*page, *RECEIPT_FIELDS)


def trusted_fields(fields: DataFrame, key: str = "key", value: str = "value", lenient: bool = False) -> DataFrame:
    """label/value pairs without leftovers and stamps, labels of more than five words, noise (fewer than three letters or digits, unless it is two and a
    plausible value) and paragraphs (more than 20 words, or two ends of sentences). `lenient` keeps labels that have no value, and drops labels that are noise."""
    size = lambda c: F.length(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "[^A-Za-z0-9]+", ""))
    noise = lambda c: (size(c) < 3) & ((size(c) < 2) | ~V.plausible_value(c))
    words = F.size(F.filter(F.split(X.strip(value), X.SPACE), lambda t: t != ""))
    ends = F.regexp_count(F.coalesce(F.col(value), F.lit("")), F.lit(r"(?<![0-9])[.!?](?![0-9])"))
    label_words = F.size(F.split(F.col(key), "_"))
    good = ~noise(value) & (words <= 20) & (ends < 2)
    if lenient:
        good = (F.col(value).isNull() | good) & ~noise(key)
    return fields.where(~F.col(key).startswith("Unmatched_Text") & ~F.col(key).startswith("Stamp_") & (label_words <= 5) & good)


def shaped(value: Column | str, pattern: str) -> Column:
    """the value if its letters and digits, upper-cased, have the shape; else null."""
    return F.when(F.upper(F.regexp_replace(X.col(value), "[^A-Za-z0-9]", "")).rlike(pattern), X.col(value))


def mean_positive_confidence(words: DataFrame, keys: list[str]) -> DataFrame:
    """A21."""
    return words.groupBy(*keys).agg(F.round(F.avg(F.when(F.col("conf") > 0, F.col("conf"))), 4).alias("confidence_avg"))


#: What a job's record keeps to itself.
PRIVATE = ("combined_path", "bill_image_path", "bill_ocr")


def public_jobs(jobs: DataFrame) -> DataFrame:
    """job records as a client sees them, without paths and readings."""
    return jobs.drop(*PRIVATE)
