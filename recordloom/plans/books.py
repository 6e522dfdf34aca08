"""Covers, bills and tax invoices from pages: bands between rules, tables that run over pages, captions carried along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.functions import text as X
from recordloom.functions.bind import bind
from recordloom.operators import layout, matching, pages, tables
from recordloom.plans import extract
from recordloom.session import written

#: What is kept off a divider, and the height of a title's band as a share of the page's.
CELL_MARGIN, TITLE_BAND = 6, 0.04


def _spanning(rules: Column, axis: str, begin: Column, end: Column, share: float) -> Column:
    """The places of the rules of an axis that run along at least `share` of a stretch, ascending."""
    along = lambda r: F.least(r["last"], end) - F.greatest(r["first"], begin) >= share * (end - begin)
    return F.array_distinct(F.array_sort(F.transform(F.filter(rules, lambda r: (r["axis"] == axis) & along(r)), lambda r: r["at"])))


def _ends(places: Column) -> Column:
    return F.struct(F.array_min(places).alias("a"), F.array_max(places).alias("b"))


def _between(h: Column, i: Column, share: float) -> Column:
    """The upright rules that run along two bands, from the i-th rule across."""
    return bind(F.struct(F.get(h, i).alias("a"), F.get(h, i + 2).alias("b")), lambda e: _spanning(F.col("rules"), "v", e["a"], e["b"], share))


def cover_pairs(page: DataFrame) -> DataFrame:
    """(doc_id, idx, label, value): both halves of each band between successive rules of a form's first page, left and right of its divider.

    The divider is the first rule inside the page's middle that runs through two bands; the page's own borders run through nearly all of them. A page with fewer than
    three rules across or two borders, or without a divider, has no rows.
    """
    none = F.lit(None).cast("array<struct<label: string, value: string>>")
    half = lambda h, a, b: F.transform(pages.grid(F.col("words"), h, F.array(a, b)), lambda r: F.get(r, F.lit(0)))

    def read(h: Column, edges: Column) -> Column:
        bands = F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: _between(h, i, 0.7))
        found = bind(bands, lambda bs: tables.column_divider(bs, edges, F.col("width")))
        zipped = lambda d: F.zip_with(half(h, F.array_min(edges) + CELL_MARGIN, d["divider"]), half(h, d["divider"] + CELL_MARGIN, d["right"]), lambda x, y: F.struct(x.alias("label"), y.alias("value")))
        return bind(found, lambda d: F.when(d.isNotNull(), zipped(d)).otherwise(none))

    ruled = lambda h: F.when(F.size(h) >= 3, bind(bind(_ends(h), lambda e: _spanning(F.col("rules"), "v", e["a"], e["b"], 0.7)), lambda edges: F.when(F.size(edges) >= 2, read(h, edges)).otherwise(none))).otherwise(none)
    # one expression, each part bound where it is made, and an outer explode: no filter has it computed once more
    return page.select("doc_id", F.posexplode_outer(bind(pages.lines(F.col("rules"), "h"), ruled)).alias("idx", "z")).where("idx is not null").select("doc_id", "idx", "z.label", "z.value")


def barcode_text(left: int = 20, wide: float = 1.7, tall: float = 0.9) -> Column:
    """What is printed under a page's bars (the largest box of kind `barcode`); null without."""
    area = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    best = F.array_max(F.transform(F.filter("boxes", lambda b: b["kind"] == "barcode"), lambda b: F.struct(area(b).alias("area"), b.alias("b"))))["b"]
    under = bind(best, lambda b: pages.zone(b["x1"] - left, b["y2"], b["x1"] + wide * (b["x2"] - b["x1"]), b["y2"] + tall * (b["y2"] - b["y1"])))
    return pages.text_of(pages.within(F.col("words"), under))


def cover_flow(words: DataFrame, rules: DataFrame, boxes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id and nine fields) of covers, from the words and rules of each document's page 0; one shuffle brings a page together. What is not found is null."""
    first = {n: df.where("page_no = 0") for n, df in (("words", words), ("rules", rules), ("boxes", boxes), ("sizes", sizes))}
    page = written(pages.gathered(**first))
    found = extract.cover_records(written(cover_pairs(page)))
    return page.select("doc_id", bind(barcode_text(), lambda t: F.when(t.isNotNull(), X.barcode(t))).alias("barcode_number")).join(found.drop("barcode_number"), "doc_id", "left").select(*found.columns)


def page_tables(page: DataFrame, least: int = 3) -> DataFrame:
    """Pages with `h`, `v` (rules; no `v` with fewer than three of `h`) and `cells`, row by row."""
    p = page.withColumn("h", pages.lines(F.col("rules"), "h"))
    p = p.withColumn("v", F.when(F.size("h") >= least, _spanning(F.col("rules"), "v", F.array_min("h"), F.array_max("h"), 0.5)).otherwise(F.array().cast("array<double>")))
    return p.withColumn("cells", pages.grid(F.col("words"), F.col("h"), F.col("v")))


def numbered_rows(tabled: DataFrame, key: str = "doc_id") -> DataFrame:
    """(table_id, row_idx, carried, cells): the rows of all pages of a table, numbered in page order.

    Each page's first number is the sum of the pages' row counts before it: the window runs over a number a page, and rows are numbered where they are. `carried`
    rows stand on a later page than the first with rows, under the captions of that one.
    """
    counts = tabled.select(key, "page_no", F.size("cells").alias("n")).where("n > 0")
    by = Window.partitionBy(key).orderBy("page_no")
    starts = counts.select(key, "page_no", F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    rows = tabled.join(starts, [key, "page_no"]).select(F.col(key).alias("table_id"), "start", F.posexplode("cells").alias("i", "cells"))
    return rows.select("table_id", (F.col("start") + F.col("i")).cast("int").alias("row_idx"), (F.col("start") > 0).alias("carried"), "cells")


def _cells(rows: DataFrame) -> DataFrame:
    return rows.select("table_id", "row_idx", "carried", F.posexplode("cells").alias("col_idx", "text"))


def bill_header(tabled: DataFrame) -> DataFrame:
    """E3 in E2: (doc_id, header): the labels and values printed above the table of each bill's first page, as a map."""
    first = tabled.groupBy("doc_id").agg(F.min("page_no").alias("page_no"))
    page = tabled.join(first, ["doc_id", "page_no"]).withColumn("_cut", F.greatest(F.coalesce(F.array_min("h"), F.floor(F.col("height") * 0.3).cast("double")), F.lit(1.0)))
    above = pages.phrases(F.filter("words", lambda w: w["top"] + w["height"] <= F.col("_cut")), 1.2)
    s = page.select("doc_id", "page_no", F.explode(above).alias("p")).select("doc_id", "page_no", F.col("p.x1").cast("int").alias("left"), F.col("p.y1").cast("int").alias("top"), (F.col("p.x2") - F.col("p.x1")).cast("int").alias("width"), (F.col("p.y2") - F.col("p.y1")).cast("int").alias("height"), F.col("p.confidence").alias("conf"), "p.text")
    found = layout.label_values(layout.prepared(s))
    return found.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("header"))


def bill_flow(words: DataFrame, rules: DataFrame, sizes: DataFrame, configured: DataFrame | None = None, captions: DataFrame | None = None) -> DataFrame:
    """E2 with E3, U1: (doc_id, row_idx, fields, header, column_numbers) of bills that run over any number of pages.

    The captions (or those read again: table_id, col_idx, caption), and what the columns are, come from the first page with a table; later pages repeat neither. Rows keep their number in the whole bill. A bill
    without data rows has none here; `bill_header` has its header.
    """
    tabled = written(page_tables(pages.gathered(words=words, rules=rules, sizes=sizes)))
    rows = written(numbered_rows(tabled))
    head = rows.where("not carried").select("table_id", "row_idx", "cells")
    at = tables.caption_rows(head)
    numbers = tables.column_number_rows(head, at)
    out = extract.bill_rows(_cells(rows), configured, captions).withColumnRenamed("table_id", "doc_id")
    return out.join(bill_header(tabled), "doc_id", "left").join(numbers.select(F.col("table_id").alias("doc_id"), F.col("numbers").alias("column_numbers")), "doc_id", "left")


def title_bands(page: DataFrame, region: float = 0.2, band: float = TITLE_BAND) -> DataFrame:
    """(doc_id, page_no, top, text): all that stands in each thin band of a page's upper part, whole lines together; top is the band's share of the height."""
    step = F.greatest(F.floor(F.col("height") * band), F.lit(1))
    spots = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.floor(F.col("height") * region) / step) - 1, F.lit(0)).cast("long"))
    in_band = lambda k: pages.text_of(F.filter("words", lambda w: (w["top"] + w["height"] / 2 >= k * step) & (w["top"] + w["height"] / 2 < (k + 1) * step)))
    bands = F.transform(spots, lambda k: F.struct((k * step / F.col("height")).alias("top"), in_band(k).alias("text")))
    return page.where("height > 0").select("doc_id", "page_no", F.explode(bands).alias("b")).select("doc_id", "page_no", "b.*").where("text is not null")


def tax_invoice_flow(words: DataFrame, rules: DataFrame, sizes: DataFrame) -> DataFrame:
    """E4 with S7, W10: (doc_id, row_idx, fields) of the tax invoices among a document's pages.

    They are found by their title; the pages after one belong to it while they have a table of about as many columns. The first page read names the columns, and
    what it says holds for all rows after it: only its rows decide what a column is. Rows without an amount, footers and rows with long cells go.
    """
    tabled = written(page_tables(pages.gathered(words=words, rules=rules, sizes=sizes)))
    titles = matching.title_pages(title_bands(tabled)).withColumn("is_title", F.lit(True))
    known = tabled.select("doc_id", "page_no", F.when((F.size("h") > 0) & (F.size("v") > 0), F.size("v")).alias("n_cols")).join(titles, ["doc_id", "page_no"], "left").withColumn("is_title", F.coalesce("is_title", F.lit(False)))
    run = tables.page_runs(known).select("doc_id", "page_no").distinct()
    rows = written(numbered_rows(tabled.join(run, ["doc_id", "page_no"], "left_semi")))
    return extract.tax_invoice_rows(_cells(rows)).withColumnRenamed("table_id", "doc_id")
