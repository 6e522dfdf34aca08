"""The whole report as one table of cells: the form, the bill, the tax invoice if there is one, a sheet for each receipt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions import text as X
from recordloom.operators.report import bill_cells, sheet_names

#: Titles, messages and the blank rows between the parts of a sheet.
TITLES, GAP = ("Field", "Value"), 1
NO_FORM, NO_ROWS = "No invoice data extracted", "No bill rows extracted"
NO_NUMBER = "WARNING: LR number could not be read from this page. Fields below may be missing or misaligned."


def cell(row: int | Column, col: int, value: str | Column, style: str | Column = "") -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(row).cast("int").alias("row"), F.lit(col).alias("col"), lit(value).alias("value"), lit(style).alias("style"))


def _shown(rows: DataFrame, name: str) -> Column:
    """K7: lists joined by commas, null as empty."""
    return X.cell_value(name) if isinstance(rows.schema[name].dataType, T.ArrayType) else F.coalesce(F.col(name).cast("string"), F.lit(""))


def _titles(row: int | Column) -> list[Column]:
    return [cell(row, k, t, "title") for k, t in enumerate(TITLES)]


def _placed(rows: DataFrame, cells: list[Column], sheet: str | Column, sheet_ord: int | Column) -> DataFrame:
    """A row for each cell that is not null."""
    own = [(x if isinstance(x, Column) else F.lit(x)).alias(n) for x, n in ((sheet_ord, "sheet_ord"), (sheet, "sheet"))]
    return rows.select(*own, F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("c")).select("sheet_ord", "sheet", "c.*")


def warning_cells(warnings: list[str], sheet: str = "Invoice") -> list[Column]:
    return [cell(k, 0, f"WARNING: {w}", "warning") for k, w in enumerate(warnings)]


def form_cells(form: DataFrame, warnings: tuple[str, ...] = (), sheet: str = "Invoice", sheet_ord: int = 0) -> DataFrame:
    """K1, K2: warnings on top, then a form of one row: its names across, its values under them, missing ones red; a message if there is no row."""
    at, names = len(warnings), form.columns
    head = [cell(at, k, X.header(F.lit(n)), "header") for k, n in enumerate(names)]
    values = [cell(at + 1, k, _shown(form, n), F.when(F.col(n).isNull(), "red").otherwise("")) for k, n in enumerate(names)]
    size = form.agg(F.count("*").alias("n"))
    none = (F.col("n") == 0) if names else F.lit(True)
    fixed = _placed(size, [*warning_cells(list(warnings)), F.when(none, cell(at, 0, NO_FORM))], sheet, sheet_ord)
    return fixed.unionByName(_placed(form, head + values, sheet, sheet_ord)) if names else fixed


def section_cells(rows: DataFrame, head: DataFrame | None = None, sheet: str = "Bill", sheet_ord: int = 1, optional: bool = False) -> DataFrame:
    """K3: the fields of `head` (one row) in blue, a blank row, then the table as `bill_cells` has it; a message, or with `optional` no cell at all, if it has no rows."""
    names = head.columns if head is not None else []
    first = len(names) + 1 + GAP
    size = rows.agg(F.count("*").alias("n"))
    top = _placed(size.where("n > 0") if optional else size, [*_titles(0), F.when(F.col("n") == 0, cell(first, 0, NO_ROWS))], sheet, sheet_ord)
    if names:
        named = head.where(size.scalar() > 0) if optional else head
        top = top.unionByName(_placed(named, [c for k, n in enumerate(names) for c in (cell(k + 1, 0, X.header(F.lit(n)), "blue"), cell(k + 1, 1, _shown(head, n), "blue"))], sheet, sheet_ord))
    return top.unionByName(bill_cells(rows, sheet, sheet_ord, first).where(size.scalar() > 0))


def receipt_cells(records: DataFrame, first_ord: int = 3, page: str = "lr_idx", number: str = "lr_no") -> DataFrame:
    """K4, K5: each receipt's fields in order on a sheet of its own; one without a number begins with a warning and all else is a row lower."""
    fields = [c for c in records.columns if c != page]
    blank = F.coalesce(F.col(number), F.lit("")) == ""
    at = blank.cast("int")
    pairs = [c for k, n in enumerate(fields) for c in (cell(at + 1 + k, 0, X.header(F.lit(n))), cell(at + 1 + k, 1, _shown(records, n)))]
    return _placed(sheet_names(records, key=number, page=page), [F.when(blank, cell(0, 0, NO_NUMBER, "banner")), *_titles(at), *pairs], F.col("sheet"), F.col(page) + first_ord)


def report_cells(form: DataFrame, bill: DataFrame, bill_head: DataFrame | None = None, tax: DataFrame | None = None, tax_head: DataFrame | None = None, receipts: DataFrame | None = None, warnings: tuple[str, ...] = ()) -> DataFrame:
    """K1: all cells of a report; the tax invoice's sheet only if it has rows, the receipts' in page order. Nothing is collected here."""
    parts = [form_cells(form, warnings), section_cells(bill, bill_head)]
    if tax is not None:
        parts.append(section_cells(tax, tax_head, "Tax Invoice", 2, optional=True))
    if receipts is not None:
        parts.append(receipt_cells(receipts))
    out = parts[0].withColumn("sheet_ord", F.col("sheet_ord").cast("long"))
    for p in parts[1:]:
        out = out.unionByName(p.withColumn("sheet_ord", F.col("sheet_ord").cast("long")))
    return out
