"""Report sheets as tables of cells, and a writer for small workbooks."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Iterable
from typing import BinaryIO
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.functions import text as X

CELLS = ("sheet_ord", "sheet", "row", "col", "value", "style")


def union_of_columns(*parts: DataFrame) -> DataFrame:
    """Rows of all parts, columns in the order in which they are first seen."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def field_values(record: DataFrame, keys: list[str]) -> DataFrame:
    """K2, K4, A2: (keys, field_no, field, value, missing): a row for each field of each record, in column order."""
    fields = [c for c in record.columns if c not in keys]
    pairs = F.array(*[F.struct(F.lit(k).alias("field_no"), X.header(F.lit(c)).alias("field"), F.col(c).cast("string").alias("value")) for k, c in enumerate(fields)])
    return record.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*", F.col("p.value").isNull().alias("missing"))


def bill_columns(rows: DataFrame, hidden: tuple[str, ...] = ("validation_flags",)) -> DataFrame:
    """K3: (col, key, header) of the keys of map-typed `fields`, as first seen by row_idx and place in the row."""
    keys = rows.select("row_idx", F.posexplode(F.map_keys("fields")).alias("pos", "key")).where(~F.col("key").isin(*hidden))
    first = keys.groupBy("key").agg(F.min(F.struct("row_idx", "pos")).alias("at"))
    return first.select((F.row_number().over(Window.orderBy("at")) - 1).alias("col"), "key", X.header("key").alias("header"))


def sheet_names(records: DataFrame, keys: tuple[str, ...] = (), key: str = "lr_no", page: str = "lr_idx", longest: int = 31) -> DataFrame:
    """K5: records with sheet: LR_ and the number without leading zeros (all zeros stay), or LR_page_ and the page; at most 31 characters, repeats within a report (`keys`) numbered."""
    digits = F.regexp_replace(F.coalesce(F.col(key), F.lit("")), "[^0-9]", "")
    short = F.coalesce(F.nullif(F.regexp_replace(digits, "^0+", ""), F.lit("")), digits)
    base = F.when(short == "", F.concat(F.lit("LR_page_"), F.col(page).cast("string"))).otherwise(F.concat(F.lit("LR_"), short))
    named = records.withColumn("sheet", F.left(base, F.lit(longest)))
    nth = F.row_number().over(Window.partitionBy(*keys, "sheet").orderBy(page))
    tag = F.when(nth > 1, F.concat(F.lit("_"), nth.cast("string"))).otherwise("")
    return named.withColumn("_tag", tag).withColumn("sheet", F.concat(F.left("sheet", longest - F.length("_tag")), F.col("_tag"))).drop("_tag")


def bill_cells(rows: DataFrame, sheet: str = "Bill", sheet_ord: int = 1, first_row: int = 0) -> DataFrame:
    """K1, K3: cells of the bill table: a header row, then rows at their row_idx (from 0) of map-typed `fields`, a cell for every column; rows with flags are yellow."""
    columns = bill_columns(rows)
    head = columns.select(F.lit(first_row).alias("row"), "col", F.col("header").alias("value"), F.lit("header").alias("style"))
    at = F.col("row_idx") + first_row + 1
    flagged = F.coalesce(F.element_at("fields", "validation_flags"), F.lit("")) != ""
    order = columns.agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "key"))), lambda c: c["key"])).scalar()  # a sheet's columns are few
    values = F.transform("_order", lambda k: F.coalesce(F.element_at("fields", k), F.lit("")))
    body = rows.withColumn("_order", order).select(at.alias("row"), F.posexplode(values).alias("col", "value"), F.when(flagged, "yellow").otherwise("").alias("style"))
    return head.unionByName(body).select(F.lit(sheet_ord).alias("sheet_ord"), F.lit(sheet).alias("sheet"), "row", "col", "value", "style")


def record_cells(records: DataFrame, keys: list[str], sheet: Column, sheet_ord: Column) -> DataFrame:
    """K2, K4: (Field, Value) rows of each record on its sheet; missing values are red."""
    f = field_values(records, keys).withColumns({"sheet": sheet, "sheet_ord": sheet_ord})
    two = F.array(F.struct(F.lit(0).alias("col"), F.col("field").alias("value"), F.lit("").alias("style")), F.struct(F.lit(1).alias("col"), F.coalesce("value", F.lit("")).alias("value"), F.when(F.col("missing"), "red").otherwise("").alias("style")))
    return f.select("sheet_ord", "sheet", (F.col("field_no") + 1).alias("row"), F.explode(two).alias("c")).select("sheet_ord", "sheet", "row", "c.*")


def column_widths(cells: DataFrame, most: int = 50) -> DataFrame:
    """K8."""
    return cells.groupBy("sheet", "col").agg(F.least(F.max(F.length("value")) + 2, F.lit(most)).alias("width"))


#: Colours of cells by style, and whether they are bold.
STYLES = {"": (None, False), "header": ("F2F2F2", True), "title": ("F2F2F2", True), "blue": ("ADD8E6", False), "red": ("FF4444", False), "yellow": ("FFD700", False), "warning": ("FF4444", True), "banner": ("FF4444", True)}
MAIN, RELATIONS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _letters(col: int) -> str:
    return (_letters(col // 26 - 1) if col >= 26 else "") + chr(65 + col % 26)


def _style_sheet() -> str:
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{c}"/><bgColor rgb="FF{c}"/></patternFill></fill>' for c, _ in list(STYLES.values())[1:])
    forms = "".join(f'<xf numFmtId="0" fontId="{int(bold)}" fillId="{k + 1 if k else 0}" borderId="0" xfId="0"/>' for k, (_, bold) in enumerate(STYLES.values()))
    return (
        f'<styleSheet xmlns="{MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="{len(STYLES) + 1}"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills>'
        f'<borders count="1"><border/></borders><cellStyleXfs count="1"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/></cellStyleXfs><cellXfs count="{len(STYLES)}">{forms}</cellXfs></styleSheet>'
    )


def _sheet_xml(rows: dict[int, dict[int, tuple[str, str]]]) -> str:
    """A sheet with its styles, widths (K8), the rows down to the last header frozen, and banners over two columns."""
    number = {s: k for k, s in enumerate(STYLES)}
    wide: dict[int, int] = {}
    for cols in rows.values():
        for c, (v, _) in cols.items():
            wide[c] = max(wide.get(c, 0), len(v))
    below = max((r + 1 for r, cols in rows.items() if any(s == "header" for _, s in cols.values())), default=0)
    view = f'<sheetViews><sheetView workbookViewId="0"><pane ySplit="{below}" topLeftCell="A{below + 1}" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' if below else ""
    widths = "".join(f'<col min="{c + 1}" max="{c + 1}" width="{min(w + 2, 50)}" customWidth="1"/>' for c, w in sorted(wide.items()))
    body = "".join(
        f'<row r="{r + 1}">' + "".join(f'<c r="{_letters(c)}{r + 1}" s="{number.get(s, 0)}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for c, (v, s) in sorted(cols.items())) + "</row>"
        for r, cols in sorted(rows.items())
    )
    banners = [r + 1 for r, cols in sorted(rows.items()) if any(s == "banner" for _, s in cols.values())]
    merges = f'<mergeCells count="{len(banners)}">' + "".join(f'<mergeCell ref="A{r}:B{r}"/>' for r in banners) + "</mergeCells>" if banners else ""
    return f'<worksheet xmlns="{MAIN}">{view}<cols>{widths}</cols><sheetData>{body}</sheetData>{merges}</worksheet>'


def write_workbook(cells: Iterable, path: str | BinaryIO) -> str | BinaryIO:
    """K1: a workbook of inline strings from report cells in order of sheet_ord, row, col, with their styles, to a path, whose folders are made, or a file. It holds one report; many are written on the executors by `sources.reports`."""
    sheets: dict[str, dict[int, dict[int, tuple[str, str]]]] = {}
    for c in sorted(cells, key=lambda c: (c["sheet_ord"], c["sheet"], c["row"], c["col"])):
        sheets.setdefault(c["sheet"], {}).setdefault(c["row"], {})[c["col"]] = (c["value"] or "", c["style"] or "")
    if not sheets:
        sheets = {"Invoice": {0: {0: ("No data", "")}}, "Bill": {0: {0: ("No data", "")}}}
    if isinstance(path, str):
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    kind, package = "application/vnd.openxmlformats-officedocument.spreadsheetml", "http://schemas.openxmlformats.org/package/2006"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{RELATIONS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{i}" Type="{RELATIONS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships">{links}<Relationship Id="rId{len(sheets) + 1}" Type="{RELATIONS}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", _style_sheet())
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet_xml(rows))
    return path
