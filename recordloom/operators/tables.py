"""Rows, rules and pages of tables: caption rows, data rows, footers, grouped lines, page runs, column splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.functions import text as X
from recordloom.functions.bind import bind
from recordloom.operators.segmented import SPAN, running_total, segment, with_previous


def rows_of(cells: DataFrame) -> DataFrame:
    """(table_id, row_idx, cells): long cells as an array of stripped texts in column order."""
    c = F.array_sort(F.collect_list(F.struct("col_idx", X.strip("text").alias("t"))))
    return cells.groupBy("table_id", "row_idx").agg(F.transform(c, lambda x: x["t"]).alias("cells"))


def n_filled(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda t: t != ""))


def caption_rows(rows: DataFrame, search: int = 4, longest: int = 25, tolerance: float = 0.2) -> DataFrame:
    """(table_id, caption_row): of the first rows the fullest that has no eight digits together and few long cells; the earliest on ties, 0 if none."""
    c = F.col("cells")
    long = F.size(F.filter(c, lambda t: F.length(t) > longest))
    usable = (F.col("row_idx") < search) & (n_filled(c) > 0) & ~F.exists(c, lambda t: t.rlike("[0-9]{8}")) & (long <= n_filled(c) * tolerance)
    best = F.min_by(F.when(usable, F.col("row_idx")), F.when(usable, F.struct(-n_filled(c), F.col("row_idx"))))
    return rows.groupBy("table_id").agg(F.coalesce(best, F.lit(0)).alias("caption_row"))


def column_number_rows(rows: DataFrame, captions: DataFrame) -> DataFrame:
    """(table_id, numbers): the last row above the caption whose filled cells are all digits."""
    c = F.filter("cells", lambda t: t != "")
    above = rows.join(captions, "table_id").where(F.col("row_idx") < F.col("caption_row")).where((F.size(c) > 0) & F.forall(c, lambda t: t.rlike("^[0-9]+$")))
    return above.groupBy("table_id").agg(F.max_by(c, "row_idx").alias("numbers"))


def bill_data_row(serial: Column, cells: Column, fill: float = 0.6) -> Column:
    """a serial of digits, or one that is not blank in a row that is full enough."""
    s = X.strip(serial)
    return s.rlike("^[0-9]+$") | ((s != "") & (n_filled(cells) >= fill * F.size(cells)))


def invoice_data_row(serial: Column, cells: Column, fill: float = 0.6, longest: int = 40) -> Column:
    """no long cell, and a serial of digits or a row that is full enough whatever its serial."""
    return ~F.exists(cells, lambda t: F.length(t) > longest) & (X.strip(serial).rlike("^[0-9]+$") | (n_filled(cells) >= fill * F.size(cells)))


def not_footer(cells: Column, serial_at: int = 0) -> Column:
    """rows whose serial has a letter or is blank go, unless more than half of the other cells are filled."""
    s = F.coalesce(F.get(cells, F.lit(serial_at)), F.lit(""))
    others = F.filter(cells, lambda t, i: i != serial_at)
    dense = n_filled(others) > 0.5 * F.size(others)
    return ~((s.rlike("[A-Za-z]") | (s == "")) & ~dense)


def group_lines(points: DataFrame, keys: list[str], gap: int = 10, span: int = SPAN) -> DataFrame:
    """(keys, line_no, first, last, line): positions x with gaps of at most `gap` are one line, at the middle rounded down. A run of any length is cut into segments of `span`."""
    p = points.withColumn("_segment", segment("x", span))
    inside = Window.partitionBy(*keys, "_segment").orderBy("x")
    p = p.withColumn("_fresh", F.coalesce((F.col("x") - F.lag("x").over(inside) > gap).cast("int"), F.lit(0)))
    p = p.withColumn("_nth", F.sum("_fresh").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    parts = p.groupBy(*keys, "_segment", "_nth").agg(F.min("x").alias("first"), F.max("x").alias("last"))
    # a row a segment: how many lines are before it, less one if its first goes on with the last of the segment before
    by = Window.partitionBy(*keys).orderBy("_segment")
    ends = parts.groupBy(*keys, "_segment").agg(F.max("_nth").alias("_n"), F.min("first").alias("_from"), F.max("last").alias("_to"))
    fresh = F.coalesce((F.col("_from") - F.lag("_to").over(by) > gap).cast("int"), F.lit(0))
    base = ends.withColumn("_fresh", fresh).withColumn("_base", F.sum("_fresh").over(by) + F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    moved = base.where("_base > 0").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_segment").alias("_s"), "_base")
    same = F.col("_segment").eqNullSafe(F.col("_s"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    g = parts.join(moved, same, "left").withColumn("line_no", F.col("_nth") + F.coalesce("_base", F.lit(0)))
    g = g.groupBy(*keys, "line_no").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return g.withColumn("line", F.floor((F.col("first") + F.col("last")) / 2).cast("bigint"))


def upper_median(values: Column) -> Column:
    """Of the sorted values the one in the middle, the upper of two; null without values."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def unit(heights: Column, default: float = 15.0) -> Column:
    return F.coalesce(upper_median(F.filter(heights, lambda h: h > 0)).cast("double"), F.lit(default))


def trim_outliers(lines: Column, ratio: float = 4.0) -> Column:
    """Sorted lines without those at the end whose gap is more than `ratio` times the upper median gap; two stay."""
    gaps = lambda x: F.transform(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), lambda y, i: y - F.get(x, i))

    def trimmed(k: Column) -> Column:  # the median is known here: in the function of a gap it would be sorted again for each
        x, n = k["x"], F.size(k["x"])
        keep = F.array_max(F.transform(k["gaps"], lambda g, i: F.when((g <= k["mid"] * ratio) | (i == 0), i + 2)))
        return F.when((n < 3) | (k["mid"] <= 0), x).otherwise(F.slice(x, 1, keep))

    whole = lambda k: F.struct(k["x"].alias("x"), k["gaps"].alias("gaps"), upper_median(k["gaps"]).alias("mid"))
    return bind(bind(bind(lines, lambda x: F.struct(x.alias("x"), gaps(x).alias("gaps"))), whole), trimmed)


def gap_groups(items: DataFrame, keys: list[str], at: str, size: Column, ratio: float = 3.0, span: int = SPAN) -> DataFrame:
    """The items with `group_no`, which rises where the gap to the one before is more than ratio * size. A run of any length is cut into segments of `span`."""
    p = with_previous(items, keys, at, [at], span)
    fresh = F.coalesce((F.col(at) - F.col(f"prev_{at}") > ratio * size).cast("int"), F.lit(0))
    return running_total(p, keys, at, fresh, "group_no", span).drop(f"prev_{at}")


def page_runs(pages: DataFrame, tolerance: int = 2) -> DataFrame:
    """Pages that belong to a table: title pages and those after them, one by one, while a grid of about as many columns is there.

    pages: doc_id, page_no, is_title, n_cols (null without a grid). Returns doc_id, start_page, page_no.
    """
    w = Window.partitionBy("doc_id").orderBy("page_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    p = pages.withColumn("start_page", F.max(F.when(F.col("is_title"), F.col("page_no"))).over(upto)).where("start_page is not null")
    by = Window.partitionBy("doc_id", "start_page").orderBy("page_no")
    expected = F.first("n_cols").over(by)
    ok = F.col("is_title") | F.coalesce(F.abs(F.col("n_cols") - expected) <= tolerance, F.lit(False))
    ok = ok & (F.col("page_no") == F.col("start_page") + F.row_number().over(by) - 1)
    p = p.withColumn("ok", F.min(ok.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return p.where("ok = 1").select("doc_id", "start_page", "page_no")


def leftmost(values: Column, k: int) -> Column:
    """The first k values, or null if there are fewer."""
    return F.when(F.size(values) >= k, F.slice(values, 1, k))


def width_split(x: Column, left: Column, width: Column, k: int) -> Column:
    """Which of k columns of equal width holds x; null outside."""
    i = F.floor((x - left) * k / width).cast("int")
    return F.when((i >= 0) & (i < k), i)


def first_filled_row(rows: DataFrame, after: int = 0) -> DataFrame:
    """T5: (table_id, row_idx, cells) of each table's first row beyond `after` that has a filled cell."""
    best = F.min_by(F.struct("row_idx", "cells"), "row_idx")
    return rows.where((F.col("row_idx") > after) & (n_filled(F.col("cells")) > 0)).groupBy("table_id").agg(best.alias("r")).select("table_id", "r.*")


def positional_record(rows: DataFrame, names: tuple[str, ...], after: int = 0) -> DataFrame:
    """(table_id and `names`): the first filled row below the captions read by position; all null if it has fewer cells."""
    part = leftmost(F.col("cells"), len(names))
    first = first_filled_row(rows, after)
    return first.select("table_id", *[F.nullif(F.get(part, F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names)])


def column_divider(bands: Column, page_lines: Column, width: Column, least: float = 0.25, most: float = 0.75, margin: int = 50) -> Column:
    """(divider, right) of the first band of two rows that has a rule inside the page's middle; null if none has.

    bands: the vertical rules of each pair of adjacent rows, in order. Rules near those of the whole page are its borders.
    """
    inner = lambda b: F.filter(b, lambda x: F.forall(page_lines, lambda e: F.abs(x - e) > margin))
    middle = lambda b: F.filter(b, lambda x: (x >= width * least) & (x <= width * most))
    found = F.get(F.filter(F.transform(bands, inner), lambda b: F.size(middle(b)) > 0), F.lit(0))
    right = lambda b, d: F.coalesce(F.array_min(F.filter(b, lambda x: x > d)), F.array_max(page_lines) - margin)
    zone = lambda b, d: F.when(d.isNotNull(), F.struct(d.alias("divider"), right(b, d).alias("right")))
    return bind(found, lambda b: bind(F.array_min(middle(b)), lambda d: zone(b, d)))


def page_roles(pages: DataFrame, layout: DataFrame, width: int = 64) -> DataFrame:
    """Pages with the role whose range holds them. layout: role, first_page, last_page (inclusive); all rows count.

    Pages and ranges meet in bins of `width` pages, by equality; a range ends for that at the last page there is.
    """
    most = pages.agg(F.max("page_no")).first()[0]  # one number
    last = F.least(F.col("last_page"), F.lit(0 if most is None else int(most)))
    bins = F.sequence(F.floor(F.col("first_page") / width), F.floor(last / width))
    ranges = layout.where(F.col("first_page") <= last).withColumn("_bin", F.explode(bins))
    binned = pages.withColumn("_bin", F.floor(F.col("page_no") / width))
    return binned.alias("p").join(ranges.alias("r"), (F.col("p._bin") == F.col("r._bin")) & F.col("p.page_no").between(F.col("first_page"), F.col("last_page")), "left").drop("_bin", "first_page", "last_page")


def layout_warnings(pages: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, n_pages, warnings) by which roles a document's pages have."""
    n = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if(F.col("role") == "lr").alias("_lr"), F.count_if(F.col("role") == "bill").alias("_bill"))
    w = F.array(F.when(F.col("n_pages") < least, F.lit("too_few_pages")), F.when(F.col("_lr") == 0, F.lit("no_lr_pages")), F.when(F.col("_bill") == 0, F.lit("no_bill_pages")))
    return n.select("doc_id", "n_pages", F.filter(w, lambda x: x.isNotNull()).alias("warnings"))


def better_variant(variants: DataFrame) -> DataFrame:
    """(doc_id, page_no, variant, mean_conf): of each page's variants the one with the best mean confidence, the processed one on ties; words without confidence (-1) do not count."""
    m = variants.groupBy("doc_id", "page_no", "variant").agg(F.coalesce(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), F.lit(0.0)).alias("mean_conf"))
    best = F.max_by(F.struct("variant", "mean_conf"), F.struct("mean_conf", (F.col("variant") == "processed").cast("int").alias("p"), "variant"))
    return m.groupBy("doc_id", "page_no").agg(best.alias("b")).select("doc_id", "page_no", "b.variant", "b.mean_conf")
