"""Zones of a page around an anchor: ruled lines above and below, boxes around, columns between headers.

Lines and boxes are arrays beside the anchor, since a page has few; nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.functions.bind import bind


def rule_above(lines: Column, y: Column) -> Column:
    """The last line at or above y (as-of backward); null if there is none."""
    return F.array_max(F.filter(lines, lambda h: h <= y))


def rule_below(lines: Column, y: Column) -> Column:
    """The first line at or below y (as-of forward)."""
    return F.array_min(F.filter(lines, lambda h: h >= y))


def tightest_box(boxes: Column, x: Column, y: Column) -> Column:
    """Of the boxes (x1, y1, x2, y2) around a point the smallest, the first on ties; null if there is none."""
    area = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    ranked = lambda p: F.transform(F.filter(boxes, lambda b: (b["x1"] <= p["x"]) & (p["x"] <= b["x2"]) & (b["y1"] <= p["y"]) & (p["y"] <= b["y2"])), lambda b, i: F.struct(area(b).alias("area"), i.alias("i"), b.alias("b")))
    return bind(F.struct(x.alias("x"), y.alias("y")), lambda p: F.array_min(ranked(p))["b"])


def first_box(boxes: Column, x: Column, y: Column) -> Column:
    """The first of the boxes (x1, y1, x2, y2) around a point; null if there is none."""
    return F.get(F.filter(boxes, lambda b: (b["x1"] <= x) & (x <= b["x2"]) & (b["y1"] <= y) & (y <= b["y2"])), F.lit(0))


def sections(segments: DataFrame, boxes: Column, ratio: float = 3.0) -> DataFrame:
    """Segments with `section`: the place of the first box that holds their centre, or, without one, -1, -2 and so on by gaps of more than `ratio` units."""
    from recordloom.operators.tables import gap_groups

    page = ["doc_id", "page_no"]
    if "items" in segments.columns:
        return _sections_of_pages(segments, page, boxes, ratio)
    around = F.transform(boxes, lambda b: (b["x1"] <= F.col("cx")) & (F.col("cx") <= b["x2"]) & (b["y1"] <= F.col("cy")) & (F.col("cy") <= b["y2"]))
    s = segments.withColumn("_box", F.coalesce(F.array_position(around, True), F.lit(0)))
    apart = gap_groups(s.where("_box = 0"), page, "top", F.col("unit"), ratio).withColumn("section", (-1 - F.col("group_no")).cast("int")).drop("group_no", "_box")
    return s.where("_box > 0").withColumn("section", (F.col("_box") - 1).cast("int")).drop("_box").unionByName(apart)


def _sections_of_pages(pages: DataFrame, page: list[str], boxes: Column, ratio: float) -> DataFrame:
    """`sections` of pages that are rows: a gap is where a text begins more than `ratio` units below the one before it, and a text's section counts the gaps down to it."""
    first = lambda x: F.coalesce(F.array_position(F.transform(boxes, lambda b: (b["x1"] <= x["cx"]) & (x["cx"] <= b["x2"]) & (b["y1"] <= x["cy"]) & (x["cy"] <= b["y2"])), True), F.lit(0))
    from recordloom.operators.layout import boxed

    pages = boxed(pages)
    p = pages.withColumn("_z", F.transform("items", lambda x: F.struct(x.alias("x"), first(x).cast("int").alias("box"))))
    free = F.array_sort(F.transform(F.filter("_z", lambda z: z["box"] == 0), lambda z: F.struct(z["x"]["top"].alias("top"), z["x"]["unit"].alias("unit"))))
    gaps = bind(free, lambda f: F.transform(F.filter(f, lambda x, i: (i > 0) & (x["top"] - F.get(f, i - 1)["top"] > ratio * x["unit"])), lambda x: x["top"]))
    below = lambda z, g: -1 - F.size(F.filter(g, lambda top: top <= z["x"]["top"]))
    names = pages.schema["items"].dataType.elementType.names
    out = bind(gaps, lambda g: F.transform("_z", lambda z: F.struct(*[z["x"][c].alias(c) for c in names], F.when(z["box"] > 0, z["box"] - 1).otherwise(below(z, g)).cast("int").alias("section"))))
    return p.select(*page, F.inline(out))


def ink_share(levels: Column) -> Column:
    """The share of dark pixels of a crop, from the counts of its 256 grey levels, by the cut that parts dark from light best (Otsu)."""
    sums = F.aggregate(F.transform(levels, lambda x, i: F.struct(x.cast("double").alias("c"), i.cast("double").alias("i"))), F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m")), lambda a, x: F.struct((a["n"] + x["c"]).alias("n"), (a["m"] + x["c"] * x["i"]).alias("m")))

    def share(whole: Column) -> Column:
        total, mass, cells = whole["s"]["n"], whole["s"]["m"], whole["l"]

        def step(state, x):
            return bind(F.struct((state["n"] + x["c"]).alias("n"), (state["m"] + x["c"] * x["i"]).alias("m"), state["best"].alias("best"), state["dark"].alias("dark")), cut)

        def cut(s):
            gap = s["m"] / F.nullif(s["n"], F.lit(0.0)) - (mass - s["m"]) / F.nullif(total - s["n"], F.lit(0.0))
            between = F.coalesce(s["n"] * (total - s["n"]) * gap * gap, F.lit(-1.0))
            return bind(between, lambda v: F.struct(s["n"].alias("n"), s["m"].alias("m"), F.greatest(v, s["best"]).alias("best"), F.when(v > s["best"], s["n"]).otherwise(s["dark"]).alias("dark")))

        start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("best"), F.lit(0.0).alias("dark"))
        each = F.transform(cells, lambda x, i: F.struct(x.cast("double").alias("c"), i.cast("double").alias("i")))
        return F.coalesce(F.aggregate(each, start, step)["dark"] / F.nullif(total, F.lit(0.0)), F.lit(0.0))

    return bind(F.struct(sums.alias("s"), levels.alias("l")), share)


def ink_present(share: Column, least: float = 0.05) -> Column:
    """Whether a crop has more ink than an empty one."""
    return share >= least


def stamp_zone(anchor: Column, boxes: Column, width: Column, height: Column, margin: int = 10) -> Column:
    """(box, above, band): the box around a stamp's anchor, the strip of two text heights above it, and its middle, where the stamp is."""
    cx, cy, h = (anchor["x1"] + anchor["x2"]) / 2, (anchor["y1"] + anchor["y2"]) / 2, anchor["y2"] - anchor["y1"]
    part = lambda a, b, c, d: F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))

    def outer(box: Column) -> Column:
        pick = lambda k, other: F.coalesce(box[k].cast("double"), other.cast("double"))
        x1, x2 = pick("x1", F.greatest(F.lit(0), anchor["x1"] - margin)), pick("x2", F.least(width, anchor["x2"] + margin))
        return part(x1, pick("y1", F.greatest(F.lit(0), anchor["y1"] - h)), x2, pick("y2", F.least(height, anchor["y2"] + 3 * h)))

    def zones_of(b: Column) -> Column:
        x1, y1, x2, y2 = (b[k] for k in ("x1", "y1", "x2", "y2"))
        return F.struct(b.alias("box"), part(x1, F.greatest(F.lit(0.0), y1 - 2 * h), x2, y1).alias("above"), part(x1, y1 + (y2 - y1) * 0.25, x2, y1 + (y2 - y1) * 0.85).alias("band"))

    return bind(bind(tightest_box(boxes, cx, cy), outer), zones_of)


def seal_zone(anchor: Column, boxes: Column, width: Column, height: Column, margin: int = 10, wide: int = 3, tall: int = 15) -> Column:
    """(x1, y1, x2, y2) below a seal's label: of the tightest box around it that is not much larger than the label, else of a padded one."""
    cx, cy, w, h = (anchor["x1"] + anchor["x2"]) / 2, (anchor["y1"] + anchor["y2"]) / 2, anchor["x2"] - anchor["x1"], anchor["y2"] - anchor["y1"]
    near = F.filter(boxes, lambda b: (b["x2"] - b["x1"] <= w * wide) & (b["y2"] - b["y1"] <= h * tall))

    def below(box: Column) -> Column:
        pick = lambda k, other: F.coalesce(box[k].cast("double"), other.cast("double"))
        return F.struct(
            pick("x1", F.greatest(F.lit(0), anchor["x1"] - margin)).alias("x1"), F.greatest(pick("y1", F.greatest(F.lit(0), anchor["y1"] - margin)), anchor["y2"].cast("double")).alias("y1"),
            pick("x2", F.least(width, anchor["x2"] + 20 * margin)).alias("x2"), pick("y2", F.least(height, anchor["y2"] + 6 * h)).alias("y2"),
        )

    return bind(tightest_box(near, cx, cy), below)


def text_within(segments: DataFrame, zone: str, keys: list[str]) -> DataFrame:
    """(keys, text): texts whose centre is in the box column `zone` of their row, in reading order; null if there is none."""
    inside = (F.col("cx") >= F.col(f"{zone}.x1")) & (F.col("cx") <= F.col(f"{zone}.x2")) & (F.col("cy") >= F.col(f"{zone}.y1")) & (F.col("cy") <= F.col(f"{zone}.y2"))
    entry = F.when(inside, F.struct("top", "left", "text"))
    texts = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["text"])
    return segments.groupBy(*keys).agg(F.nullif(F.array_join(texts, " "), F.lit("")).alias("text"))


def acknowledgement(words: DataFrame, keys: list[str], lines: int = 6, row_lines: int = 4) -> DataFrame:
    """(keys, field, x1, y1, x2, y2): the cells of the acknowledgement box below its topmost heading: received_wt, received_date, remark.

    words: left, top, width, height, text. Pages without a heading or one of the three captions within six text heights below it have no row.
    """
    w = words.withColumn("low", F.lower("text"))
    exact = w.where(F.col("low").rlike("acknowledgement")).groupBy(*keys).agg(F.min_by(F.struct("top", "height"), "top").alias("h"), F.lit(0).alias("o"))
    loose = w.where(F.col("low").rlike("received")).groupBy(*keys).agg(F.min_by(F.struct("top", "height"), "top").alias("h"), F.lit(1).alias("o"))
    head = exact.unionByName(loose).groupBy(*keys).agg(F.min_by("h", "o").alias("h"))
    band = w.join(head, keys).where((F.col("top") >= F.col("h.top") + F.col("h.height")) & (F.col("top") <= F.col("h.top") + (1 + lines) * F.col("h.height")))
    field = F.when(F.col("low").rlike("received"), "received_wt").when(F.col("low").rlike("^date$"), "received_date").when(F.col("low").rlike("remark"), "remark")
    first = band.withColumn("field", field).where("field is not null").groupBy(*keys, "field").agg(F.min_by(F.struct("left", "top", "width", "height", (F.col("h.height") * row_lines).alias("row")), F.struct("top", "left")).alias("c"))
    whole = Window.partitionBy(*keys)
    until = F.lead("c.left").over(whole.orderBy("c.left", "field"))
    cells = first.withColumns({"_n": F.count("*").over(whole), "_until": until}).where("_n = 3")
    return cells.select(*keys, "field", F.col("c.left").cast("double").alias("x1"), (F.col("c.top") + F.col("c.height")).cast("double").alias("y1"), F.coalesce("_until", F.col("c.left") + 4 * F.col("c.width")).cast("double").alias("x2"), (F.col("c.top") + F.col("c.height") + F.col("c.row")).cast("double").alias("y2"))


def nearest_right(boxes: Column, x: Column, y: Column) -> Column:
    """Of the boxes that begin right of x in the row of y the nearest."""
    right = F.filter(boxes, lambda b: (b["x1"] >= x) & (b["y1"] <= y) & (y <= b["y2"]))
    return F.array_min(F.transform(right, lambda b, i: F.struct((b["x1"] - x).alias("d"), i.alias("i"), b.alias("b"))))["b"]


def _whole(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """A crop on whole pixels inside the page."""
    cut = lambda c, most: F.floor(F.least(F.greatest(c.cast("double"), F.lit(0.0)), most.cast("double"))).cast("double")
    return F.struct(cut(x1, width).alias("x1"), cut(y1, height).alias("y1"), cut(x2, width).alias("x2"), cut(y2, height).alias("y2"))


def _padded(anchor: Column, width: Column, height: Column, aside: float = 0.18, around: float = 0.06) -> Column:
    """An anchor's centre with a share of the page on each side: what is left where nothing printed bounds a zone."""
    cx, cy = (anchor["x1"] + anchor["x2"]) / 2, (anchor["y1"] + anchor["y2"]) / 2
    return _whole(cx - width * aside, cy - height * around, cx + width * aside, cy + height * around, width, height)


def zone_crop(anchor: Column, lines: Column, boxes: Column, width: Column, height: Column, around: float = 0.06, least: float = 0.003, margin: int = 10) -> Column:
    """(x1, y1, x2, y2) of an anchor's zone: between the rules above and below it, as wide as the tightest box around it.

    Without such a box it reaches from just left of the anchor to just before the first box that begins right of it in its row (one and a half
    heights more on both sides, 20 at least); without that one too, a share of the page's width on both sides. A zone of less than 0.3 % of the page is padded on all sides instead.
    """
    h, cx, cy = anchor["y2"] - anchor["y1"], (anchor["x1"] + anchor["x2"]) / 2, (anchor["y1"] + anchor["y2"]) / 2
    top = F.coalesce(rule_above(lines, anchor["y1"]), F.greatest(F.lit(0), anchor["y1"] - height * around))
    bottom = F.coalesce(rule_below(lines, anchor["y2"]), F.least(height, anchor["y2"] + height * around))
    row = F.greatest(1.5 * h, F.lit(20.0))
    after = F.filter(boxes, lambda b: (b["x1"] > anchor["x2"] - 2 * margin) & (b["y1"] < anchor["y2"] + row) & (b["y2"] > anchor["y1"] - row))
    edge = F.array_min(F.transform(after, lambda b: b["x1"]))
    known = F.struct(tightest_box(boxes, cx, cy).alias("box"), edge.alias("edge"), _padded(anchor, width, height).alias("wide"))

    def crop(k: Column) -> Column:
        left = F.when(k["box"].isNotNull(), k["box"]["x1"].cast("double")).when(k["edge"].isNotNull(), (anchor["x1"] - margin).cast("double")).otherwise(k["wide"]["x1"])
        right = F.when(k["box"].isNotNull(), k["box"]["x2"].cast("double")).when(k["edge"].isNotNull(), F.greatest(anchor["x2"] + margin, k["edge"] - margin).cast("double")).otherwise(k["wide"]["x2"])
        return bind(_whole(left, top, right, bottom, width, height), lambda z: F.when(small(z), k["wide"]).otherwise(z))

    def small(z: Column) -> Column:
        return (z["x2"] <= z["x1"]) | (z["y2"] <= z["y1"]) | ((z["x2"] - z["x1"]) * (z["y2"] - z["y1"]) < least * width * height)

    return bind(known, crop)


def table_crop(anchor: Column, lines: Column, boxes: Column, width: Column, height: Column, like: float = 1.5, margin: int = 10) -> Column:
    """Around all boxes of the row of the cell that holds the anchor (at most 1.5 times as high as the cell), down to the first rule below them; padded without a cell."""

    def around(cell: Column) -> Column:
        row = F.filter(boxes, lambda b: (b["y2"] - b["y1"] <= like * (cell["y2"] - cell["y1"])) & (b["y1"] < cell["y2"]) & (b["y2"] > cell["y1"]))
        return F.when(cell.isNotNull(), bind(row, union)).otherwise(_padded(anchor, width, height))

    def union(row: Column) -> Column:
        edge = lambda f, k: f(F.transform(row, lambda b: b[k].cast("double")))
        below = bind(edge(F.array_max, "y2"), lambda y: F.coalesce(F.array_min(F.filter(lines, lambda h: h > y)).cast("double"), y))
        return _whole(edge(F.array_min, "x1") - margin, edge(F.array_min, "y1") - margin, edge(F.array_max, "x2") + margin, below + margin, width, height)

    return bind(tightest_box(boxes, (anchor["x1"] + anchor["x2"]) / 2, (anchor["y1"] + anchor["y2"]) / 2), around)


def weight_crop(anchor: Column, lines: Column, outer_right: Column, width: Column, height: Column, wide: float = 3.3, aside: float = 0.2, margin: int = 10) -> Column:
    """From ten above the anchor to the first rule half a height below it, or five heights; 3.3 times as wide, within the outer zone."""
    h, w = anchor["y2"] - anchor["y1"], anchor["x2"] - anchor["x1"]
    bottom = F.coalesce(F.array_min(F.filter(lines, lambda y: y > anchor["y2"] + 0.5 * h)).cast("double"), (anchor["y2"] + 5 * h).cast("double"))
    return _whole(anchor["x1"] - aside * w, anchor["y1"] - margin, F.least(outer_right.cast("double"), anchor["x1"] + wide * w), bottom, width, height)


def header_columns(labels: DataFrame, keys: list[str], heights: float = 6.0) -> DataFrame:
    """Labels within six heights of the topmost one, with `until`: each column ends where the next starts, the last after four widths.

    labels: keys, left, top, width, height, text and, for ties, line and word if there are any; the first of several topmost ones gives the height.
    """
    w, ties = Window.partitionBy(*keys), [c for c in ("line", "word") if c in labels.columns] or ["left", "text"]
    first = F.min(F.struct("top", *ties, "height")).over(w)
    band = labels.withColumn("_first", first).where(F.col("top") - F.col("_first.top") <= heights * F.col("_first.height")).drop("_first")
    return band.withColumn("until", F.coalesce(F.lead("left").over(w.orderBy("left", *ties)), F.col("left") + 4 * F.col("width")))


def nearest_match(words: DataFrame, anchor_x: Column, anchor_y: Column, pattern: str, keys: list[str]) -> DataFrame:
    """Per page the word of a shape that is nearest to an anchor, heights counting tenfold; reading order on ties."""
    far = F.pow(F.col("left") - anchor_x, 2) + F.pow(10 * (F.col("top") - anchor_y), 2)
    return words.where(F.col("text").rlike(pattern)).groupBy(*keys).agg(F.min_by("text", F.struct(far.alias("far"), "top", "left", "text")).alias("text"))


def refined(found: DataFrame, better: DataFrame, keys: list[str], field: str, override: bool = False) -> DataFrame:
    """A field filled up, or overridden, by another reading of it."""
    other = better.select(*keys, F.col(field).alias("_other"))
    a, b = ("_other", field) if override else (field, "_other")
    return found.join(other, keys, "left").withColumn(field, F.coalesce(a, b)).drop("_other")
