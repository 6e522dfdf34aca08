"""Receipts of any layout: every label and value of each printed section, the known ones aliased, numbers found again by shape and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.bind import bind
from recordloom.operators import layout, matching, pages, tables
from recordloom.plans import extract
from recordloom.session import written

#: The fields that have a name of their own, and their labels.
SYNONYMS = {
    "lr_no": ["lr no"], "lr_date": ["lr date"], "shipment_no": ["shipment no"], "from_origin": ["from origin"], "truck_no": ["truck no"], "truck_type": ["truck type"],
    "incoterm": ["incoterm"], "lorry_tare_wt": ["lorry tare wt"], "net_wt": ["net wt"], "gross_wt": ["gross wt"], "amount": ["amount"],
}
#: Shape, part of the page and whether the field's own label is near, in the order in which they are looked for.
TARGETS = (
    ("lr_no", r"^([0-9]{7,12}|[A-Z]{1,3}[0-9]{7,12})$", "top", True),
    ("shipment_no", r"^[0-9]{8}$", "top", False),
    ("net_wt", r"^[0-9]{1,3}\.[0-9]{2,3}$", "bottom", True),
    ("gross_wt", r"^[0-9]{1,3}\.[0-9]{2,3}$", "bottom", True),
)
VALID = {"lr_no": r"^[A-Z]{0,3}[0-9]{7,12}$", "shipment_no": r"^[0-9]{7,9}$"}
TOP_SHARE, Y_WEIGHT, SECTION_GAP, UNSURE = 0.4, 10, 3.0, 60
ACKNOWLEDGED = ("received_wt", "received_date", "remark")


def targeted(page: DataFrame, found: str = "phrases") -> DataFrame:
    """Pages with `found_<field>`: the text of the field's shape in its part of the page that is nearest to its label (heights count tenfold), or,
    for a field without one, the first in reading order.

    The fields are taken in order and the state is the boxes taken so far: a phrase that one field has is not another's.
    """
    bounds = lambda p: F.struct(*[p[k].alias(k) for k in ("x1", "y1", "x2", "y2")])
    joined = lambda p: F.upper(F.regexp_replace(p["text"], "[^A-Za-z0-9.]+", ""))
    centre = lambda p: (p["y1"] + p["y2"]) / 2

    def first(name: str, shape: str, part: str, by_label: bool, taken: list[Column]) -> Column:
        a = F.col(f"anchor_{name}")

        def order(p: Column) -> Column:
            reading = F.struct(centre(p).alias("o"), p["x1"].alias("x"))
            if not by_label:
                return reading
            far = F.pow(p["x1"] - (a["x1"] + a["x2"]) / 2, 2) + F.pow(Y_WEIGHT * (centre(p) - centre(a)), 2)
            return F.when(a.isNotNull(), F.struct(far.alias("o"), F.lit(0.0).alias("x"))).otherwise(reading)

        def entry(p: Column, i: Column) -> Column:
            here = centre(p) < F.col("height") * TOP_SHARE if part == "top" else centre(p) >= F.col("height") * TOP_SHARE
            free = ~F.coalesce(F.exists(F.array(*taken), lambda b: b == bounds(p)), F.lit(False)) if taken else F.lit(True)
            return F.when(here & joined(p).rlike(shape) & free, F.struct(order(p).alias("order"), i.alias("i"), joined(p).alias("text"), bounds(p).alias("bounds")))

        return F.array_min(F.filter(F.transform(found, entry), lambda x: x.isNotNull()))

    taken: list[Column] = []
    for name, shape, part, by_label in TARGETS:
        page = page.withColumn(f"_t_{name}", first(name, shape, part, by_label, taken))
        taken.append(F.col(f"_t_{name}.bounds"))
    return page.withColumns({f"found_{name}": F.col(f"_t_{name}.text") for name, *_ in TARGETS}).drop(*[f"_t_{name}" for name, *_ in TARGETS])


def sectioned(page: DataFrame, gap: float = SECTION_GAP) -> DataFrame:
    """J27, W7, U6 in place: pages with `segments`: phrases from the top down, each with its `section`.

    Sections are numbered as they first occur, those of printed boxes before the others. What no box holds is parted where the gap to the segment before is
    more than three times its usual height.
    """
    p = page.withColumn("_phrases", pages.phrases_at_once(F.col("words"), 1.2)).withColumn("_all", F.transform(F.array_sort(F.transform("_phrases", lambda x: F.struct(x["y1"], x["x1"], x["text"], x.alias("p")))), lambda x: x["p"])).drop("_phrases")
    holds = lambda b, s: ((s["x1"] + s["x2"]) / 2).between(b["x1"], b["x2"]) & ((s["y1"] + s["y2"]) / 2).between(b["y1"], b["y2"])
    p = p.withColumn("_box", F.transform("_all", lambda s: F.array_position(F.transform("boxes", lambda b: holds(b, s)), True)))
    p = p.withColumns({"_order": F.array_distinct(F.filter("_box", lambda x: x > 0)), "_loose": F.filter("_all", lambda s, i: F.get("_box", i) == 0)})
    p = p.withColumn("_unit", tables.unit(F.transform("_loose", lambda s: s["y2"] - s["y1"])))
    spot = "struct<section: int, s: %s>" % pages.PHRASE

    def step(state: Column, s: Column) -> Column:
        return bind(state["no"] + F.when(s["y1"] - state["bottom"] > gap * F.col("_unit"), 1).otherwise(0), lambda no: F.struct(no.alias("no"), s["y2"].alias("bottom"), F.concat(state["out"], F.array(F.struct(no.alias("section"), s.alias("s")).cast(spot))).alias("out")))

    start = F.struct(F.size("_order").alias("no"), F.lit(None).cast("double").alias("bottom"), F.array().cast(f"array<{spot}>").alias("out"))
    boxed = F.filter(F.transform("_all", lambda s, i: F.struct((F.array_position("_order", F.get("_box", i)) - 1).cast("int").alias("section"), s.alias("s")).cast(spot)), lambda x: x["section"] >= 0)
    return p.withColumn("segments", F.concat(boxed, F.aggregate("_loose", start, step)["out"])).drop("_all", "_box", "_order", "_loose", "_unit")


def acknowledged(page: DataFrame, lines: int = 6, row_lines: int = 4) -> DataFrame:
    """E9, J30 in place: pages with `ack`: what is written in the three cells under the topmost heading, from words of the variant `ink`.

    Weight and date keep digits, points and strokes only; a remark is kept as it is, with its mean confidence, and is unsure below 60. Without the heading or one
    of the three captions within six text heights below it nothing is read and zone_found is false.
    """
    low = lambda w: F.lower(w["text"])
    entry = lambda w: F.struct(w["top"].alias("top"), w["left"].alias("left"), w["width"].alias("width"), w["height"].alias("height"))
    topmost = lambda test, ws: F.array_min(F.transform(F.filter(ws, test), entry))
    p = page.withColumns({"_ink": F.filter("all_words", lambda w: w["variant"] == "ink"), "_print": F.filter("all_words", lambda w: F.coalesce(w["variant"] == "original", F.lit(True)))})
    p = p.withColumn("_head", F.coalesce(topmost(lambda w: low(w).contains("acknowledgement"), "_print"), topmost(lambda w: low(w).contains("received"), "_print")))
    band = F.filter("_print", lambda w: F.coalesce((w["top"] >= F.col("_head.top") + F.col("_head.height")) & (w["top"] <= F.col("_head.top") + (1 + lines) * F.col("_head.height")), F.lit(False)))
    p = p.withColumn("_band", band)
    tests = {"received_wt": lambda w: low(w).contains("received"), "received_date": lambda w: low(w) == "date", "remark": lambda w: low(w).contains("remark")}
    caption = lambda n: bind(topmost(tests[n], "_band"), lambda c: F.when(c.isNotNull(), F.struct(c["left"].alias("left"), F.lit(n).alias("name"), c["top"].alias("top"), c["width"].alias("width"), c["height"].alias("height"))))
    p = p.withColumn("_caps", F.array_sort(F.filter(F.array(*[caption(n) for n in ACKNOWLEDGED]), lambda c: c.isNotNull())))

    def cell(c: Column, i: Column) -> Column:
        top = c["top"] + c["height"]
        return F.struct(c["name"].alias("name"), pages.zone(c["left"], top, F.coalesce(F.get("_caps", i + 1)["left"], c["left"] + 4 * c["width"]), top + row_lines * F.col("_head.height")).alias("zone"))

    p = p.withColumn("_cells", F.when(F.size("_caps") == 3, F.transform("_caps", cell)))
    inside = lambda n: bind(F.get(F.filter("_cells", lambda c: c["name"] == n), F.lit(0))["zone"], lambda z: F.filter(pages.within(F.col("_ink"), z), lambda w: (F.trim(w["text"]) != "") & (w["conf"] != -1)))
    p = p.withColumns({f"_{n}": F.when(F.col("_cells").isNotNull(), inside(n)) for n in ACKNOWLEDGED})
    text = lambda n: F.coalesce(F.array_join(F.transform(f"_{n}", lambda w: w["text"]), " "), F.lit(""))
    sure = F.coalesce(F.aggregate("_remark", F.lit(0.0), lambda a, w: a + w["conf"]) / F.nullif(F.size("_remark"), F.lit(0)), F.lit(0.0))
    ack = F.struct(
        F.regexp_replace(text("received_wt"), "[^0-9.]", "").alias("received_wt"), F.regexp_replace(text("received_date"), "[^0-9./]", "").alias("received_date"), text("remark").alias("remark"),
        F.round(sure, 1).alias("remark_confidence"), ((text("remark") != "") & (sure < UNSURE)).alias("low_confidence"), F.col("_cells").isNotNull().alias("zone_found"),
    )
    return p.withColumn("ack", ack).drop("_ink", "_print", "_head", "_band", "_caps", "_cells", *[f"_{n}" for n in ACKNOWLEDGED])


def section_fields(page: DataFrame) -> DataFrame:
    """(doc_id, page_no, idx, key, value): labels and values of each section by itself, names numbered over the page's sections in order."""
    s = page.select(F.struct("doc_id", "page_no").alias("doc_id"), F.explode("segments").alias("x"))
    p = F.col("x.s")
    rows = s.select("doc_id", F.col("x.section").alias("page_no"), p["x1"].cast("int").alias("left"), p["y1"].cast("int").alias("top"), (p["x2"] - p["x1"]).cast("int").alias("width"), (p["y2"] - p["y1"]).cast("int").alias("height"), p["confidence"].alias("conf"), p["text"].alias("text"))
    found = layout.label_values(layout.prepared(rows), ("doc_id",))
    return found.select("doc_id.doc_id", "doc_id.page_no", F.col("key_ord").alias("idx"), "key", "value")


def legacy_flow(words: DataFrame, boxes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, page_no, the fields of SYNONYMS, fields, confidence_avg, and six of the acknowledgement) of pages of receipts.

    `fields` has what the page prints under its own names; a field that has a name of its own is aliased to it, overridden by what `targeted` finds, and dropped
    where its shape is wrong. words: variants original, processed and ink, or none. A page without labels has an empty map.
    """
    page = pages.gathered(words=words, boxes=boxes, sizes=sizes).withColumn("all_words", F.col("words"))
    page = pages.better_words(page.withColumn("words", F.filter("words", lambda w: F.coalesce(w["variant"] != "ink", F.lit(True)))))
    page = matching.with_anchors(page, "phrases", {n: SYNONYMS[n] for n, _, _, near in TARGETS if near}, guard=None)
    page = acknowledged(sectioned(targeted(page)))
    sure = F.filter(F.transform("segments", lambda x: x["s"]["confidence"]), lambda c: c > 0)
    mean = F.coalesce(F.round(F.aggregate(sure, F.lit(0.0), lambda a, c: a + c) / F.nullif(F.size(sure), F.lit(0)), 4), F.lit(0.0))
    page = written(page.select(*pages.PAGE, "segments", "ack", mean.alias("confidence_avg"), *[f"found_{n}" for n, *_ in TARGETS]))

    generic = written(extract.trusted_fields(section_fields(page), lenient=True))
    texts = generic.select(*pages.PAGE, "idx", F.lower(F.replace("key", F.lit("_"), F.lit(" "))).alias("text"))
    aliased = matching.greedy_assign(matching.synonym_matches(texts, SYNONYMS, pages.PAGE, matching.RECORD_THRESHOLD), pages.PAGE)
    both = generic.join(aliased.drop("score"), [*pages.PAGE, "idx"], "left")
    wide = both.groupBy(*pages.PAGE).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("fields"), *[F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in SYNONYMS])
    out = page.join(wide, pages.PAGE, "left").withColumn("fields", F.coalesce("fields", F.create_map().cast("map<string,string>")))
    named = {n: F.when(F.map_contains_key("fields", n), F.col("fields")[n]).otherwise(F.col(n)) for n in SYNONYMS}
    for n, *_ in TARGETS:
        named[n] = F.coalesce(F.col(f"found_{n}"), named[n])
    for n, shape in VALID.items():
        named[n] = extract.shaped(named[n], shape)
    for n in ("net_wt", "gross_wt"):
        named[n] = bind(named[n], lambda v: F.when((v != "") & ~v.rlike("[A-Za-z]"), v))
    ack = {"received_wt_handwritten": "received_wt", "received_date_handwritten": "received_date", "remark_handwritten": "remark", "remark_handwritten_confidence": "remark_confidence", "remark_handwritten_low_confidence": "low_confidence", "acknowledgement_zone_found": "zone_found"}
    return out.select(*pages.PAGE, *[c.alias(n) for n, c in named.items()], "fields", "confidence_avg", *[F.col(f"ack.{b}").alias(a) for a, b in ack.items()])
