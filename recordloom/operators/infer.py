"""What the columns of untyped text tables mean: from captions, shapes of values, and products among them.

Tables are in long form: table_id, row_idx, col_idx, text. Every step is grouped by table, so any number of tables is
inferred at once, and the names are joined back to the cells as rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.functions import text as X
from recordloom.functions import validators as V
from recordloom.operators.segmented import SPAN, segment
from recordloom.session import written

SHARE, TRIPLE_SHARE, TRIPLE_TOLERANCE = 0.7, 0.7, 0.02
SHAPES = (("timestamp", V.TIMESTAMP_SHAPE), ("date", V.DATE_SHAPE), ("decimal", V.DECIMAL_SHAPE), ("digits", V.DIGITS_SHAPE), ("alphanumeric", V.CODE_SHAPE), ("alpha", V.ALPHA_SHAPE))
#: Names of column types, and of the fields that a factor of a product can be.
GENERIC = ("timestamp_like", "date_like", "decimal_currency", "alphanumeric_code", "small_sequential_int", "large_numeric_code", "free_text", "qty_or_rate")
FACTORS = ("gross_qty", "charge_qty", "rate", "amount")


def filled(cells: DataFrame) -> DataFrame:
    return cells.withColumn("text", X.strip("text")).where("text <> ''")


def hit_rates(cells: DataFrame) -> DataFrame:
    """A4: per column the share of filled cells that has each shape."""
    rates = [F.avg(F.col("text").rlike(p).cast("int")).alias(f"{n}_rate") for n, p in SHAPES]
    return filled(cells).groupBy("table_id", "col_idx").agg(F.count("*").alias("n_values"), *rates)


def sequential(cells: DataFrame, span: int = SPAN) -> DataFrame:
    """A5: per column whether all values are whole numbers, at least three, and 70 % of their steps lie in 0..5.

    A column is summed in stretches of `span` rows, each a task's work, as (first, last, count, near steps); the steps between stretches are taken from these.
    """
    n = filled(cells).withColumn("n", F.when(F.col("text").rlike(r"^[+-]?[0-9]{1,18}\z"), F.col("text").try_cast("bigint"))).withColumn("_part", segment("row_idx", span))
    step = F.col("n") - F.lag("n").over(Window.partitionBy("table_id", "col_idx", "_part").orderBy("row_idx"))
    parts = n.withColumn("step", step).groupBy("table_id", "col_idx", "_part")
    parts = parts.agg(F.count("*").alias("size"), F.count("n").alias("whole"), F.count_if(F.col("step").between(0, 5)).alias("near"), F.min_by("n", "row_idx").alias("first"), F.max_by("n", "row_idx").alias("last"))
    across = F.col("first") - F.lag("last").over(Window.partitionBy("table_id", "col_idx").orderBy("_part"))
    s = parts.withColumn("_over", F.coalesce(across.between(0, 5), F.lit(False)).cast("int")).groupBy("table_id", "col_idx")
    s = s.agg(F.sum("size").alias("size"), F.sum("whole").alias("whole"), F.sum(F.col("near") + F.col("_over")).alias("near"))
    ok = (F.col("size") == F.col("whole")) & (F.col("size") >= 3) & (F.col("near") >= (F.col("size") - 1) * SHARE)
    return s.select("table_id", "col_idx", ok.alias("is_sequential"))


def _kind(at: Callable[[str], Column], counting: Column) -> Column:
    """The type of a column from the shapes that enough of its cells have, and whether they count."""
    return (
        F.when(at("timestamp"), "timestamp_like").when(at("date"), "date_like").when(at("decimal"), "decimal_currency")
        .when(at("digits") & counting, "small_sequential_int").when(at("digits"), "large_numeric_code")
        .when(at("alphanumeric"), "alphanumeric_code").otherwise("free_text")
    )


def column_types(cells: DataFrame) -> DataFrame:
    """table_id, col_idx, column_type; columns without values are not listed."""
    c = hit_rates(cells).join(sequential(cells), ["table_id", "col_idx"])
    at = lambda n: F.col(f"{n}_rate") >= SHARE
    return c.select("table_id", "col_idx", _kind(at, F.col("is_sequential")).alias("column_type"))


def column_facts(cells: DataFrame, span: int = SPAN) -> DataFrame:
    """A4, A5, A6, A7 at once: (table_id, col_idx, column_type, numeric) of every column that occurs; no type without a filled cell.

    As in `sequential` a column is summed in stretches of `span` rows; shares of shapes and of decimals are counted along, so cells move once.
    """
    c = cells.select("table_id", "col_idx", "row_idx", X.strip("text").alias("text")).withColumn("_filled", F.coalesce(F.col("text") != "", F.lit(False)))
    n = c.withColumn("n", F.when(F.col("text").rlike(r"^[+-]?[0-9]{1,18}\z"), F.col("text").try_cast("bigint"))).withColumn("_part", segment("row_idx", span))
    by = ["table_id", "col_idx", "_filled"]
    step = F.col("n") - F.lag("n").over(Window.partitionBy(*by, "_part").orderBy("row_idx"))
    shapes = {n: F.count_if(F.col("text").rlike(p)).alias(n) for n, p in SHAPES}
    parts = n.withColumn("step", step).groupBy(*by, "_part").agg(
        F.count("*").alias("size"), F.count("n").alias("whole"), F.count_if(F.col("step").between(0, 5)).alias("near"), F.min_by("n", "row_idx").alias("first"), F.max_by("n", "row_idx").alias("last"),
        F.count(X.as_float("text")).alias("floats"), *shapes.values(),
    )
    across = F.col("first") - F.lag("last").over(Window.partitionBy(*by).orderBy("_part"))
    sums = parts.withColumn("near", F.col("near") + F.coalesce(across.between(0, 5), F.lit(False)).cast("int")).groupBy("table_id", "col_idx")
    s = sums.agg(*[F.coalesce(F.sum(F.when(F.col("_filled"), F.col(k))), F.lit(0)).alias(k) for k in ("size", "whole", "near", "floats", *shapes)])
    size, counting = F.nullif("size", F.lit(0)), (F.col("size") == F.col("whole")) & (F.col("size") >= 3) & (F.col("near") >= (F.col("size") - 1) * SHARE)
    return s.select("table_id", "col_idx", F.when(F.col("size") > 0, _kind(lambda k: F.col(k) / size >= SHARE, counting)).alias("column_type"), F.coalesce(F.col("floats") / size >= 0.5, F.lit(False)).alias("numeric"))


def numeric_columns(cells: DataFrame) -> DataFrame:
    """Columns of which half the filled cells at least are decimals once other characters are off."""
    c = filled(cells).groupBy("table_id", "col_idx").agg(F.avg(X.as_float("text").isNotNull().cast("int")).alias("numeric_rate"))
    return c.where("numeric_rate >= 0.5")


def product_matches(x: Column, y: Column, z: Column) -> Column:
    """Z is x * y within 2 %, or would be with one digit more in front."""
    near = lambda c: F.abs(x * y - c) <= F.abs(c) * TRIPLE_TOLERANCE
    width = F.length(F.floor(F.abs(z)).cast("string"))
    return near(z) | F.exists(F.sequence(F.lit(0), F.lit(9)), lambda d: near(d * F.pow(F.lit(10.0), width) + z))


def product_triples(cells: DataFrame, numeric: DataFrame | None = None) -> DataFrame:
    """table_id, factor_a, factor_b, product: of all triples of numeric columns the one with the best share of matching rows.

    Tried are rows where all three parse and the product is not 0, three at least; 70 % must match; ties go to the first
    triple. numeric: the numeric columns (table_id, col_idx), if they are known. A row's cells meet in one list, after columns that are not numeric are out: one shuffle and no join of rows; a row of k numeric
    columns still makes about k ** 3 / 2 triples, which are counted before they are sent.
    """
    numeric = numeric_columns(cells) if numeric is None else numeric
    n = cells.join(numeric.select("table_id", "col_idx"), ["table_id", "col_idx"]).select("table_id", "row_idx", "col_idx", X.as_float("text").alias("v")).where("v is not null")
    rows = n.groupBy("table_id", "row_idx").agg(F.collect_list(F.struct("col_idx", "v")).alias("cells"))
    pairs = rows.select("table_id", "cells", F.explode("cells").alias("a")).select("table_id", "cells", "a", F.explode("cells").alias("b")).where("a.col_idx < b.col_idx")
    triples = pairs.select("table_id", "a", "b", F.explode("cells").alias("c")).where("c.col_idx <> a.col_idx and c.col_idx <> b.col_idx and c.v <> 0")
    triples = triples.select("table_id", *[F.col(f"{k}.col_idx").alias(k) for k in "abc"], *[F.col(f"{k}.v").alias(f"v{k}") for k in "abc"])
    rated = triples.groupBy("table_id", "a", "b", "c").agg(F.count("*").alias("tried"), F.avg(product_matches(F.col("va"), F.col("vb"), F.col("vc")).cast("int")).alias("share"))
    good = rated.where((F.col("tried") >= 3) & (F.col("share") >= TRIPLE_SHARE))
    best = good.groupBy("table_id").agg(F.min_by(F.struct("a", "b", "c", "share"), F.struct(-F.col("share"), "a", "b", "c")).alias("t"))
    return best.select("table_id", F.col("t.a").alias("factor_a"), F.col("t.b").alias("factor_b"), F.col("t.c").alias("product"), F.col("t.share").alias("share"))


def classify_columns(cells: DataFrame, captions: DataFrame | None = None) -> DataFrame:
    """table_id, col_idx, name for every column that occurs.

    `captions` (table_id, col_idx, field) are the fields that captions were matched to. A caption's field wins, except on
    a column of the product triple where it is none of quantity, rate and amount; then the triple, then the type. If one
    factor has a name of gross_qty and rate and the other has none, the other gets what is left.
    """
    facts = written(column_facts(cells))
    t = product_triples(cells, facts.where("numeric")).drop("share")
    c = facts.drop("numeric").join(t, "table_id", "left")
    if captions is None:
        c = c.withColumn("field", F.lit(None).cast("string"))
    else:
        c = c.join(captions.select("table_id", "col_idx", "field"), ["table_id", "col_idx"], "left")
    is_factor = F.coalesce((F.col("col_idx") == F.col("factor_a")) | (F.col("col_idx") == F.col("factor_b")), F.lit(False))
    in_triple = is_factor | F.coalesce(F.col("col_idx") == F.col("product"), F.lit(False))
    by_caption = F.when(~in_triple | F.col("field").isin(*FACTORS), F.col("field"))
    by_triple = F.when(is_factor, "qty_or_rate").when(in_triple, "amount")
    c = c.withColumn("is_factor", is_factor).withColumn("name", F.coalesce(by_caption, by_triple, "column_type", F.concat(F.lit("unclassified_col_"), (F.col("col_idx") + 1).cast("string"))))
    w = Window.partitionBy("table_id")
    named = lambda n: F.max((F.col("is_factor") & (F.col("name") == n)).cast("int")).over(w)
    c = c.withColumns({"_qty": named("gross_qty"), "_rate": named("rate"), "_open": F.sum((F.col("is_factor") & (F.col("name") == "qty_or_rate")).cast("int")).over(w)})
    other = F.when(F.col("_qty") > F.col("_rate"), "rate").when(F.col("_rate") > F.col("_qty"), "gross_qty")
    last = F.when(F.col("is_factor") & (F.col("name") == "qty_or_rate") & (F.col("_open") == 1), other)
    return c.select("table_id", "col_idx", F.coalesce(last, "name").alias("name"))


def unique_names(names: DataFrame, keys: list[str], order: str, name: str = "name") -> DataFrame:
    """The k-th repeat of a name within its keys gets _k; a suffix that makes a name which is there already is passed over.

    Names that end in such a suffix are looked up by what stands before it, so only they travel; repeats of a name that has
    none are numbered by a window alone.
    """
    shape = r"^(.*)_([0-9]{1,9})$"
    taken = names.where(F.col(name).rlike(shape)).select(*[F.col(k).alias(f"_{k}") for k in keys], F.regexp_extract(name, shape, 1).alias("_base"), F.regexp_extract(name, shape, 2).cast("int").alias("_k"))
    taken = taken.groupBy(*[f"_{k}" for k in keys], "_base").agg(F.collect_set("_k").alias("_taken"))
    n = names.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, name).orderBy(order)))
    same = F.col(name) == F.col("_base")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    n = n.join(taken, same, "left").drop("_base", *[f"_{k}" for k in keys])
    free = F.filter(F.sequence(F.lit(2), F.size("_taken") + F.col("_nth") + 1), lambda k: ~F.array_contains(F.col("_taken"), k))
    suffix = F.when(F.col("_taken").isNull(), F.col("_nth")).otherwise(F.element_at(free, F.greatest(F.col("_nth") - 1, F.lit(1))))
    return n.withColumn(name, F.when(F.col("_nth") == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), suffix.cast("string")))).drop("_nth", "_taken")


def column_names(classified: DataFrame, captions: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """table_id, col_idx, name: the client's own names where configured, else what was inferred, else the cleaned caption, else col_N; made unique.

    captions: table_id, col_idx, caption. configured: table_id, col_idx, name of tables whose client has a column list.
    """
    c = classified.join(captions.select("table_id", "col_idx", X.caption_key("caption").alias("_caption")), ["table_id", "col_idx"], "left")
    vague = F.col("name").startswith("unclassified_col_") | F.col("name").isin(*GENERIC)
    own = F.when(vague, F.coalesce(F.nullif("_caption", F.lit("")), "name")).otherwise(F.col("name"))
    if configured is not None:
        has = configured.select("table_id").distinct().withColumn("_has", F.lit(True))
        c = c.join(configured.select("table_id", "col_idx", F.col("name").alias("_set")), ["table_id", "col_idx"], "left").join(has, "table_id", "left")
        own = F.when(F.col("_has"), F.col("_set")).otherwise(own)
    filled_in = F.coalesce(F.nullif(own, F.lit("")), F.concat(F.lit("col_"), (F.col("col_idx") + 1).cast("string")))
    return unique_names(c.select("table_id", "col_idx", filled_in.alias("name")), ["table_id"], "col_idx")
