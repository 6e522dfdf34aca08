"""Windows over one long run of rows, cut into segments: what a row needs of those before it, without a task that holds the run.

A run (of `keys`, in the order of one column) is cut where its order is. Inside a segment a plain window does the work, and segments are many tasks. What crosses a
border is one row a segment, its last values and its total, and a window over these carries them on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Values of the order, as a whole number, that a segment spans.
SPAN = 100_000


def segment(order: str, span: int = SPAN) -> Column:
    return F.floor(F.col(order).cast("double") / span)


def with_previous(rows: DataFrame, keys: list[str], order: str, values: list[str], span: int = SPAN) -> DataFrame:
    """rows with `prev_<value>` for each value: that of the row before in the run's order, null for the first; and the column `_segment`."""
    s = rows.withColumn("_segment", segment(order, span))
    inside = Window.partitionBy(*keys, "_segment").orderBy(order)
    last = s.groupBy(*keys, "_segment").agg(F.max_by(F.struct(*values), order).alias("_last"))
    before = last.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_segment"))).where("_before is not null").drop("_last")
    s = s.withColumn("_nth", F.row_number().over(inside)).withColumns({f"prev_{v}": F.lag(v).over(inside) for v in values})
    same = [F.col(f"_s.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in [*keys, "_segment"]]
    both = s.alias("_s").join(before.alias("_b"), same, "left")
    carried = {f"prev_{v}": F.when(F.col("_nth") == 1, F.col(f"_b._before.{v}")).otherwise(F.col(f"_s.prev_{v}")) for v in values}
    return both.select(*[F.col(f"_s.{c}") for c in [*rows.columns, "_segment"]], *[c.alias(n) for n, c in carried.items()])


def running_total(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, span: int = SPAN) -> DataFrame:
    """rows with `name`: the sum of `value` over the run up to the row and with it."""
    s = (rows if "_segment" in rows.columns else rows.withColumn("_segment", segment(order, span))).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_segment").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = s.groupBy(*keys, "_segment").agg(F.sum("_v").alias("_t"))
    base = totals.withColumn("_base", F.sum("_t").over(Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1))).where("_base is not null").drop("_t")
    same = [F.col(f"_s.{c}").eqNullSafe(F.col(f"_b.{c}")) for c in [*keys, "_segment"]]
    both = s.withColumn("_sum", F.sum("_v").over(inside)).alias("_s").join(base.alias("_b"), same, "left")
    return both.select(*[F.col(f"_s.{c}") for c in rows.columns if c != "_segment"], (F.col("_s._sum") + F.coalesce(F.col("_b._base"), F.lit(0))).alias(name))
