"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document i of source g gets a rate r_i, the number of times it is taken. Among all rates that meet
the token constraints sum_i s_i r_i = T_g (s_i: the document's words) and 0 <= r_i <= cap, the mix has the
one of least relative entropy to "each document once", sum_i (s_i / x_i) (r_i log r_i - r_i), where x_i in
[1, 2] is 1 + log(1 + s_i) / log(1 + the source's longest). Its convex dual has one multiplier a source,
and its optimum is the exponential tilt r_i = min(cap, exp(lambda_g x_i)): longer documents carry a little
more of the change. lambda is found by Newton steps, each of which sums gradient and curvature over all
documents, kept inside a bracket that is known beforehand. Rates are then rounded to whole copies.

Documents of one source and size have one rate, so the sums run over cells (source, size, documents):
the documents are aggregated once, before any shuffle, and every Newton step reads only cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.llm.common import checkpointed

WORDS = r"[^\x20\x09-\x0D]+"
#: Documents a rounding bucket holds on average.
BUCKET = 100_000


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): size is the number of words; null text has none."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"))


def source_targets(per_source: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size, longest, target) from (source, source_size, longest).

    Sources by code point, null last, take the weights in turn and share the sum of all sizes; a target stops
    at `cap` times its source's size and the excess is shared again by weight until none is above. Solved in
    one pass: with sources ordered by cap * size / weight, the first k stop at their cap and the others get
    weight * level, where k is the smallest number that leaves the next source under its cap. The windows run
    over the table of sources, a row for each.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = per_source.withColumn("weight", share).withColumn("most", F.lit(cap) * F.col("source_size"))
    by_cap = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    on = by_cap.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    s = s.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(on))
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "level"))).over(whole)["level"])
    return s.select("source", "source_size", "longest", F.least(F.col("weight") * F.col("level"), F.col("most")).alias("target"))


def _tilt() -> object:
    return 1 + F.log1p("size") / F.log1p("longest")


def balance(cells: DataFrame, targets: DataFrame, cap: float = 3.0, tolerance: float = 1e-10, rounds: int = 60) -> DataFrame:
    """(source, lam): the dual's solution for each source that has words and a target above zero.

    With x in [1, 2] and q = target / size, lambda lies between log(q) / 2 and log(q). A Newton step that
    leaves the bracket, which each step narrows, is replaced by its middle. Gradients are summed as decimals, so
    that reruns agree to the last digit. Only the number of unsolved sources reaches the driver.
    """
    live = targets.where("source_size > 0 and target > 0").withColumn("q", F.log(F.col("target") / F.col("source_size")))
    state = checkpointed(live.select("source", "longest", "target", F.least(F.col("q"), F.col("q") / 2).alias("lo"), F.greatest(F.col("q"), F.col("q") / 2).alias("hi"), (F.col("q") / 1.75).alias("lam"), F.lit(False).alias("done")))
    work = cells.where("size > 0").withColumnRenamed("source", "cell_source")
    for _ in range(rounds):
        r = F.exp(F.col("lam") * _tilt())
        tokens = F.col("docs") * F.col("size") * F.least(r, F.lit(cap))
        slope = F.when(r < cap, tokens * _tilt()).otherwise(0.0)
        sums = (
            state.where("not done")
            .join(work, F.col("source").eqNullSafe(F.col("cell_source")))
            .groupBy("source", "longest", "target", "lo", "hi", "lam")
            .agg(F.sum(tokens.cast("decimal(38,6)")).cast("double").alias("got"), F.sum(slope.cast("decimal(38,6)")).cast("double").alias("slope"))
        )
        over = F.col("got") - F.col("target")
        sums = sums.withColumn("lo", F.when(over < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(over > 0, F.col("lam")).otherwise(F.col("hi")))
        step = F.col("lam") - over / F.when(F.col("slope") > 0, F.col("slope"))
        inside = F.when((step >= F.col("lo")) & (step <= F.col("hi")), step).otherwise((F.col("lo") + F.col("hi")) / 2)
        solved = (F.abs(over) <= tolerance * F.col("target") + 1e-5) | (F.col("hi") - F.col("lo") < 1e-13)
        moved = sums.select("source", "longest", "target", "lo", "hi", F.when(solved, F.col("lam")).otherwise(inside).alias("lam"), solved.alias("done"))
        state = checkpointed(state.where("done").union(moved))
        if not state.where("not done").limit(1).count():
            break
    return state.select("source", F.round("lam", 11).alias("lam"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken) of every document.

    taken = copies * size, copies is the rate rounded up or down to a whole number, never above `cap`.
    Rounding is systematic: within a source, documents by falling size and then by bucket and id accumulate
    the fractional parts of their rates, and one gets its extra copy where the running sum passes a half. Two
    neighbours' errors cancel, so a source misses its target by at most half its longest document; that miss, known
    from the cells alone, is then spread over the rates of the source's documents of at most mean size. Fractions are
    whole millionths and their sums are exact. The running sum has three levels, so that no source or size, however
    common, is one task's work: over the cells of a source, over the buckets of a cell, and within a bucket.
    Null text and blank text have size 0, one copy and nothing taken. A null source is a source like any other, the
    last in order. Rows that repeat count each time. An empty table gives no rows. Other columns are not read.
    """
    sized = checkpointed(sizes(docs))
    per_size = sized.groupBy("source", "size").agg(F.count("*").alias("docs"))
    cells = checkpointed(per_size)
    per_source = cells.groupBy("source").agg(F.sum(F.col("docs") * F.col("size")).alias("source_size"), F.max("size").alias("longest"))
    targets = checkpointed(source_targets(per_source, weights, cap))
    lam = balance(cells, targets, cap).withColumnRenamed("source", "lam_source")
    known = targets.join(lam, F.col("source").eqNullSafe(F.col("lam_source")), "left").drop("lam_source").withColumnRenamed("source", "s")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("lam").isNull(), 0.0).otherwise(F.least(F.exp(F.col("lam") * _tilt()), F.lit(cap)))
    rated = cells.join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate).withColumn("millionths", F.round(F.col("rate") * 1_000_000).cast("long"))
    part = F.pmod(F.col("millionths"), F.lit(1_000_000))
    down = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    start = F.coalesce(F.sum(F.col("docs") * part).over(down), F.lit(0))
    rated = rated.withColumn("cell_start", start)
    given = F.col("docs") * F.floor(F.col("millionths") / 1_000_000) + F.floor((F.col("cell_start") + F.col("docs") * part + 500_000) / 1_000_000) - F.floor((F.col("cell_start") + 500_000) / 1_000_000)
    rated = rated.withColumn("missing", F.col("target") - F.sum(given * F.col("size")).over(whole))
    rated = rated.withColumn("small", (F.col("size") > 0) & (F.col("size") * F.sum("docs").over(whole) <= F.col("source_size")))
    tokens = F.sum(F.when(F.col("small"), F.col("docs") * F.col("size"))).over(whole)
    mended = F.round(F.col("millionths") + 1_000_000 * F.col("missing") / tokens).cast("long")
    rated = rated.withColumn("millionths", F.when(F.col("small"), F.least(F.greatest(mended, F.lit(0)), F.lit(int(cap * 1_000_000)))).otherwise(F.col("millionths")))
    rated = rated.withColumn("cell_start", start)

    total = cells.agg(F.sum("docs")).first()[0] or 0  # one number
    buckets = max(64, total // BUCKET)
    salted = sized.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    pieces = salted.groupBy("source", "size", "bucket").agg(F.count("*").alias("in_bucket"))
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("bucket_start", F.coalesce(F.sum("in_bucket").over(before), F.lit(0))).drop("in_bucket")
    pieces = pieces.alias("p").join(rated.alias("c"), F.expr("p.source <=> c.source and p.size = c.size")).select(
        F.col("p.source").alias("_source"), F.col("p.size").alias("_size"), F.col("p.bucket").alias("_bucket"), "bucket_start", "cell_start", "source_size", "target", "rate", "millionths"
    )
    ranked = salted.withColumn("k", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("doc_id")))
    found = ranked.join(pieces, F.expr("source <=> _source and size = _size and bucket = _bucket"))
    upto = F.col("cell_start") + (F.col("bucket_start") + F.col("k")) * part + 500_000
    extra = F.floor(upto / 1_000_000) - F.floor((upto - part) / 1_000_000)
    copies = (F.floor(F.col("millionths") / 1_000_000) + extra).cast("int")
    return found.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """The mix itself: each document as often as it is taken, with `copy` (instead of any column of that name) counting from 1.

    Documents not taken go.
    Rows of one doc_id are told apart by their text; rows alike in both share their copies evenly enough, since
    such rows take neighbouring places in the rounding: they get the same number of copies, the least any of them got.
    """
    plan = mix(docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash")).alias("doc_id"), "source", "text"), weights, cap)
    plan = plan.groupBy("doc_id", "source").agg(F.min("copies").alias("_copies")).select(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.text_hash").alias("_hash"), F.col("source").alias("_source"), "_copies").where("_copies > 0")
    packed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", F.xxhash64("text").alias("hash"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")) & F.col("source").eqNullSafe(F.col("_source"))
    taken = packed.join(plan, same).select("row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"))
    return taken.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "copy"], "copy")
