"""Connected components of an edge table by hooking and pointer jumping, all as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import checkpointed, release


#: Rows for each file of a small table, and the files that it has at least.
FILE_ROWS, LEAST_FILES = 100_000, 12


def compact(df: DataFrame, rows: int) -> DataFrame:
    """A table of at most `rows` short rows, written in no more files than these need: each file is a task of every step that reads it."""
    return checkpointed(df.coalesce(max(LEAST_FILES, rows // FILE_ROWS)))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a, b: long); root is the smallest node of its component.

    Each round every node takes the smallest label around it, offers that to its old label's node, and
    follows its label once. Labels only fall, so the rounds are logarithmic in practice; the state is
    checkpointed each round, and only counts reach the driver. Self-loops and repeated
    edges do no harm; an empty table gives an empty result.
    """
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = checkpointed(edges.where("a <> b").select(F.explode(ends).alias("e")).select("e.*").distinct())
    n = both.count()
    if n and both.rdd.getNumPartitions() > max(LEAST_FILES, n // FILE_ROWS):
        both = compact(both, n)
    state = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root"))
    state = compact(state, n)
    while n:
        label = state.select(F.col("node").alias("b"), F.col("root").alias("theirs"))
        around = both.join(label, "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("theirs"))
        seen = state.join(around, "node").select("node", F.col("root").alias("was"), F.least("root", "theirs").alias("root"))
        own, other = F.struct("node", "root", "was"), F.struct(F.col("was").alias("node"), "root", F.lit(None).cast("long").alias("was"))
        offers = seen.select(F.explode(F.when(F.col("root") < F.col("was"), F.array(own, other)).otherwise(F.array(own))).alias("o")).select("o.*")
        hooked = offers.groupBy("node").agg(F.min("root").alias("root"), F.min("was").alias("was"))
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        new = compact(hooked.join(up, "root").select("node", F.least("root", "upper").alias("root"), "was"), n)
        changed = new.where("root <> was").limit(1).count()
        state = new.select("node", "root")
        release(edges.sparkSession)
        if not changed:
            break
    return state
