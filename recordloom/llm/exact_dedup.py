"""Exact copies, in DataFrame operations only: heavy digests are settled where they are, all others meet in a shuffle.

Texts are equal if they are once white space is deleted. A frequent-items sketch (the batched form of Misra and Gries: a bounded
number of counters a task, all lowered together when they are full) goes over the digests once and is merged in a tree; it misses no
digest with more than a HOT-th of the rows. Its candidates are counted exactly, with the row that stays of each; those that are as
frequent as that, fewer than HOT of them, are broadcast and settle their rows without moving them. In the shuffle of the other digests no
key has more than a HOT-th of the rows, and texts never move: a row is an id, a length and a digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordloom.llm.common import checkpointed

#: White space that does not count.
BLANKS = " \t\n\x0b\x0c\r"
#: A digest is heavy with more than a HOT-th of the rows. COUNTERS of the sketch: its error, below rows / 2,000, is less than half of that.
HOT, COUNTERS = 1000, 6144


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digested(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, chars, digest, row_id, and the columns `keep`): a written table, so that row_id tells even repeated rows apart from now on."""
    digest = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    chars = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    return checkpointed(docs.select("doc_id", chars.alias("chars"), digest.alias("digest"), F.monotonically_increasing_id().alias("row_id"), *keep))


def rank() -> list[Column]:
    """The order in which equal texts stay: most code points first, then the smallest id, null ids last, then the first row."""
    return [(-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.col("row_id").alias("row_id")]


def heavy_winners(rows: DataFrame, hot: int = HOT, counters: int = COUNTERS) -> DataFrame:
    """(digest, n, winner) of the digests with more than a `hot`-th of the rows: fewer than `hot`, verified by exact counts."""
    total = rows.count()  # one number
    frequent = rows.agg(F.expr(f"approx_top_k(digest, {min(2 * hot, counters)}, {counters})").alias("top"))
    candidates = frequent.select(F.explode("top").alias("t")).select(F.col("t.item").alias("digest")).where("digest is not null")
    exact = rows.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct(*rank())).alias("winner"))
    return checkpointed(exact.where(F.col("n") * hot > total))


def groups(rows: DataFrame, hot: int = HOT, counters: int = COUNTERS) -> DataFrame:
    """The columns of `rows` (as `digested` makes them) with keep_id, group_size and kept."""
    heavy = heavy_winners(rows, hot, counters)
    columns = rows.columns
    settled = rows.join(F.broadcast(heavy), "digest").select(*columns, F.col("winner.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row_id") == F.col("winner.row_id")).alias("kept"))
    alike = Window.partitionBy("digest").orderBy(*[F.asc(c) for c in ("less", "nameless", "doc_id", "row_id")]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    less, nameless, *_ = rank()
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(*columns, less, nameless)
    rest = rest.withColumns({"keep_id": F.first("doc_id").over(alike), "group_size": F.count("*").over(alike), "kept": F.col("row_id") == F.first("row_id").over(alike)})
    return settled.unionByName(rest.drop("less", "nameless"))


def exact_groups(docs: DataFrame, hot: int = HOT, counters: int = COUNTERS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every document.

    Of equal texts the row with the most code points stays, then that of the smallest id; null ids come after all others, and of
    rows alike in both the first of the table. So one row of each group is kept whatever repeats; keep_id is its id, null if that
    is. Null and blank texts are all equal to the empty one. An empty table gives no rows. Other columns are not read.
    """
    found = groups(digested(docs), hot, counters)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def deduplicated(docs: DataFrame, hot: int = HOT, counters: int = COUNTERS) -> DataFrame:
    """The documents without exact copies, with all their columns. Rows travel with their texts here, so the written table has them too."""
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    return groups(digested(packed, ("row",)), hot, counters).where("kept").select("row.*")
