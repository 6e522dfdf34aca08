"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at most 2r bits apart have a common variant within r bits of both. So every distinct
fingerprint emits its whole ball of half the radius, the balls are shuffled on the variants, and
neighbours within a variant are linked. All fingerprints of one variant lie within 2r bits of each other,
so a chain through them is made of true links and loses no connection; each link is verified all the same.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from recordloom.llm.common import bounded_batches, checkpointed, text_bytes
from recordloom.llm.graph import components

CHUNK = 1 << 15
#: A key with more than a HOT-th of all rows is broadcast to them.
HOT = 1000


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; 0 without words."""
    w = text.lower().split()  # bytes: A-Z, and ASCII white space
    if not w:
        return 0
    flat = b" ".join(w)
    if len(w) <= words:
        shingles = [flat]
    else:
        ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        starts = np.concatenate([[0], ends[: -words]])
        shingles = [flat[a:b] for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)]
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(shingles), CHUNK):
        part = shingles[i : i + CHUNK]
        h = np.fromiter((digest(s, seed) for s in part), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(shingles)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def majority(hashes: np.ndarray) -> int:
    """The unsigned 64-bit SimHash of unsigned hashes: a bit is 1 if it is set in over half of them; 0 without any."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(np.ascontiguousarray(hashes[i : i + CHUNK]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null text has no words."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t, words, seed) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])
    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(run, kind)


def ball(radius: int) -> list[int]:
    """Masks of all variants within `radius` bits, as signed longs; the first is 0."""
    sets = [s for r in range(radius + 1) for s in combinations(range(64), r)]
    return [m - (1 << 64) if (m := sum(1 << b for b in s)) >> 63 else m for s in sets]


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` at most `radius` bits apart, enough to connect all that are linked.

    `radius` is even. A variant has at most 1 + 64 fingerprints for radius 2, so no group grows with the data.
    """
    if radius % 2:
        raise ValueError("an even radius is needed: each side covers half of it")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    balls = fps.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    by = Window.partitionBy("variant").orderBy("fp")
    pairs = balls.withColumn("prev", F.lag("fp").over(by)).where("prev is not null").select(F.col("prev").alias("a"), F.col("fp").alias("b")).distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def with_owner(marked: DataFrame, owner: DataFrame, key: str, total: int) -> DataFrame:
    """marked joined to owner (key, n, component_id), whose keys are unique and n of `total` rows each.

    Fewer than HOT keys have more than a HOT-th of the rows: these are broadcast, and their rows stay where they are. All
    others meet in a join in which no key has more than that.
    """
    hot = F.broadcast(owner.where(F.col("n") * HOT > total).drop("n"))
    rare = owner.where(F.col("n") * HOT <= total).drop("n")
    return marked.join(hot, key).unionByName(marked.join(hot.select(key), key, "left_anti").join(rare, key))


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    fingerprint: 16 hex digits; component_id: the smallest doc_id that links reach, itself included.
    Copies share a fingerprint and enter the search once. Null or blank texts have fingerprint zero and are
    linked like any other; repeated rows stay; a component whose ids are all null has a null component_id;
    an empty table gives no rows. Other columns are not read.
    """
    marked = checkpointed(fingerprints(docs, words, seed))
    nodes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = components(links(nodes, radius))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp").groupBy("root").agg(F.min("first").alias("lowest"))
    owner = roots.join(named, "root").select(F.col("node").alias("fp"), "lowest")
    owner = checkpointed(nodes.join(owner, "fp", "left").select("fp", "n", F.coalesce("lowest", "first").alias("component_id")))
    total = nodes.agg(F.sum("n")).first()[0] or 0  # one number
    return with_owner(marked, owner, "fp", total).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def text_key() -> Column:
    """What tells documents apart whatever their ids: (nameless, doc_id, hash of the text); null ids come last."""
    return F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.xxhash64(text_bytes()).alias("hash"))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the text key in the place of the id."""
    return docs.select(text_key().alias("doc_id"), "text")


def keep_first(docs: DataFrame, components: DataFrame) -> DataFrame:
    """Of each component (doc_id, component_id: text keys) the document whose key names it; of repeated rows with that key one stays."""
    found = checkpointed(components)
    first = found.select(F.col("component_id").alias("_key")).distinct()
    kept = docs.select(F.struct(*docs.columns).alias("row"), text_key().alias("key")).join(first, F.col("key").eqNullSafe(F.col("_key")), "left_semi")
    again = found.groupBy("doc_id").count().where("count > 1")
    repeats = first.join(again, F.col("_key").eqNullSafe(F.col("doc_id")), "left_semi").limit(1).count()
    return (kept.dropDuplicates(["key"]) if repeats else kept).select("row.*")


def keep_one(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """The documents without their near copies: of each component one row stays, that of the smallest (doc_id, hash of the text).

    Every component keeps one, whether its ids are null or those of other components; null ids come last.
    """
    return keep_first(docs, simhash_components(keyed(docs), words, radius))
