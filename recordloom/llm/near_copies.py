"""Near copies by shingles of words: SimHash balls (op 10) propose pairs first, MinHash bands and prefixes of rare shingles what lies beyond them, sets decide.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more. Texts of one set are
one node. Each has a SimHash fingerprint of its shingles; fingerprints at most two bits apart meet in balls of half that radius, as in op 10, and an exact comparison
follows. A ball's links are true but not all: pairs of that similarity may differ in 10 bits. So nodes that agree in all rows of a band with another one are looked at further; at a similarity of exactly 0.8 a pair agrees in none of the
bands with a probability of (1 - 0.8^ROWS)^BANDS = 6e-7, at higher ones with less. Of these nodes the shingles are ordered by how few
nodes have them. A pair of that similarity has its first common shingle so early in both orders that what follows suffices for the
overlap: such shingles are a node's keys, and nodes of one key are candidates. A node with many shingles of its own, as texts
that were edited heavily have, keeps no key. Only the order differs with a key's number of nodes: each node first meets one node of
its keys, the best connected one, so that a large group of near copies is linked without its square; what is left outside a large
component then meets all of its members, block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import SOLID, bounded_batches, buffers, checkpointed, mix, release, word_hashes, word_spans
from recordloom.llm.graph import compact, components
from recordloom.llm.simhash import keep_first, keyed, majority, with_owner
from recordloom.llm.simhash import links as ball_pairs

WORDS, PERCENT = 5, 80
BANDS, ROWS = 36, 5
#: Comparisons for each row of a bucket up to which all are made at once.
EACH = 16
#: Nodes of a large component, and nodes outside it, that are compared in one call.
BLOCK, CHUNK = 256, 512

_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; a row of fewer words is one shingle, one without words has none."""
    starts, ends, row = word_spans(data, off, SOLID)
    h = word_hashes(data, starts, ends)
    cuts, out = np.searchsorted(row, np.arange(len(off))), []
    with np.errstate(over="ignore"):
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            k = min(words, b - a)
            s = np.zeros(b - a - k + 1 if k else 0, np.uint64)
            for j in range(k):
                s = s * _BASE + h[a + j : a + j + len(s)]
            out.append(np.unique(mix(s)))
    return out


def node_of(shingles: np.ndarray) -> int:
    """One signed 64-bit number for a set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))


def bands(shingles: np.ndarray) -> np.ndarray:
    """A key for each band: the least products of the set by ROWS factors. A set without shingles has no bands."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 512):
            low = np.minimum(low, (shingles[None, i : i + 512] * _FACTORS[:, None]).min(axis=1))
        key = np.arange(BANDS, dtype=np.uint64)
        for column in mix(low).reshape(BANDS, ROWS).T:
            key = key * _BASE + column
        return mix(key).view(np.int64)


def lists(parts: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.lower("text").cast("binary"), F.lit(b"")).alias("text"))


def marks(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n, bands, fp): the set of each document, its size, its bands and its fingerprint."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            sets = shingle_sets(*buffers(b.column(1)))
            cols = [b.column(0), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), lists([bands(s) for s in sets]), pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "node", "n", "bands", "fp"])

    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())])
    return _texts(docs).mapInArrow(run, kind)


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, shingles) of the documents whose id is in `ids` (_id)."""

    def run(batches):
        for b in batches:
            sets = shingle_sets(*buffers(b.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), lists([s.view(np.int64) for s in sets])], ["node", "shingles"])

    asked = _texts(docs).join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return asked.select("text").mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def alike(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least `percent` hundredths."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("c"), (F.size("x") + F.size("y")).alias("n"))
    return common.where(100 * F.col("c") >= percent * (F.col("n") - F.col("c"))).select("a", "b")


def block_links(outside: DataFrame, inside: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): of `outside` (node, root) and `inside` (node, root), all pairs of one root with a similarity of at least `percent` hundredths."""

    def run(left, right):
        a, b = left.column("node").to_pylist(), right.column("node_in").to_pylist()
        x, y = ([v.values.to_numpy() for v in c] for c in (left.column("shingles"), right.column("shingles_in")))
        flat, owner = np.concatenate([*y, np.zeros(0, np.int64)]), np.repeat(np.arange(len(y)), [len(v) for v in y])
        order = np.argsort(flat, kind="stable")
        flat, owner, size, pairs = flat[order], owner[order], np.array([len(v) for v in y]), []
        for node, v in zip(a, x, strict=True):
            lo, hi = np.searchsorted(flat, v, "left"), np.searchsorted(flat, v, "right")
            n = hi - lo
            common = np.bincount(owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], minlength=len(y))
            pairs += [(node, b[k]) for k in np.flatnonzero(100 * common >= percent * (size + len(v) - common)).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    blocks = inside.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    chunks = outside.groupBy("root").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    parts = checkpointed(blocks.join(chunks, "root"))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = outside.join(parts, "root").join(sets, "node").select("root", each("blocks").alias("block"), place("chunks").alias("chunk"), "node", "shingles")
    right = inside.join(parts, "root").join(sets, "node").select("root", place("blocks").alias("block"), each("chunks").alias("chunk"), "node", "shingles")
    right = right.select(*[F.col(c).alias(f"{c}_in") for c in right.columns])  # both sides stem from one table
    by = ["root", "block", "chunk"]
    return left.groupBy(*by).cogroup(right.groupBy(*[f"{c}_in" for c in by])).applyInArrow(lambda x, y: pa.Table.from_batches(list(run(x, y))), "a long, b long")


def prefix_keys(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, node, n, left) of nodes' rare shingles: `left` shingles of the node's n follow in its order, the key itself included.

    Kept are keys that several nodes have and that are early enough for a partner as small as the smallest node of the key.
    """
    rows = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    seen = checkpointed(rows.groupBy("key").agg(F.count("*").alias("n")).withColumn("nodes", F.col("n")))
    total = seen.agg(F.sum("n")).first()[0] or 0  # one number
    order = F.array_sort(F.collect_list(F.struct("nodes", "key")))
    ranked = with_owner(rows.withColumnRenamed("n", "size"), seen, "key", total).groupBy("node", F.col("size").alias("n")).agg(order.alias("order"))
    early = F.filter(F.transform("order", lambda x, i: F.struct(x["key"].alias("key"), x["nodes"].alias("nodes"), (F.col("n") - i).alias("left"))), lambda x: (x["nodes"] > 1) & (100 * x["left"] >= percent * F.col("n")))
    keys = checkpointed(ranked.select("node", "n", F.explode(early).alias("k")).select("k.key", "node", "n", "k.left"))
    least = keys.groupBy("key").agg(F.min("n").alias("least"), F.count("*").alias("times")).where("times > 1")
    return keys.join(least, "key").where((100 + percent) * F.col("left") >= percent * (F.col("n") + F.col("least"))).select("key", "node", "n", "left")


def near_fingerprints(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of nodes (node, fp) whose fingerprints are at most two bits apart, enough to connect all such nodes.

    One node stands for a fingerprint: the others of it are paired with that one, and those of a ball with each other along it.
    """
    stands = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("component_id"), F.count("*").alias("n")))
    total = stands.agg(F.sum("n")).first()[0] or 0  # one number
    same = with_owner(nodes.select("node", "fp"), stands, "fp", total).select(F.col("component_id").alias("a"), F.col("node").alias("b"))
    of = lambda k: stands.select(F.col("fp").alias(k), F.col("component_id").alias(f"{k}_node"))
    near = ball_pairs(stands.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    pairs = checkpointed(same.unionByName(near).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    release(nodes.sparkSession)
    return pairs


def _sets_of_nodes(asked: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """`sets_of` the nodes asked for (node), written; what their texts were moved by is let go."""
    sets = checkpointed(sets_of(docs, nodes.join(asked, "node", "left_semi").select(F.col("first").alias("_id"))))
    release(docs.sparkSession)
    return sets


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def ball_links(nodes: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """(a, b): of nodes (node, fp, first) whose fingerprints are at most two bits apart the links that sets confirm; None without such nodes."""
    pairs = near_fingerprints(nodes)
    return checkpointed(alike(pairs, _sets_of_nodes(_ends(pairs), nodes, docs), percent)) if pairs.limit(1).count() else None


def set_links(nodes: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """(a, b): links between nodes (node, n, bands, fp, first), enough to connect all that balls and keys link; None without candidates.

    Texts move once: the sets of all nodes that balls or bands propose are made together.
    """
    balls = near_fingerprints(nodes)
    rows = nodes.select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").count().where("count > 1").select("key")
    mates = checkpointed(rows.join(shared, "key", "left_semi").select("node").distinct())
    close, near = bool(balls.limit(1).count()), bool(mates.limit(1).count())
    if not close and not near:
        return None
    sets = _sets_of_nodes(mates.union(_ends(balls)).distinct(), nodes, docs)
    found = checkpointed(alike(balls, sets, percent)) if close else None
    release(docs.sparkSession)
    if not near:
        return found
    members = checkpointed(prefix_keys(sets.join(mates, "node", "left_semi"), percent))
    release(docs.sparkSession)
    total = members.count()
    if not total:
        return found
    members = compact(members, total)
    bound = lambda n, left, m: (100 + percent) * F.col(left) >= percent * (F.col(n) + F.col(m))
    fits = (100 * F.least("n", "m") >= percent * F.greatest("n", "m")) & bound("n", "left", "m") & bound("n", "other_left", "m")
    before, nth = None, 0
    while True:
        roots = members.withColumn("root", F.col("node")) if found is None else members.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
        roots = compact(roots.select("key", "node", "n", "left", "root"), total)
        sizes = roots.groupBy("key", "root").agg(F.count("*").alias("size"), F.min("n").alias("least"))
        largest = sizes.groupBy("key").agg(F.max_by("root", F.struct("size", F.xxhash64("root", "key"))).alias("big"), F.max("size").alias("most"), F.sum("size").alias("all"), F.count("*").alias("parts"))
        largest = compact(largest.where("parts > 1"), total)
        cost = largest.agg(F.sum((F.col("all") - F.col("most")) * F.col("all"))).first()[0] or 0
        last = cost <= EACH * total or (before is not None and cost > before / 4)
        if last:  # every node outside the largest component against all that it is not linked to
            whole = compact(roots.select("node", "root").distinct(), total)
            large = compact(whole.groupBy("root").count().where(F.col("count") > BLOCK).select("root"), total // BLOCK)
            outside = roots.join(largest.select("key", "big"), "key").where("root <> big")
            meets = roots.join(large, "root", "left_anti").select("key", F.col("node").alias("other_node"), F.col("n").alias("m"), F.col("left").alias("other_left"), F.col("root").alias("other"))
            pairs = outside.join(meets, "key").where(fits & (F.col("root") != F.col("other")) & ((F.col("other") == F.col("big")) | (F.col("node") < F.col("other_node"))))
            into = sizes.join(large, "root", "left_semi").select("key", F.col("root").alias("other"), F.col("least").alias("m"))
            far = outside.join(into, "key").where((F.col("root") != F.col("other")) & bound("n", "left", "m")).select("node", F.col("other").alias("root")).distinct()
        else:  # of the largest component of each key one node, and of these each node takes the best connected one (later another one)
            ties = members.groupBy("node").count().withColumnRenamed("count", "ties")
            weight = F.struct("ties", F.xxhash64("node")) if nth == 0 else F.xxhash64("node", "key", F.lit(nth))
            middle = roots.join(ties, "node").join(largest.select("key", "big"), "key").where("root = big")
            middle = middle.groupBy("key").agg(F.max_by(F.struct("node", "n", "left", "root", "ties"), weight).alias("c"))
            middle = middle.select("key", F.col("c.node").alias("other_node"), F.col("c.n").alias("m"), F.col("c.left").alias("other_left"), F.col("c.root").alias("other"), F.col("c.ties").alias("ties"))
            one = F.max_by(F.struct("other_node", "m"), F.struct("ties", F.xxhash64("other_node")))
            pairs = roots.join(middle, "key").where(fits & (F.col("root") != F.col("other"))).groupBy("node").agg(one.alias("o")).select("node", "o.other_node")
        pairs = pairs.select(F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")).distinct()
        links = alike(pairs, sets, percent)
        if last and large.limit(1).count():
            links = links.union(block_links(checkpointed(far), whole.join(large, "root", "left_semi"), sets, percent))
        links = checkpointed(links)
        found = links if found is None else found.union(links)
        if last:
            return found
        before, nth = cost, nth + 1
        release(docs.sparkSession)


def similar_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, component_id) of every document: the smallest doc_id that links of similarity reach, itself included.

    Texts are lower-cased; words are runs of anything but ASCII white space. Texts without words are copies of each other. Repeated rows stay; an
    empty table gives no rows.
    """
    marked = checkpointed(marks(docs))
    nodes = checkpointed(marked.groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp")))
    found = set_links(nodes, docs, percent)
    if found is None:
        owner = nodes.select("node", F.col("copies").alias("n"), F.col("first").alias("component_id"))
    else:
        roots = nodes.select("node", "first", "copies").join(components(found), "node", "left").select("node", "first", "copies", F.coalesce("root", "node").alias("root"))
        owner = checkpointed(roots.join(roots.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", F.col("copies").alias("n"), "component_id"))
    total = nodes.agg(F.sum("copies")).first()[0] or 0  # one number
    release(docs.sparkSession)
    return with_owner(marked.select("doc_id", "node"), owner, "node", total).select("doc_id", "component_id")


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without their near copies: of each component one row stays, that of the smallest (doc_id, hash of the text), null ids last."""
    return keep_first(docs, similar_components(keyed(docs), percent))
