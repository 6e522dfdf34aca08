"""Shared plumbing of the training-data operators: Arrow batches, folds, checkpoints, word scans."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch sent to a Python worker; texts differ by five orders of magnitude in length.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch can hold, whatever the lengths of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="recordloom-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared checkpoint folder, for a table that several steps append to."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4()}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate tables, on whatever file system it lies."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffles of steps that are done: it does so when the driver's JVM finds them unused."""
    gc.collect()
    spark._jvm.System.gc()


def text_bytes(name: str = "text") -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def with_text(rows: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of `docs` from the packed column `row`, with another text and, if there is one, n_chars counted anew."""
    new = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def fold(modulus: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo; a null id falls in fold 0."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")) % modulus, F.lit(0)).cast("int")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary Arrow column and the n + 1 offsets of its rows, without a copy."""
    wide = pa.types.is_large_binary(column.type)
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), off
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = _lower_table()
#: Bytes of words that are runs of digits, letters and everything beyond ASCII (after A-Z is lower-cased).
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Bytes of words that are runs of anything but ASCII white space.
SOLID = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


def word_spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word in the concatenated rows; a word never crosses rows."""
    mask = np.zeros(len(data) + 2, np.int8)
    mask[1:-1] = inside[data]
    step = np.diff(mask)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = off[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[(mask[cuts] == 1) & (mask[cuts + 1] == 1)]  # a word on both sides of a row's border
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, scrambled with its length. Each even seed has a base of its own."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(starts), np.uint64)
        live, k = np.arange(len(starts)), 0
        base = np.uint64(0x9E3779B97F4A7C15 + seed)
        while len(live):
            h[live] = h[live] * base + data[starts[live] + k].astype(np.uint64) + np.uint64(1)
            k += 1
            live = live[ends[live] - starts[live] > k] if k < 64 else live[:0]
        for i in np.flatnonzero(ends - starts > 64):  # rare: long runs, by their powers at once
            tail = data[starts[i] + 64 : ends[i]].astype(np.uint64) + np.uint64(1)
            h[i] = h[i] * base + (tail * powers(0xD6E8FEB86659FD93 + seed, len(tail))).sum(dtype=np.uint64)
        return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def labelled_documents(docs: DataFrame, labels: DataFrame, label: str, longest: int) -> DataFrame:
    """(doc_id, mark, label) of the ids that have a label and a document of at most `longest` bytes.

    mark is the least hash among such a document's texts, so that an id shared by several texts always means the same one; of
    several labels of one id the largest counts. Null ids, labels and texts take no part.
    """
    short = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") <= longest)).groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("mark"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    return known.join(short, "doc_id").select("doc_id", "mark", label)


def least_hashed(rows: DataFrame, label: str, cap: int, total: int | None = None) -> list:
    """At most `cap` rows (doc_id, mark, label) of each class, those whose id hashes least; ids are distinct.

    With `total` the cap falls to total / classes where there are many classes, to one at least. No class is gathered or sorted
    anywhere: classes are counted, and as hashes are spread evenly, a bound on the hash leaves little more than the cap of each, which
    the driver sorts. A class of which the bound left too few is asked again with a wider one.
    """
    rows = checkpointed(rows.withColumn("_hash", F.xxhash64("doc_id")))
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if total is not None:
        cap = max(1, min(cap, total // max(1, len(sizes))))
    kind, picked, wide = rows.schema[label].dataType.simpleString(), [], 1.5
    while sizes:
        bounds = [(c, min(2**63 - 1, int((wide * cap + 64) / n * 2**64) - 2**63)) for c, n in sizes.items()]
        near = rows.join(F.broadcast(rows.sparkSession.createDataFrame(bounds, f"_class {kind}, _bound long")), (F.col(label) == F.col("_class")) & (F.col("_hash") <= F.col("_bound")))
        found: dict = {}
        for r in near.select("doc_id", "mark", label, "_hash").collect():
            found.setdefault(r[2], []).append(r)
        done = [c for c, n in sizes.items() if len(found.get(c, ())) >= min(cap, n)]
        for c in done:
            picked += [(r[0], r[1], r[2]) for r in sorted(found[c], key=lambda r: (r[3], r[0]))[:cap]]
            del sizes[c]
        wide *= 4
    return picked


def picked_documents(docs: DataFrame, labels: DataFrame, label: str, longest: int, cap: int) -> list:
    """`least_hashed` of the labelled documents of at most `longest` bytes.

    If a class that is labelled has none as short, texts four times as long are taken, or four times that, and as many times fewer of a class, one at least: as short
    as lets every class be learned, and no more text in all.
    """
    picked = least_hashed(labelled_documents(docs, labels, label, longest), label, cap)
    found = {r[2] for r in picked}
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    if len(found) > 1 or {r[0] for r in known.select(label).distinct().collect()} <= found:
        return picked
    sized = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).groupBy("doc_id").agg(F.min(F.octet_length("text")).alias("_bytes"))
    need = known.join(sized, "doc_id").groupBy(label).agg(F.min("_bytes").alias("least")).agg(F.max("least")).first()[0] or 0
    times = 1
    while longest * times < need:
        times *= 4
    return picked if times == 1 else least_hashed(labelled_documents(docs, labels, label, longest * times), label, max(1, cap // times))


def sampled_documents(docs: DataFrame, picked: list, label: str) -> DataFrame:
    """(doc_id, label, text, lang if there is one) of a bounded list of (doc_id, mark, label), which is broadcast; one row for each id."""
    spark = docs.sparkSession
    kind = f"_id {docs.schema['doc_id'].dataType.simpleString()}, _mark long, {label} {'string' if not picked or isinstance(picked[0][2], str) else 'long'}"
    ids = spark.createDataFrame(picked, kind)
    columns = [c for c in docs.columns if c not in (label, "doc_id")]
    found = docs.select("doc_id", *columns).join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).where(F.xxhash64("text") == F.col("_mark"))
    return found.groupBy("doc_id", label).agg(*[F.min(c).alias(c) for c in columns])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(x: np.ndarray, y: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of the logistic curve that turns scores x into probabilities of y, by damped Newton steps."""
    if not len(x) or y.min() == y.max():
        return 1.0, 0.0
    x = np.asarray(x, float)
    mean, scale = x.mean(), x.std() + 1e-9
    z = np.stack([(x - mean) / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(steps):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(2) * 1e-2, z.T @ (y - p) - 1e-2 * w)
        w += step * min(1, 2 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)
