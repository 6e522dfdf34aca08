"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts counts the n-grams, n from 1 to `ngrams`, that occur in both, over the
geometric mean of what occurs in each. Texts are vectors of presence over DIMS hashed n-grams, so that the kernel is a
scaled product of vectors. A Nystrom map through a few landmark texts of each language gives features in which
one-versus-rest kernel ridge regressions are solved; scoring multiplies a batch's presence vectors with the landmarks
folded into one matrix.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import LOWER, bounded_batches, buffers, fold, least_hashed, sampled_documents, text_bytes

DIMS, NGRAMS, ROWS = 1 << 15, 4, 64


def presence(data: np.ndarray, off: np.ndarray, ngrams: int = NGRAMS, dims: int = DIMS) -> np.ndarray:
    """Which hashed byte n-grams occur in each row; A-Z lower-cased, other control and white space bytes as blanks."""
    n = len(off) - 1
    out = np.zeros(n * dims, bool)
    data = LOWER[data]
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
    h = np.zeros(len(data), np.uint32)
    shift = np.uint32(33 - dims.bit_length())
    for k in range(ngrams):
        size = len(data) - k
        if size <= 0:
            break
        h = h[:size] * np.uint32(0x01000193) + data[k:] + np.uint32(1)
        inside = row[:size] == row[k:]
        bucket = ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> shift
        out[(row[:size] * dims + bucket)[inside]] = True
    return out.reshape(n, dims)


def row_blocks(off: np.ndarray, rows: int = ROWS):
    for i in range(0, len(off) - 1, rows):
        part = off[i : i + rows + 1]
        yield i, part[0], part[-1], part - part[0]


def fit(docs: DataFrame, per_lang: int = 400, landmarks: int = 32, ridge: float = 1e-2, most_rows: int = 12_800, most_landmarks: int = 1024) -> dict | None:
    """Fit on at most `per_lang` documents of each language, `landmarks` of which are landmarks; None without any.

    Every language that occurs is learned. Where there are many, each gets an equal part of `most_rows` documents and `most_landmarks` landmarks,
    one at least, so what reaches the driver is bounded but for one row a language. Learned from are documents with a language and
    text whose crc32 fold of 5 is not 0; of rows that share an id the one whose (text hash, language) is least.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.where((fold(5) != 0) & (F.octet_length("text") > 0) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("mark"), F.col("lang").cast("string").alias("lang"))).alias("m"))
    picked = least_hashed(one.select("doc_id", "m.mark", "m.lang"), "lang", per_lang, most_rows)
    if not picked:
        return None
    landmarks = max(1, min(landmarks, most_landmarks // len({p[2] for p in picked})))

    def run(batches):
        for b in batches:
            data, off = buffers(b.column(2))
            packed = [p.tobytes() for _, x, y, o in row_blocks(off) for p in np.packbits(presence(data[x:y], o), axis=1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], ["doc_id", "lang", "bits"])

    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("lang", T.StringType()), T.StructField("bits", T.BinaryType())])
    found = sampled_documents(rows.select("doc_id", "text"), picked, "lang").select("doc_id", "lang", text_bytes().alias("text")).mapInArrow(run, kind).collect()
    found.sort(key=lambda r: (r.lang, r.doc_id))
    langs = sorted({r.lang for r in found})
    bits = np.frombuffer(b"".join(r.bits for r in found), np.uint8).reshape(len(found), -1)
    y = np.array([langs.index(r.lang) for r in found])
    chosen = np.concatenate([np.flatnonzero(y == c)[:landmarks] for c in range(len(langs))])
    unit = lambda p: (x := np.unpackbits(p, axis=1).astype(np.float32)) / np.sqrt(x.sum(axis=1, keepdims=True) + 1e-9)
    z = unit(bits[chosen])
    k = np.concatenate([unit(bits[i : i + 128]) @ z.T for i in range(0, len(bits), 128)]).astype(float)
    values, vectors = np.linalg.eigh(z.astype(float) @ z.T.astype(float))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))
    phi = np.concatenate([k @ root, np.ones((len(k), 1))], axis=1)
    target = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    weight = 1 / np.bincount(y)[y]
    weights = np.linalg.solve((phi * weight[:, None]).T @ phi + ridge * np.diag([1e-3] * (phi.shape[1] - 1) + [1e-9]), (phi * weight[:, None]).T @ target)
    return {"langs": langs, "matrix": (z.T @ (root @ weights[:-1])).astype(np.float32), "bias": weights[-1]}


def detect(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document.

    lang_pred is a learned language; `und` with score 0 if the text is null, has no letter or nothing could be learned.
    score is the softmax share of the winner among the regressions' outputs. held_out tells the fold that is not learned
    from. Texts are read whole; repeated rows stay; an empty table gives no rows. Only doc_id, text and lang are read.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, **options))

    def run(batches):
        m = model.value
        for b in batches:
            lang, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            if m is not None:
                data, off = buffers(b.column(2))
                for i, x, y, o in row_blocks(off):
                    p = presence(data[x:y], o).astype(np.float32)
                    out = 5 * ((p @ m["matrix"]) / np.sqrt(p.sum(axis=1, keepdims=True) + 1e-9) + m["bias"])
                    e = np.exp(out - out.max(axis=1, keepdims=True))
                    score[i : i + len(p)] = e.max(axis=1) / e.sum(axis=1)
                    lang[i : i + len(p)] = [m["langs"][c] for c in out.argmax(axis=1)]
                letters = b.column(3).to_numpy(zero_copy_only=False)
                score[~letters] = 0
                lang = [c if ok else "und" for c, ok in zip(lang, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", (fold(5) == 0).alias("held_out"), text_bytes().alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")).mapInArrow(run, kind)
