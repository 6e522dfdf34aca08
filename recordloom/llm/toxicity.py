"""Toxicity by a convolutional text classifier trained in numpy.

A word's vector is the sum of the hashed embeddings of its pieces: the word and its first 3 to 7 bytes, so that inflected
forms share their stem. Filters of widths 1, 2 and 3 slide over the words and each keeps its maximum; a logistic layer
reads the maxima. Embeddings start from the pieces' log-odds in the sample and are trained with the rest by stochastic
gradients, which reach only the words that won a maximum. Probabilities are calibrated on sample rows that were not trained on,
and thresholds for each language on the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import ALNUM, LOWER, bounded_batches, buffers, fold, picked_documents, platt, sampled_documents, sigmoid, text_bytes, word_hashes, word_spans

BUCKETS, DIM, FILTERS, WIDTHS, PREFIXES = 1 << 16, 8, 8, (1, 2, 3), (3, 4, 5, 6, 7)
SLOTS = sum(WIDTHS) * FILTERS
CHUNK = 1 << 15


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Buckets of each word's pieces, the word itself first; a word without a longer prefix repeats itself."""
    columns = []
    for k in (None, *PREFIXES):
        cut = ends if k is None else np.minimum(starts + k, ends)
        h = word_hashes(data, starts, cut) + np.uint64(0 if k is None else k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        columns.append(np.where(cut == ends, np.uint64(0), h) if k else h)
    whole = columns[0]
    mixed = [whole, *(np.where(c == 0, whole, c) for c in columns[1:])]
    return np.stack([(c * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKETS.bit_length() + 1) for c in mixed], axis=1).astype(np.uint16)


def scan(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the distinct words of a batch, each word's place among them, and each word's row."""
    data, off = buffers(column)
    data = LOWER[data]
    starts, ends, row = word_spans(data, off, ALNUM)
    _, first, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    return pieces(data, starts[first], ends[first]), back, row


def _sample(docs: DataFrame, labels: DataFrame, per_class: int, longest: int) -> list:
    learn = labels.select("doc_id", F.col("toxic").cast("long").alias("toxic")).where(fold(3) != 1)
    columns = docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    picked = picked_documents(columns, learn, "toxic", longest, per_class)

    def run(batches):
        for b in batches:
            out = [zstandard.compress(x) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], ["doc_id", "toxic", "lang", "packed"])

    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("toxic", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("packed", T.BinaryType())])
    rows = sampled_documents(columns, picked, "toxic").select("doc_id", "toxic", "lang", text_bytes().alias("text")).mapInArrow(run, kind).collect()
    return sorted(rows, key=lambda r: r.doc_id)


def unpacked(packed: bytes) -> np.ndarray:
    """The pieces of a compressed text's words."""
    table, back, _ = scan(pa.array([zstandard.decompress(packed)], pa.binary()))
    return table[back]


def forward(vectors: np.ndarray, filters: list[np.ndarray], begin: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima of all filters in each document and the words that won; documents are followed by two zero words."""
    best, who = [], []
    pad = np.ones(len(vectors), bool)
    pad[np.repeat(begin - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(int(lens.sum()))] = False
    for width, f in zip(WIDTHS, filters, strict=True):
        z = vectors @ f[0]
        for j in range(1, width):
            z[:-j] += vectors[j:] @ f[j]
        z[pad] = -1e9
        top = np.maximum.reduceat(z, begin, axis=0)
        owner = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(z))))
        at = np.full(top.shape, len(z), np.int64)
        r, c = np.nonzero(z == top[owner])
        np.minimum.at(at, (owner[r], c), r)
        best.append(top)
        who.append(at)
    return np.concatenate(best, axis=1), np.concatenate(who, axis=1)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, longest: int = 16_000, epochs: int = 4, seed: int = 7) -> dict | None:
    """Fit on at most `per_class` documents of each class, picked among those of at most `longest` bytes, or as `picked_documents` has it; None if a class has none.

    Learned from are labelled documents whose crc32 fold of 3 is not 1. Their texts reach the driver compressed, which are smaller than their pieces.
    """
    rows = _sample(docs, labels, per_class, longest)
    y_all = np.array([r.toxic > 0 for r in rows], float)
    if not len(rows) or y_all.min() == y_all.max():
        return None
    texts = [unpacked(r.packed) for r in rows]
    rng = np.random.default_rng(seed)
    part = rng.permutation(len(rows))
    aside, train = part[: len(part) // 5], part[len(part) // 5 :]
    counts = np.full((2, BUCKETS), 0.5)
    for i in train:
        counts[int(y_all[i]), np.unique(texts[i])] += 1
    total = np.maximum(1, [(y_all[train] == c).sum() for c in (0, 1)])
    odds = np.clip(np.log(counts[1] / (total[1] + 1)) - np.log(counts[0] / (total[0] + 1)), -3, 6)
    odds[counts.sum(axis=0) < 3] = 0
    emb = rng.normal(0, 0.05, (BUCKETS, DIM))
    emb[:, 0] = odds / 4
    filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[0, 0, : FILTERS // 2] = np.abs(f[0, 0, : FILTERS // 2]) + 0.5
    out = np.concatenate([np.where(np.arange(FILTERS) < FILTERS // 2, 0.3, 0.0) for _ in WIDTHS])
    bias, rate, second = -1.0, 0.05, {}

    def pooled(idx):
        lens = np.array([len(texts[i]) for i in idx])
        begin = np.cumsum(lens + 2) - lens - 2
        ids = np.zeros((int((lens + 2).sum()), 1 + len(PREFIXES)), np.int64)
        live = np.zeros(len(ids), bool)
        for b, n, i in zip(begin, lens, idx, strict=True):
            ids[b : b + n] = texts[i]
            live[b : b + n] = True
        vectors = emb[ids].sum(axis=1) * live[:, None]
        top, who = forward(vectors, filters, begin, lens)
        some = lens > 0
        return np.where(some[:, None], top, 0), who, vectors, ids, live, some

    def adagrad(name, param, grad, at=None):
        s = second.setdefault(name, np.full(param.shape, 1e-3))
        if at is None:
            s += grad * grad
            param -= rate * grad / np.sqrt(s)
        else:
            s[at] += grad[at] ** 2
            param[at] -= rate * grad[at] / np.sqrt(s[at])

    box = np.array([bias])
    for _ in range(epochs):
        order = rng.permutation(train)
        for k in range(0, len(order), 64):
            idx = order[k : k + 64]
            top, who, vectors, ids, live, some = pooled(idx)
            act = np.maximum(top, 0)
            err = (sigmoid(act @ out + box[0]) - y_all[idx]) / len(idx)
            g_out = act.T @ err
            g_top = err[:, None] * out * (top > 0) * some[:, None]
            g_vec = np.zeros_like(vectors)
            for n, (w, f) in enumerate(zip(WIDTHS, filters, strict=True)):
                g, at = g_top[:, n * FILTERS : (n + 1) * FILTERS], np.minimum(who[:, n * FILTERS : (n + 1) * FILTERS], len(vectors) - 3)
                g_f = np.zeros_like(f)
                for j in range(w):
                    v = vectors[at + j]  # documents, filters, dims
                    g_f[j] = np.einsum("df,dfe->ef", g, v)
                    np.add.at(g_vec, at + j, g[:, :, None] * f[j].T[None])
                adagrad(n, f, g_f)
            g_vec *= live[:, None]
            hit = np.flatnonzero(np.abs(g_vec).sum(axis=1))
            g_emb = np.zeros_like(emb) if k == 0 else g_emb
            np.add.at(g_emb, ids[hit].ravel(), np.repeat(g_vec[hit], ids.shape[1], axis=0))
            touched = np.unique(ids[hit])
            adagrad("emb", emb, g_emb, touched)
            g_emb[touched] = 0
            adagrad("out", out, g_out)
            adagrad("bias", box, np.array([err.sum()]))
    raw = np.concatenate([np.maximum(pooled(aside[k : k + 64])[0], 0) @ out + box[0] for k in range(0, len(aside), 64)]) if len(aside) else np.zeros(0)
    slope, shift = platt(raw, y_all[aside]) if len(aside) else (1.0, 0.0)
    prob = sigmoid(raw * slope + shift)
    thresholds = {}
    for lang in sorted({rows[i].lang for i in aside}):
        own = np.array([rows[i].lang == lang for i in aside])
        p, y = prob[own], y_all[aside][own]
        grid = np.linspace(0.05, 0.95, 19)
        hits = [(2 * ((p >= t) & (y > 0)).sum() / max(1, (p >= t).sum() + y.sum()), -abs(t - 0.5), t) for t in grid]
        thresholds[lang] = float(max(hits)[2])
    projected = np.concatenate([emb @ f[j] for f in filters for j in range(len(f))], axis=1).astype(np.float32)
    return {"table": projected, "out": out * slope, "bias": float(box[0] * slope + shift), "thresholds": thresholds}


def scores(model: dict, column: pa.Array) -> np.ndarray:
    """Probabilities of a batch's texts, the words in chunks, so that memory follows neither texts nor their number."""
    table, back, row = scan(column)
    n = len(column)
    words = np.zeros((len(table) + 1, SLOTS), np.float32)
    for k in range(0, len(table), CHUNK):
        words[k : min(k + CHUNK, len(table))] = model["table"][table[k : k + CHUNK]].sum(axis=1)
    top = np.full((n, len(WIDTHS) * FILTERS), -np.inf, np.float32)
    after = np.concatenate([back, [len(table)] * 2])
    owner = np.concatenate([row, [-1, -1]])
    for c in range(0, len(back), CHUNK):
        m = min(CHUNK, len(back) - c)
        ids, own, slot = after[c : c + m + 2], owner[c : c + m + 2], 0
        for k, width in enumerate(WIDTHS):
            z = words[ids[:m], slot : slot + FILTERS].copy()
            for j in range(1, width):
                same = own[j : j + m] == own[:m]
                z[same] += words[ids[j : j + m][same], slot + j * FILTERS : slot + (j + 1) * FILTERS]
            slot += width * FILTERS
            heads = np.flatnonzero(np.concatenate([[True], own[1:m] != own[: m - 1]]))
            part, at = np.maximum.reduceat(z, heads, axis=0), own[heads]
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            top[at, cols] = np.maximum(top[at, cols], part)
    return sigmoid(np.maximum(top, 0).astype(float) @ model["out"] + model["bias"])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted, lang_threshold, flagged) of every document.

    score: probability of toxicity; predicted: 1 from `threshold` on; flagged: score reaches the threshold calibrated for the
    document's language (`threshold` for one that the sample lacks). held_out tells the fold that is not learned from. Null and
    empty texts have the score of a text without words; without a learned class all scores are 0.5. Texts are read whole;
    repeated rows stay; an empty table gives no rows. Only doc_id, text, lang and labels' doc_id and toxic are read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = fit(docs, labels, **options)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = scores(shared.value, b.column(2)) if shared.value is not None else np.full(b.num_rows, 0.5)
            limits = (shared.value or {}).get("thresholds", {})
            limit = np.array([limits.get(x or "", threshold) for x in b.column(3).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array(limit)], ["doc_id", "held_out", "score", "lang_threshold"])

    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("lang_threshold", T.DoubleType())])
    found = docs.select("doc_id", (fold(3) == 1).alias("held_out"), text_bytes().alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(run, kind)
    return found.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "lang_threshold", (F.col("score") >= F.col("lang_threshold")).alias("flagged"))
