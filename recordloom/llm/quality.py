"""Document quality by a linear-chain conditional random field over lines.

Every line gets a label, good or bad. A line's potential is linear in its own features and those of the lines before and
after it; neighbouring labels have potentials of their own. The field is trained in numpy by gradient ascent on the
likelihood of sampled documents, whose lines take their document's label. Forward-backward gives every line's marginal
probability of being good; the mean of these, weighted by the lines' lengths, is calibrated to the document's score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import LOWER, SOLID, bounded_batches, buffers, fold, mix, picked_documents, platt, sampled_documents, sigmoid, text_bytes, word_hashes, word_spans

UPPER, SMALL, DIGIT, BLANK, PIPE, BANG, ODD, STOP, OTHER = range(9)


def _classes() -> np.ndarray:
    t = np.full(256, OTHER, np.int64)
    t[65:91], t[97:123], t[48:58], t[128:] = UPPER, SMALL, DIGIT, SMALL
    for chars, kind in ((b" \t\r\x0b\x0c", BLANK), (b"|", PIPE), (b"!", BANG), (b"#$%&*@^_~=+<>{}[]\\/", ODD), (b".,;:?", STOP)):
        t[list(chars)] = kind
    return t


CLASSES = _classes()
KINDS = 9
#: own features of a line; with those of both neighbours and a constant a line has three times as many and one.
OWN = KINDS + 8


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (own, before, after, constant), their lengths, and the first line of each row.

    Lines end at \\n; each row has one line at least.
    """
    n = len(off) - 1
    breaks = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate([off[:-1], breaks + 1]))
    begins = begins[begins < len(data)] if len(data) else begins[:0]
    # rows without bytes have one empty line; a row's last \n opens no line
    row = np.searchsorted(off, begins, "right") - 1
    empty = np.flatnonzero(np.diff(off) == 0)
    row_all = np.concatenate([row, empty])
    begin_all = np.concatenate([begins, off[empty]])
    order = np.lexsort((begin_all, row_all))
    row, begin = row_all[order], begin_all[order]
    close = np.where(np.append(row[1:] != row[:-1], True), off[row + 1], np.append(begin[1:], 0))
    lens = close - begin
    m = len(begin)
    full = np.flatnonzero(lens > 0)
    line = np.repeat(full, lens[full])
    counts = np.bincount(line * KINDS + CLASSES[data], minlength=m * KINDS).reshape(m, KINDS).astype(float)
    starts, ends, _ = word_spans(data, off, SOLID)
    of = np.searchsorted(begin[full], starts, "right") - 1
    of = full[of] if len(full) else of
    h = word_hashes(LOWER[data], starts, ends)
    words = np.bincount(of, minlength=m).astype(float)
    again = np.zeros(len(starts), bool)
    again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    repeats = np.bincount(of[again], minlength=m)
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h), out=total[1:])
        cut = np.searchsorted(of, np.arange(m + 1))
        text = mix(total[cut[1:]] - total[cut[:-1]] + words.astype(np.uint64))  # lines of the same words
    _, same, times = np.unique(mix(row.astype(np.uint64) + np.uint64(1)) ^ text, return_inverse=True, return_counts=True)
    like_last = np.zeros(m, bool)
    like_last[1:] = (text[1:] == text[:-1]) & (row[1:] == row[:-1]) & (words[1:] > 0)
    size = np.maximum(1, lens)[:, None]
    letters = np.maximum(1, counts[:, UPPER] + counts[:, SMALL])
    lines = np.bincount(row, minlength=n)[row]
    own = np.concatenate(
        [
            counts / size,
            np.stack(
                [
                    np.log1p(lens) / 5,
                    counts[:, UPPER] / letters,
                    repeats / np.maximum(1, words),
                    np.minimum(1, counts[:, PIPE] / np.maximum(1, words) * 2),
                    np.minimum(1, (counts[:, BANG] + counts[:, ODD]) / np.maximum(1, words) / 2),
                    like_last,
                    (times[same] - 1) / lines,
                    letters / np.maximum(1, words) / 10,
                ],
                axis=1,
            ),
        ],
        axis=1,
    )
    own = np.clip(own, 0, 3)
    back, ahead = np.zeros_like(own), np.zeros_like(own)
    inner = np.flatnonzero(row[1:] == row[:-1]) + 1
    back[inner], ahead[inner - 1] = own[inner - 1], own[inner]
    return np.concatenate([own, back, ahead, np.ones((m, 1))], axis=1), lens, np.searchsorted(row, np.arange(n + 1))


def marginals(unary: np.ndarray, pair: np.ndarray, first: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over all chains at once: P(good) of each line, weighted sum of pair marginals, log partition.

    unary: a line's potential of good against bad; pair[i, j]: of label i before label j. Chains are taken by falling length, so
    that step t works on those that have a line t.
    """
    lens = np.diff(first)
    order = np.argsort(-lens, kind="stable")
    start, lens = first[:-1][order], lens[order]
    longest = int(lens[0]) if len(lens) else 0
    active = np.searchsorted(-lens, -np.arange(longest), "left")  # chains longer than t
    u = np.stack([np.zeros(len(unary)), unary], axis=1)
    u -= u.max(axis=1, keepdims=True, initial=-np.inf)
    e, k = np.exp(u), np.exp(pair - pair.max())
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.ones(len(unary))
    now = np.zeros((len(start), 2))
    for t in range(longest):
        at = start[: active[t]] + t
        now = e[at] * (now[: active[t]] @ k if t else 1)
        scale[at] = now.sum(axis=1)
        now = now / scale[at][:, None]
        alpha[at] = now
    for t in range(longest - 2, -1, -1):
        at = start[: active[t + 1]] + t
        beta[at] = ((e[at + 1] * beta[at + 1]) @ k.T) / scale[at + 1][:, None]
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    inner = np.ones(len(unary), bool)
    inner[first[:-1]] = False
    nxt = np.flatnonzero(inner)
    joint = alpha[nxt - 1][:, :, None] * k[None] * (e[nxt] * beta[nxt] / scale[nxt][:, None])[:, None, :]
    pairs = (joint / joint.sum(axis=(1, 2), keepdims=True) * (1 if weight is None else weight[nxt][:, None, None])).sum(axis=0) if len(nxt) else np.zeros((2, 2))
    log_z = np.log(scale).sum() + (np.maximum(unary, 0)).sum() + pair.max() * len(nxt)
    return p[:, 1], pairs, float(log_z)


def document_scores(model: dict, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals of each row."""
    x, lens, first = line_features(data, off)
    p, _, _ = marginals(x @ model["weights"], model["pair"], first)
    w = np.maximum(1, lens)
    return np.add.reduceat(p * w, first[:-1]) / np.add.reduceat(w, first[:-1]) if len(first) > 1 else np.zeros(0)


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and pair potentials by Adam on the mean log-likelihood of the chains; classes weigh alike, and so do documents."""
    lens = np.diff(first)
    label = np.repeat(y, lens)
    w, pair = np.zeros(x.shape[1]), np.zeros((2, 2))
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    per_line = np.repeat(share / np.maximum(1, lens), lens)
    inner = np.ones(len(x), bool)
    inner[first[:-1]] = False
    same = [float(per_line[inner & (label == c)].sum()) for c in (0, 1)]
    moment = [np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)]
    for t in range(1, steps + 1):
        p, pairs, _ = marginals(x @ w, pair, first, per_line)
        g_w = x.T @ (per_line * (label - p)) - decay * w
        g_pair = np.diag(same) - pairs
        g = np.concatenate([g_w, (g_pair - decay * pair).ravel()])
        moment[0] = 0.9 * moment[0] + 0.1 * g
        moment[1] = 0.999 * moment[1] + 0.001 * g * g
        step = rate * (moment[0] / (1 - 0.9**t)) / (np.sqrt(moment[1] / (1 - 0.999**t)) + 1e-9)
        w, pair = w + step[:-4], pair + step[-4:].reshape(2, 2)
    return w, pair


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, longest: int = 16_000) -> dict | None:
    """Fit on at most `per_class` documents of each class, picked among those of at most `longest` bytes, or as `picked_documents` has it; None if a class has none.

    Learned from are labelled documents whose crc32 fold of 5 is not 0; a fifth of the sample is kept for calibration.
    """
    known = labels.select("doc_id", F.col("quality").cast("long").alias("quality")).where(fold(5) != 0)
    picked = picked_documents(docs.select("doc_id", "text"), known, "quality", longest, per_class)
    rows = sampled_documents(docs.select("doc_id", "text"), picked, "quality").select("doc_id", "quality", text_bytes().alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    y = np.array([r.quality > 0 for r in rows], float)
    if not len(rows) or y.min() == y.max():
        return None
    aside = np.arange(len(rows)) % 5 == 0
    if y[~aside].min() == y[~aside].max():
        aside[:] = False

    def joined(which):
        texts = [bytes(rows[i].text) for i in np.flatnonzero(which)]
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    x, _, first = line_features(*joined(~aside))
    weights, pair = train(x, first, y[~aside])
    model = {"weights": weights, "pair": pair}
    held = aside if aside.any() else ~aside
    raw = document_scores(model, *joined(held))
    model["slope"], model["shift"] = platt(raw, y[held])
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; score: probability that the quality is good.

    predicted is 1 from `threshold` on; held_out tells the fold that is not learned from. Null and empty texts have one
    empty line, and a score as any other; without a learned class all scores are 0.5. Texts are read whole; repeated rows stay; an
    empty table gives no rows. Only doc_id, text and labels' doc_id and quality are read.
    """
    scored = score_column(docs.select("doc_id", "text", (fold(5) == 0).alias("held_out")), docs, labels, **options)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def score_column(rows: DataFrame, docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """`rows` with the column `score`, by a field fitted on `docs` and `labels`; every row is scored where it stands."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(fit(docs, labels, **options))
    names = [*rows.columns, "score"]
    at = rows.columns.index("text")

    def run(batches):
        for b in batches:
            m = shared.value
            if m is None:
                score = np.full(b.num_rows, 0.5)
            else:
                column = b.column(at)
                column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
                data, off = buffers(column.fill_null(b"") if column.null_count else column)
                score = sigmoid(m["slope"] * document_scores(m, data, off) + m["shift"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The documents whose score reaches the threshold, in all their columns, whatever these are called.

    Null and empty texts are scored as `classify` scores them; repeated rows have one score and stay or go together; without a
    learned class all stay; an empty table stays empty.
    """
    scored = score_column(docs.select(F.struct(*docs.columns).alias("row"), "text"), docs, labels, **options)
    return scored.where(F.col("score") >= threshold).select("row.*")
