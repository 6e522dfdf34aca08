"""Media columns: chroma audio fingerprints and their alignment.

A recording is a WAV in a binary column. Its spectrogram is folded into twelve pitch classes; over the image of pitch classes
by time, FILTERS rectangle filters are evaluated by an integral image at every frame and quantized to two Gray-coded bits
each, which makes a packed 32-bit integer a frame. Recordings are aligned by the offsets at which their integers agree: the
offset with most votes wins and is verified by the share of bits that differ over the whole overlap.

Recordings of one fingerprint are one class and are searched once. The queries, a stated share of the rows, go to the executors in blocks of
about QUERY_BYTES, one after the other: every class looks its integers up in a block's sorted ones, what it finds is written to the shared
folder, and the block is given up before the next is made. Frames without sound carry no integer that is looked up.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import bounded_batches, checkpointed, shared_folder

RATE, FRAME, HOP, SPAN, FILTERS = 4000, 512, 128, 12, 16
LOW, HIGH = 110.0, 1760.0
#: Bytes of fingerprints in a block of queries; what is broadcast is about four times as much.
QUERY_BYTES = 8 << 20


def rectangles() -> list[tuple[int, int, int, int]]:
    """kind, first pitch class, pitch classes, frames of each filter, from one rule."""
    return [(i % 4, (5 * i) % 9, 2 + i % 3 + (i // 8), SPAN - 4 * (i % 2)) for i in range(FILTERS)]


def write_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def read_wav(data: bytes | None) -> tuple[np.ndarray, int]:
    """Samples as the mean of the channels, and the rate; no samples if the bytes are no 16-bit PCM file."""
    try:
        with wave.open(io.BytesIO(data or b""), "rb") as w:
            if w.getsampwidth() != 2:
                return np.zeros(0), RATE
            raw = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(float) / 32768
            return raw.reshape(-1, w.getnchannels()).mean(axis=1), w.getframerate()
    except (wave.Error, EOFError):
        return np.zeros(0), RATE


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Energy of the twelve pitch classes in each frame, scaled to length 1; silent frames are zero."""
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12))
    window = np.hanning(FRAME)
    freq = np.fft.rfftfreq(FRAME, 1 / rate)
    use = np.flatnonzero((freq >= LOW) & (freq <= HIGH))
    pitch = np.round(12 * np.log2(freq[use] / 440.0)).astype(int) % 12
    fold = np.zeros((len(use), 12))
    fold[np.arange(len(use)), pitch] = 1
    out = np.empty((n, 12))
    for i in range(0, n, 4096):
        part = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][i : min(n, i + 4096)]
        out[i : i + len(part)] = (np.abs(np.fft.rfft(part * window, axis=1)[:, use]) ** 2) @ fold
    size = np.sqrt((out**2).sum(axis=1, keepdims=True))
    return np.where(size > 1e-6, out / np.maximum(size, 1e-12), 0)


def fingerprint(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A packed integer for each place of the filters' window on the chroma image, and which of them have sound."""
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, bool)
    sums = np.zeros((len(image) + 1, 13))
    sums[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def box(t0, t1, y0, y1):
        return sums[at + t1, y1] - sums[at + t0, y1] - sums[at + t1, y0] + sums[at + t0, y0]

    code = np.zeros(n, np.uint32)
    for k, (kind, y, h, w) in enumerate(rectangles()):
        y1, half, mid = min(12, y + h), w // 2, y + max(1, h // 2)
        if kind == 0:  # earlier against later
            a, b = box(0, half, y, y1), box(half, w, y, y1)
        elif kind == 1:  # lower against higher classes
            a, b = box(0, w, y, mid), box(0, w, mid, y1)
        elif kind == 2:  # checkered
            a, b = box(0, half, y, mid) + box(half, w, mid, y1), box(half, w, y, mid) + box(0, half, mid, y1)
        else:  # the middle third against the rest
            third = w // 3
            a, b = box(third, 2 * third, y, y1), box(0, third, y, y1) + box(2 * third, w, y, y1)
        v = np.log((1 + a) / (1 + b))
        level = (v > -0.25).astype(np.uint32) + (v > 0) + (v > 0.25)
        code |= (level ^ (level >> np.uint32(1))).astype(np.uint32) << np.uint32(2 * k)
    return code, box(0, SPAN, 0, 12) > 1e-6


def melody(values: np.ndarray) -> np.ndarray:
    """A recording of a vector: a note of 256 samples for each value, its pitch by the value's size among the others'."""
    values = np.nan_to_num(np.asarray(values, float))
    if not len(values):
        return np.zeros(0)
    scale = values.std() or 1.0
    step = np.clip(np.round(6 * values / scale), -12, 12)
    freq = 440 * 2 ** (step / 12)
    t = np.arange(256) / RATE
    return (0.6 * np.sin(2 * np.pi * freq[:, None] * t) + 0.2 * np.sin(4 * np.pi * freq[:, None] * t)).ravel()


def recordings(embeddings: DataFrame) -> DataFrame:
    """(vec_id, audio): each vector as a WAV; null for a null vector."""
    bounded_batches(embeddings.sparkSession)

    def run(batches):
        for b in batches:
            audio = [None if v is None else write_wav(melody([x or 0.0 for x in v])) for v in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(audio, pa.binary())], ["vec_id", "audio"])

    return embeddings.select("vec_id", "embedding").mapInArrow(run, T.StructType([T.StructField("vec_id", embeddings.schema["vec_id"].dataType), T.StructField("audio", T.BinaryType())]))


def fingerprints(audio: DataFrame) -> DataFrame:
    """(vec_id, code, heard): the packed integers of each recording as little-endian bytes, and for each a byte 1 if it has sound."""

    def run(batches):
        for b in batches:
            found = [fingerprint(chroma(*read_wav(x))) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c, _ in found], pa.binary()), pa.array([h.astype(np.uint8).tobytes() for _, h in found], pa.binary())], ["vec_id", "code", "heard"])

    kind = T.StructType([T.StructField("vec_id", audio.schema["vec_id"].dataType), T.StructField("code", T.BinaryType()), T.StructField("heard", T.BinaryType())])
    return audio.select("vec_id", "audio").mapInArrow(run, kind)


def bit_errors(a: bytes, b: bytes, offset: int) -> tuple[int, float]:
    """Frames that overlap when b starts `offset` frames into a, and the share of bits that differ there."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    lo, hi = max(0, offset), min(len(x), offset + len(y))
    if lo >= hi:
        return 0, 1.0
    return hi - lo, float(np.bitwise_count(x[lo:hi] ^ y[lo - offset : hi - offset]).sum()) / (32 * (hi - lo))


#: Pairs of equal integers that are counted at once.
HITS = 1 << 20


def query_book(rows: list[tuple[str, bytes, bytes]]) -> dict:
    """A block of queries (owner, code, heard): the integers with sound of all, sorted, each with its query and frame."""
    codes = [np.frombuffer(c, np.uint32) for _, c, _ in rows]
    at = [np.flatnonzero(np.frombuffer(h, np.uint8)) for _, _, h in rows]
    keys = np.concatenate([c[i] for c, i in zip(codes, at, strict=True)]) if rows else np.zeros(0, np.uint32)
    order = np.argsort(keys, kind="stable")
    of = np.repeat(np.arange(len(rows)), [len(i) for i in at])
    return {"owners": [r[0] for r in rows], "codes": [r[1] for r in rows], "keys": keys[order], "of": of[order], "frames": np.concatenate([*at, np.zeros(0, np.int64)])[order]}


def vote(book: dict, code: bytes, heard: bytes, votes: int) -> list[tuple[int, int, int]]:
    """(query, offset, votes) of the queries that a recording agrees with `votes` times at one offset; of offsets with most votes the smallest.

    Pairs of equal integers are counted in runs of frames, so a held tone takes the memory of its offsets and not of its pairs.
    """
    at = np.flatnonzero(np.frombuffer(heard, np.uint8))
    k = np.frombuffer(code, np.uint32)[at]
    lo, hi = np.searchsorted(book["keys"], k, "left"), np.searchsorted(book["keys"], k, "right")
    n = hi - lo
    cells, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.searchsorted(np.cumsum(n), np.arange(HITS, int(n.sum()) + HITS, HITS))  # frames in runs of about HITS pairs
    for a, b in zip(np.concatenate([[0], ends + 1])[: len(ends)], np.minimum(ends + 1, len(n)), strict=True):  # none if nothing is equal
        m = n[a:b]
        hits = np.repeat(lo[a:b] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        offset = book["frames"][hits] - np.repeat(at[a:b], m)
        new, times = np.unique((book["of"][hits] << 32) + offset + (1 << 31), return_counts=True)
        cells, back = np.unique(np.concatenate([cells, new]), return_inverse=True)
        count = np.bincount(back, weights=np.concatenate([count, times]), minlength=len(cells)).astype(np.int64)
    cells, count = cells[count >= votes], count[count >= votes]
    query, offset = cells >> 32, (cells & 0xFFFFFFFF) - (1 << 31)
    best = np.lexsort((offset, -count, query))
    best = best[np.concatenate([[True], query[best][1:] != query[best][:-1]])] if len(best) else best
    return list(zip(query[best].tolist(), offset[best].tolist(), count[best].tolist(), strict=True))


def classed(audio: DataFrame) -> DataFrame:
    """(vec_id, class_id, code, heard): class_id is a digest of the fingerprint, so it needs no id."""
    digest = F.sha2(F.concat("code", "heard"), 256)
    return fingerprints(audio).select(F.col("vec_id").cast("long").alias("vec_id"), digest.alias("class_id"), "code", "heard")


def align(audio: DataFrame, every: int = 100, votes: int = 8, errors: float = 0.35) -> DataFrame:
    """Recordings that sound like each query, a row for each class of equal fingerprints that does.

    Queries are the rows whose id is divisible by `every`, each against all rows. Returns query_id, match_id (the smallest id
    of the class, null if none has one), n_copies (recordings of the class), offset (frames by which the match starts later in the query), n_votes,
    overlap (frames), bit_error_rate and class_id; matches have at least `votes` votes at their offset and at most `errors` of the
    bits of the overlap differ. Of offsets with equally many votes the smallest counts. A query's own class is among its
    matches. Recordings that are null, no PCM file, too short or silent have no votes; rows that repeat an id count as copies;
    an empty table gives no rows. `members` tells which recordings a class has.
    """
    return _align(checkpointed(classed(audio)), every, votes, errors)


def members(prints: DataFrame) -> DataFrame:
    """(vec_id, class_id) of each recording, as many rows as there are recordings."""
    return prints.select("vec_id", "class_id")


def align_with_members(audio: DataFrame, **options) -> DataFrame:
    """The rows of `align` (kind `match`) and of `members` (kind `member`: vec_id and class_id, the rest null) in one table.

    All links of a query to recordings are its matches joined to the members by class_id; the join is left to the reader,
    since it has the square of a large class.
    """
    prints = checkpointed(classed(audio))
    found = _align(prints, **options).withColumn("kind", F.lit("match"))
    return found.unionByName(members(prints).withColumn("kind", F.lit("member")), allowMissingColumns=True)


def _align(prints: DataFrame, every: int = 100, votes: int = 8, errors: float = 0.35) -> DataFrame:
    classes = checkpointed(prints.groupBy("class_id", "code", "heard").agg(F.min("vec_id").alias("match_id"), F.count("*").alias("n_copies")))
    asked = checkpointed(prints.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("q")).distinct())
    sought = classes.join(asked.select(F.col("q").alias("class_id")).distinct(), "class_id", "left_semi")
    size = sought.agg(F.sum(F.octet_length("code"))).first()[0] or 0  # one number
    blocks = max(1, -(-size // QUERY_BYTES))
    names = ["q", "class_id", "match_id", "offset", "n_votes", "n_copies", "overlap", "bit_error_rate"]

    def search(shared):
        def run(batches):
            for b in batches:
                rows, book = [], shared.value
                for own, first, copies, code, heard in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    for q, offset, n in vote(book, code, heard, votes):
                        rows.append((book["owners"][q], own, first, offset, n, copies, *bit_errors(book["codes"][q], code, offset)))
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                cols = list(zip(*rows, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names)

        return run

    spark, folder = prints.sparkSession, shared_folder(prints.sparkSession, "alignments")
    kind = "q string, class_id string, match_id long, offset int, n_votes long, n_copies long, overlap int, bit_error_rate double"
    for k in range(blocks):
        block = sought.where(F.pmod(F.xxhash64("class_id"), F.lit(blocks)) == k).select("class_id", "code", "heard").collect()  # about QUERY_BYTES
        book = spark.sparkContext.broadcast(query_book([(r.class_id, bytes(r.code), bytes(r.heard)) for r in block]))
        classes.select("class_id", "match_id", "n_copies", "code", "heard").mapInArrow(search(book), kind).write.mode("append").parquet(folder)
        book.destroy()
    scored = spark.read.schema(kind).parquet(folder)
    near = scored.where(F.col("bit_error_rate") <= errors)
    return near.join(asked, "q").select("query_id", "match_id", "n_copies", "offset", "n_votes", "overlap", "bit_error_rate", "class_id")
