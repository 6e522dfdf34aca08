"""Benchmark decontamination: an FM-index per shard of training text, searched for every window of every benchmark item.

A shard is an Arrow batch of documents. Its words become numbers in the benchmark's vocabulary; any other word, and the
end of a document, is a separator that no window crosses, so neighbouring separators are one and stretches shorter than the
shortest window are left out. Separators count as all different, which bounds the comparisons of the suffix sort. Over the
rest a suffix array is built by prefix doubling and turned into a Burrows-Wheeler transform held in a wavelet matrix, with the
text positions of the rows that start a stretch or fall on every SAMPLE-th place. All windows are searched backwards at once
by wavelet ranks; each occurrence walks back to a sampled row to learn its place. Overlapping occurrences merge to the spans
that are to be removed.

The vocabulary travels to the executors in blocks of at most BLOCK_BYTES. Mostly there is one, and nothing is shuffled. With more, each
block is a pass of its own whose hits are written to the shared folder before the next block is made, so that one block at a time is held
anywhere; the hits are then joined to the documents.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import ALNUM, LOWER, bounded_batches, buffers, shared_folder, text_bytes, with_text, word_hashes, word_spans

WINDOW, SAMPLE, BLOCK_BYTES = 10, 8, 16 << 20


def suffix_array(rank: np.ndarray) -> np.ndarray:
    """Order of all suffixes of a text given by the dense order of its symbols, the last of which is unique."""
    n = len(rank)
    by = np.argsort(rank, kind="stable")
    head = np.concatenate([[True], rank[by[1:]] != rank[by[:-1]]])
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[by] = start
    size = np.diff(np.append(np.flatnonzero(head), n))
    open_ = by[np.repeat(size > 1, size)]
    k = 1
    while len(open_):
        key = (rank[open_] << 32) | rank[open_ + k]
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        old = key >> 32
        place = np.arange(len(open_))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), place, 0))
        head = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(head, place, 0))
        rank[open_] = old + first - group
        size = np.diff(np.append(np.flatnonzero(head), len(open_)))
        open_ = open_[np.repeat(size > 1, size)]
        k *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class Bits:
    """A bit vector with rank: 64 bits a word, and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64 + 64, bits.dtype)]), bitorder="little")
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, top: int):
        self.levels, self.shifts = [], list(range(max(1, int(top).bit_length()) - 1, -1, -1))
        for s in self.shifts:
            bit = ((symbols >> s) & 1).astype(bool)
            self.levels.append((Bits(bit), int(len(bit) - bit.sum())))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place i."""
        low = np.zeros_like(i)
        for s, (bits, zeros) in zip(self.shifts, self.levels, strict=True):
            one = (symbol >> s) & 1 == 1
            ri, rl = bits.rank1(i), bits.rank1(low)
            i, low = np.where(one, zeros + ri, i - ri), np.where(one, zeros + rl, low - rl)
        return i - low

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for s, (bits, zeros) in zip(self.shifts, self.levels, strict=True):
            one, r = bits.get(i), bits.rank1(i)
            out |= one.astype(np.int64) << s
            i = np.where(one, zeros + r, i - r)
        return out


class FMIndex:
    """Over a text of symbols 1..top with 0 as separator; `starts` marks places whose left neighbour is a separator."""

    def __init__(self, text: np.ndarray, starts: np.ndarray, top: int):
        apart = text == 0
        rank = np.where(apart, np.cumsum(apart) - 1, text + apart.sum())
        sa = suffix_array(rank)
        self.tree = WaveletMatrix(text[sa - 1], top)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        kept = starts | (np.arange(len(text)) % SAMPLE == 0)
        self.sampled = Bits(kept[sa])
        self.places = sa[kept[sa]]

    def search(self, patterns: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all patterns (rows, filled up at the right): those found, and their row ranges."""
        which, step = np.arange(len(lens)), 0
        lo, hi = np.zeros(len(lens), np.int64), np.full(len(lens), self.before[-1])
        done = [np.zeros((3, 0), np.int64)]
        while len(which):
            c = patterns[which, lens[which] - 1 - step]
            lo, hi = self.before[c] + self.tree.rank(c, lo), self.before[c] + self.tree.rank(c, hi)
            step += 1
            some, over = lo < hi, lens[which] == step
            done.append(np.stack([which, lo, hi])[:, some & over])
            which, lo, hi = (x[some & ~over] for x in (which, lo, hi))
        return tuple(np.concatenate(done, axis=1))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text places of suffix-array rows, by walking left to a sampled row."""
        out, back, where = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        while len(rows):
            known = self.sampled.get(rows)
            out[where[known]] = self.places[self.sampled.rank1(rows[known])] + back
            rows, where = rows[~known], where[~known]
            c = self.tree.access(rows)
            rows = self.before[c] + self.tree.rank(c, rows)
            back += 1
        return out


def words_of(text: bytes) -> list[bytes]:
    data = LOWER[np.frombuffer(text, np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def phrase_book(items: list[tuple[str, bytes]], window: int) -> dict | None:
    """The distinct windows of a block of items, as numbers in its vocabulary, and the items of each window."""
    windows: dict[tuple, set] = {}
    for name, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(name)
    if not windows:
        return None
    vocabulary = sorted({w for key in windows for w in key})
    flat = np.frombuffer(b"".join(vocabulary), np.uint8)
    ends = np.cumsum([len(w) for w in vocabulary])
    starts = ends - [len(w) for w in vocabulary]
    seed = 0
    hashes = word_hashes(flat, starts, ends)
    while len(np.unique(hashes)) < len(hashes):  # two words share a hash: take other ones
        seed += 2
        hashes = word_hashes(flat, starts, ends, seed)
    order = np.argsort(hashes)
    number = {vocabulary[i]: k + 1 for k, i in enumerate(order.tolist())}
    lens = np.array([len(key) for key in windows])
    patterns = np.zeros((len(windows), int(lens.max())), np.int64)
    for row, key in zip(patterns, windows, strict=True):
        row[: len(key)] = [number[w] for w in key]
    return {"seed": seed, "hashes": hashes[order], "words": [vocabulary[i] for i in order.tolist()], "patterns": patterns, "lens": lens, "items": [sorted(x) for x in windows.values()]}


def occurrences(book: dict, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of all occurrences in a shard whose bytes, words and rows are given."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(starts):
        return none
    h = word_hashes(data, starts, ends, book["seed"])
    at = np.minimum(np.searchsorted(book["hashes"], h), len(book["hashes"]) - 1)
    ids = np.where(book["hashes"][at] == h, at + 1, 0)
    shortest, top = int(book["lens"].min()), len(book["hashes"])
    while True:
        inside = ids > 0
        fresh = inside & np.concatenate([[True], ~inside[:-1] | (row[1:] != row[:-1])])
        first = np.flatnonzero(fresh)
        close = np.flatnonzero(inside & np.concatenate([fresh[1:] | ~inside[1:], [True]])) + 1
        long = close - first >= shortest
        first, close = first[long], close[long]
        if not len(first):
            return none
        lens = close - first + 1  # and a separator
        heads = np.cumsum(lens) - lens
        word = np.arange(int(lens.sum())) + np.repeat(first - heads, lens)
        last = heads + lens - 1
        word[last] = 0
        text = ids[word]
        text[last] = 0
        begins = np.zeros(len(text), bool)
        begins[heads] = True
        index = FMIndex(text, begins, top)
        which, lo, hi = index.search(book["patterns"], book["lens"])
        count = hi - lo
        rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        found, window = word[index.locate(rows)], np.repeat(which, count)
        # words matched by hash: compare each that is part of an occurrence with the vocabulary
        hit = np.zeros(len(starts) + 1, np.int64)
        np.add.at(hit, found, 1)
        np.add.at(hit, found + book["lens"][window], -1)
        raw = data.tobytes() if len(found) else b""
        wrong = [i for i in np.flatnonzero(np.cumsum(hit)[:-1] > 0).tolist() if raw[starts[i] : ends[i]] != book["words"][ids[i] - 1]]
        if not wrong:
            return found, window
        ids[wrong] = 0


class _Batch:
    """One Arrow batch of (doc_id, text): its words, the words hit and the items found so far."""

    def __init__(self, texts: pa.Array):
        self.data, self.off = buffers(texts)
        self.data, self.n = LOWER[self.data], len(texts)
        self.starts, self.ends, self.row = word_spans(self.data, self.off, ALNUM)
        self.base = np.searchsorted(self.row, np.arange(self.n + 1))  # first word of each row
        self.hit, self.items = np.zeros(len(self.starts) + 1, np.int64), [set() for _ in range(self.n)]

    def add(self, first: np.ndarray, close: np.ndarray) -> None:
        np.add.at(self.hit, first, 1)
        np.add.at(self.hit, close, -1)

    def search(self, book: dict | None) -> None:
        if book is None:
            return
        found, window = occurrences(book, self.data, self.starts, self.ends, self.row)
        self.add(found, found + book["lens"][window])
        named = book["items"]
        for p in (np.unique(self.row[found] * len(named) + window) if len(found) else found).tolist():
            self.items[p // len(named)].update(named[p % len(named)])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which words are hit; first and last word of each maximal run, and where each row's runs begin."""
        row, covered = self.row, np.cumsum(self.hit)[:-1] > 0
        edge = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
        head = covered & (edge | ~np.concatenate([[False], covered[:-1]])[: len(covered)])
        tail = covered & np.concatenate([head[1:] | ~covered[1:] | edge[1:], [True]])[: len(covered)]
        heads, tails = np.flatnonzero(head), np.flatnonzero(tail)
        return covered, heads, tails, np.searchsorted(row[heads], np.arange(self.n + 1))


def _lists(cut: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(values, pa.int64()))


def _results(batch: _Batch) -> list[pa.Array]:
    """n_words, n_hit, n_items, items_sha256, contaminated, items, spans and word_spans of a batch that has been searched."""
    covered, heads, tails, cut = batch.runs()
    owner, items = batch.row[heads], [sorted(x) for x in batch.items]
    n_hit = np.bincount(batch.row[covered], minlength=batch.n)
    digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
    as_bytes = ((batch.starts[heads] - batch.off[owner]) << 32) | (batch.ends[tails] - batch.off[owner])
    as_words = ((heads - batch.base[owner]) << 32) | (tails + 1 - batch.base[owner])
    return [pa.array(np.diff(batch.base)), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array(digest), pa.array(n_hit > 0), pa.array(items, pa.list_(pa.string())), _lists(cut, as_bytes), _lists(cut, as_words)]


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<long>, word_spans array<long>"
HITS = "mark long, items array<string>, runs array<long>"


def _in_one_pass(docs: DataFrame, book, schema: T.StructType) -> DataFrame:
    def run(batches):
        for b in batches:
            batch = _Batch(b.column(1))
            batch.search(book.value)
            yield pa.RecordBatch.from_arrays([b.column(0), *_results(batch)], schema.fieldNames())

    return docs.select("doc_id", text_bytes().alias("text")).mapInArrow(run, schema)


def _block_hits(docs: DataFrame, book, schema: T.StructType) -> DataFrame:
    """(doc_id, mark, items, runs) of the documents with hits in one block; runs: first word << 32 | the word after the last."""

    def run(batches):
        for b in batches:
            batch = _Batch(b.column(1))
            batch.search(book.value)
            _, heads, tails, cut = batch.runs()
            owner = batch.row[heads]
            runs = _lists(cut, ((heads - batch.base[owner]) << 32) | (tails + 1 - batch.base[owner]))
            some = np.flatnonzero(np.diff(cut) > 0)
            arrays = [b.column(0).take(some), b.column(2).take(some), pa.array([sorted(batch.items[i]) for i in some], pa.list_(pa.string())), runs.take(pa.array(some))]
            yield pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

    return docs.select("doc_id", text_bytes().alias("text"), F.xxhash64("text").alias("mark")).mapInArrow(run, schema)


def _with_hits(docs: DataFrame, hits: DataFrame, schema: T.StructType) -> DataFrame:
    """The results of documents from the hits of all blocks; rows alike in doc_id and text have the same hits."""
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    whole = hits.dropDuplicates(["doc_id", "mark", "block"]).groupBy("doc_id", "mark").agg(flat("items"), flat("runs"))
    whole = whole.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "items", "runs")
    joined = docs.withColumn("mark", F.xxhash64("text")).join(whole, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left")

    def run(batches):
        for b in batches:
            batch = _Batch(b.column(1))
            batch.items = [set(x or ()) for x in b.column(2).to_pylist()]
            for base, runs in zip(batch.base.tolist(), b.column(3).to_pylist(), strict=False):
                r = np.array(runs or (), np.int64)
                batch.add(base + (r >> 32), base + (r & 0xFFFFFFFF))
            yield pa.RecordBatch.from_arrays([b.column(0), *_results(batch)], schema.fieldNames())

    return joined.select("doc_id", text_bytes().alias("text"), "items", "runs").mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted item_ids), spans, word_spans.

    A word is hit if it lies in an occurrence of any `window` consecutive words of an item (of the whole item, if it has
    fewer). spans: the maximal runs of hit words, each start << 32 | end in bytes of the text; word_spans: the same in words. Null text
    has no words, an item without words has no windows; item_ids that repeat are one item, and a null item_id is named "null"; repeated
    documents stay; an empty table of either kind gives what it implies. Other columns are not read.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kept = lambda ddl: T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *T.StructType.fromDDL(ddl).fields])
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), text_bytes().alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one number
    blocks = max(1, math.ceil(2 * size / BLOCK_BYTES))
    book_of = lambda part: spark.sparkContext.broadcast(phrase_book([(r.name, bytes(r.text)) for r in part.collect()], window))  # noqa: E731 - at most a block, or its largest item
    if blocks == 1:
        return _in_one_pass(docs, book_of(items), kept(RESULT))
    folder, numbered = shared_folder(spark, "benchmark-hits"), kept(f"{HITS}, block int")
    for k in range(blocks):
        book = book_of(items.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k))
        _block_hits(docs, book, kept(HITS)).withColumn("block", F.lit(k)).write.mode("append").parquet(folder)
        book.destroy()
    return _with_hits(docs, spark.read.schema(numbered).parquet(folder), kept(RESULT))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with benchmark passages cut out of `text` and `n_chars` counted anew, in all their columns.

    Each row is searched and cut where it stands, repeated rows alike. A document of which no word is left goes, if it had a
    passage; all others stay, and a null text stays null. An empty table of either kind changes nothing.
    """
    row = F.struct(*docs.columns).alias("doc_id")
    found = contamination(docs.select(row, "text"), benchmark, window).select(F.col("doc_id").alias("row"), "n_words", "n_hit", "spans")
    raw = F.encode(F.col("row.text"), "utf-8")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))))
    begins = F.concat(F.transform("spans", lambda x: F.shiftright(x, 32)), F.array(F.octet_length("row.text").cast("long")))
    pieces = F.transform(F.arrays_zip(ends.alias("a"), begins.alias("b")), lambda p: F.substring(raw, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")))
    text = F.when(F.size("spans") > 0, F.decode(F.array_join(F.transform(pieces, lambda p: F.decode(p, "utf-8")), "").cast("binary"), "utf-8")).otherwise(F.col("row.text"))
    left = found.where("n_hit = 0 or n_hit < n_words").select("row", text.alias("_text"))
    return with_text(left, docs, F.col("_text"))
