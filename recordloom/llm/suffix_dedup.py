"""Exact substring dedup: bytes covered by a string of `length` bytes that also starts earlier are removed.

A suffix array of the whole corpus is too large to move, so it is built sparse and in pieces that need nothing from
each other. Of every window of `length` bytes the gram with the least hash is its anchor; windows that are alike have
the same anchor, so they meet in the anchor's bin. Neighbouring windows mostly share their anchor and travel as one
stretch of text: `a` bytes before the anchor, `b` from it on. Within a bin the suffixes that start at the anchors, and the
reversed prefixes before them, are sorted deep-shallow: multikey quicksort on 8-byte characters to a shallow depth, then a
blind trie for each group that is still undecided. Two windows with j bytes before their anchor are alike if and only if
their prefixes share j bytes and their suffixes length - j, which both orders' common-prefix lengths tell. Of windows
that are alike the one with the smallest (document, start) stays; the others cover what is removed.

Stretches that are alike are reduced to the earliest before they are sent, and again as a bin takes them in, so copies
cost no memory. An anchor with more than a bin's bytes of distinct stretches, such as one in a short line that most documents have, gets
a second key: its windows are sent on by their whole text, and of those alike all but the earliest are removed. So no task
holds more than a bin and a stretch, whatever the documents have in common.

The number of shuffle partitions is bounded (MOST_PARTS). Where there are more bins, a partition holds many: its task
splits what arrives into bins, which Spark sorts within the partition and which are then taken one after the other.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import bounded_batches, buffers, checkpointed, mix, text_bytes, with_text
from recordloom.llm.simhash import with_owner

LENGTH, GRAM = 100, 20
#: Window starts hashed at once, and bytes of stretches that a bin holds on average.
CHUNK, BIN_BYTES = 1 << 18, 24 << 20
#: Shuffle partitions at most; windows of hot anchors in one output batch.
MOST_PARTS, WINDOWS = 20_000, 1 << 15
#: 8-byte characters compared by multikey quicksort before the blind tries take over.
SHALLOW = 4
FIELDS = np.dtype([("doc", "<i8"), ("sub", "<i8"), ("at", "<i8"), ("a", "<u2"), ("b", "<u2")])
SPAN = np.dtype([("doc", "<i8"), ("sub", "<i8"), ("lo", "<i8"), ("hi", "<i8")])


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each gram, by doubling: a gram of 20 is its first 16 bytes and its last 16 joined."""
    with np.errstate(over="ignore"):
        h, span = data.astype(np.uint64) + np.uint64(1), 1
        for i in range(16):
            if span == gram:
                break
            step = min(span, gram - span)
            h = h[: len(h) - step] * np.uint64(0x9E3779B97F4A7C15 + 2 * i) + h[step:]
            h ^= h >> np.uint64(29)
            span += step
        return mix(h)


def stretches(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window, anchor and anchor's hash of each run of windows with one anchor."""
    found, w = [], length - gram + 1
    lens = np.diff(off)
    valid = np.zeros(len(data) + 1, np.int8)
    ok = lens >= length
    np.add.at(valid, off[:-1][ok], 1)
    np.add.at(valid, off[1:][ok] - length + 1, -1)
    valid = np.cumsum(valid, dtype=np.int8)
    for c in range(0, len(data) - length + 1, CHUNK):
        part = data[c : c + CHUNK + length - 1]
        h = gram_hashes(part, gram)
        v = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)  # ties: the leftmost
        span = 1
        while span < w:
            step = min(span, w - span)
            v = np.minimum(v[: len(v) - step], v[step:])
            span += step
        at = (v & np.uint64(0xFFFFFFFF)).astype(np.int64)
        live = valid[c : c + len(at)] > 0
        new = np.empty(len(at), bool)
        new[:1] = True
        new[1:] = (at[1:] != at[:-1]) | (live[1:] != live[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1
        keep = live[first]
        first, last = first[keep], last[keep]
        found.append((first + c, last + c, at[first] + c, h[at[first]]))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices of all slices [start, start + len), one after the other."""
    ends = np.cumsum(lens)
    out = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    if len(out):
        heads = np.concatenate([[0], ends[:-1]])
        out[heads] = starts - np.concatenate([[0], starts[:-1] + lens[:-1] - 1])
        out[0] = starts[0]
    return np.cumsum(out)


def gather(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """The bytes of all slices, one after the other; about `step` of them at once are addressed by number."""
    ends = np.cumsum(lens)
    out = np.empty(int(ends[-1]) if len(ends) else 0, data.dtype)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, len(out), step), "right"), len(lens)))
    for a, b in zip(np.append(0, cuts)[:-1].tolist(), cuts.tolist(), strict=True) if len(lens) else ():
        if a < b:
            out[ends[a] - lens[a] : ends[b - 1]] = data[ragged(starts[a:b], lens[a:b])]
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Hashes of slices of at least 8 bytes, by their 8-byte words; equal slices have equal hashes."""
    words = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    h = lens.astype(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, int(lens.max(initial=0)), 8):
            at = np.minimum(k, lens - 8)  # the last word ends with the slice; further ones repeat it
            h = (h ^ words[starts + at]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return mix(h)


def collapse(data: np.ndarray, starts: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of stretches alike in bytes, a and b the earliest; (indices kept, spans of all others, wholly covered).

    Rows alike in id and text are one document: such an occurrence is the same one and covers nothing.
    """
    lens = items["a"].astype(np.int64) + items["b"]
    h = span_hashes(data, starts, lens) ^ mix(items["a"].astype(np.uint64))
    order = np.lexsort((items["at"], items["sub"], items["doc"], h))
    same = np.zeros(len(order), bool)
    same[1:] = h[order[1:]] == h[order[:-1]]
    head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))] if len(order) else order
    own, theirs = order[same], head[same]
    if len(own):
        alike = (lens[own] == lens[theirs]) & (items["a"][own] == items["a"][theirs])
        size = np.where(alike, lens[own], 1)
        differ = gather(data, starts[own], size) != gather(data, starts[theirs], size)
        alike &= np.add.reduceat(differ, np.concatenate([[0], np.cumsum(size)[:-1]])) == 0
        own, theirs = own[alike], theirs[alike]  # others, whose hashes met by chance, stay
    kept = np.ones(len(items), bool)
    kept[own] = False
    x, y = items[own], items[theirs]
    x = x[(x["doc"] != y["doc"]) | (x["sub"] != y["sub"]) | (x["at"] != y["at"])]
    spans = np.empty(len(x), SPAN)
    spans["doc"], spans["sub"], spans["lo"], spans["hi"] = x["doc"], x["sub"], x["at"] - x["a"], x["at"] + x["b"]
    return np.flatnonzero(kept), spans


def merged(spans: np.ndarray) -> np.ndarray:
    """The maximal runs that the spans of each document cover."""
    s = spans[np.lexsort((spans["lo"], spans["sub"], spans["doc"]))]
    if len(s) < 2:
        return s
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s["doc"][1:] != s["doc"][:-1]) | (s["sub"][1:] != s["sub"][:-1])
    group = np.cumsum(fresh)
    wide = np.int64(1) << 42
    reach = np.maximum.accumulate(s["hi"] + group * wide) - group * wide  # the furthest end so far in its document
    fresh[1:] |= s["lo"][1:] > reach[:-1]
    heads = np.flatnonzero(fresh)
    out = s[heads].copy()
    out["hi"] = np.maximum.reduceat(s["hi"], heads)
    return out


# ---- deep-shallow sorting ------------------------------------------------------------------------------------------


def blind_trie_order(keys: list[bytes]) -> list[int]:
    """The sorted order of keys of one length by a blind trie: a node knows only the depth at which its keys part.

    A key goes down blindly by its bytes at those depths, is compared once with a key below, and branches off where
    the two part.
    """
    # a node is (depth, children by byte), a leaf ("leaf", its equal keys)
    numbers = [int.from_bytes(k, "big") for k in keys]
    bits = 8 * len(keys[0])
    top: object = ("leaf", [0])
    for i in range(1, len(keys)):
        key, node = keys[i], top
        while node[0] != "leaf":
            node = node[1].get(key[node[0]]) or next(iter(node[1].values()))
        differ = numbers[i] ^ numbers[node[1][0]]
        if not differ:
            node[1].append(i)
            continue
        depth = (bits - differ.bit_length()) >> 3
        parent, node = None, top
        while node[0] != "leaf" and node[0] < depth:
            parent, node = node, node[1][key[node[0]]]
        if node[0] == depth:
            node[1][key[depth]] = ("leaf", [i])
            continue
        below = node
        while below[0] != "leaf":
            below = next(iter(below[1].values()))
        fork = (depth, {keys[below[1][0]][depth]: node, key[depth]: ("leaf", [i])})
        if parent is None:
            top = fork
        else:
            parent[1][key[parent[0]]] = fork
    out, stack = [], [top]
    while stack:
        node = stack.pop()
        if node[0] == "leaf":
            out.extend(node[1])
        else:
            stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
    return out


def multikey_quicksort(words: np.ndarray, order: np.ndarray, lo: np.ndarray, size: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort each slice [lo, lo + size) of `order` by its rows' words up to `limit` of them, in place; the slices left that agree in all of these.

    All slices are partitioned at once in every round: less than, equal to and greater than their pivot, the median of three
    drawn words. The equal part goes on with the next word, the other two with the same.
    """
    draw, depth, alike = np.random.default_rng(11), np.zeros(len(lo), np.int64), []
    while len(lo):
        rows, part = order[ragged(lo, size)], np.repeat(np.arange(len(lo)), size)
        word = words[rows, depth[part]].astype(np.uint64)
        begin = np.cumsum(size) - size
        pivot = np.sort(word[begin + (draw.random((3, len(lo))) * size).astype(np.int64)], axis=0)[1][part]
        side = 1 + (word > pivot).astype(np.int64) - (word < pivot)
        count = np.bincount(3 * part + side, minlength=3 * len(lo)).reshape(-1, 3)
        at = lo[:, None] + np.cumsum(count, axis=1) - count
        for c in range(3):
            k = count[:, c]
            order[np.repeat(at[:, c] - np.cumsum(k) + k, k) + np.arange(int(k.sum()))] = rows[side == c]
        lo, size, depth = at.ravel(), count.ravel(), (depth[:, None] + np.array([0, 1, 0])).ravel()
        several, deep = size > 1, depth >= limit
        alike.append((lo[several & deep], size[several & deep]))
        lo, size, depth = (x[several & ~deep] for x in (lo, size, depth))
    return tuple(np.concatenate([x[i] for x in alike]) if alike else np.zeros(0, np.int64) for i in (0, 1))


def deep_shallow_order(group: np.ndarray, texts: np.ndarray, lens: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Order of the rows by group, then text, a shorter one before its extensions. texts: bytes padded with zeros."""
    width = -(-(texts.shape[1] + 1) // 8) * 8
    padded = np.zeros((len(texts), width), np.uint8)
    padded[:, : texts.shape[1]] = texts
    padded[:, -1] = lens  # between texts alike but for zero bytes
    words = padded.view(">u8")
    order = np.argsort(group, kind="stable")
    heads = np.flatnonzero(np.diff(group[order], prepend=-1))
    size = np.diff(heads, append=len(order))
    several, limit = size > 1, min(shallow, words.shape[1])
    lo, size = multikey_quicksort(words, order, heads[several], size[several], limit)
    if limit < words.shape[1]:
        for a, n in zip(lo.tolist(), size.tolist(), strict=True):
            rows = order[a : a + n]
            order[a : a + n] = rows[blind_trie_order([r.tobytes() for r in padded[rows, 8 * limit :]])]
    return order


def neighbours(order: np.ndarray, group: np.ndarray, texts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Common-prefix length of each row with the one before it in the order; -1 where the group begins."""
    out = np.full(len(order), -1, np.int64)
    for c in range(1, len(order), 1 << 16):
        x, y = order[c : c + (1 << 16)], order[c - 1 : c - 1 + (1 << 16)][: len(order[c : c + (1 << 16)])]
        differ = texts[x] != texts[y]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), texts.shape[1])
        shared = np.minimum(shared, np.minimum(lens[x], lens[y]))
        out[c : c + len(x)] = np.where(group[x] == group[y], shared, -1)
    return out


def bin_spans(data: np.ndarray, starts: np.ndarray, items: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The removed spans among one bin's distinct stretches."""
    none = np.zeros(0, SPAN)
    if len(items) < 2:
        return none
    items_at = starts + items["a"]
    grams = np.lib.stride_tricks.sliding_window_view(data, gram)[items_at]
    with np.errstate(over="ignore"):
        h = np.zeros(len(items), np.uint64)
        for k in range(gram):
            h = h * np.uint64(0x9E3779B97F4A7C15) + grams[:, k] + np.uint64(1)
    _, group, count = np.unique(mix(h), return_inverse=True, return_counts=True)
    keep = count[group] > 1
    if not keep.any():
        return none
    items, items_at, group = items[keep], items_at[keep], group[keep]
    by = np.lexsort((items["at"], items["sub"], items["doc"]))
    items, items_at, group = items[by], items_at[by], group[by]
    a, b = items["a"].astype(np.int64), items["b"].astype(np.int64)
    reach = np.arange(length)
    padded = np.concatenate([np.zeros(length, np.uint8), data, np.zeros(length, np.uint8)])
    right = padded[items_at[:, None] + length + reach] * (reach < b[:, None])
    left = padded[items_at[:, None] + length - 1 - reach[: length - gram]] * (reach[: length - gram] < a[:, None])
    r_order = deep_shallow_order(group, right, b)
    r_lcp = neighbours(r_order, group, right, b)
    l_order = deep_shallow_order(group, left, a)
    l_lcp = neighbours(l_order, group, left, a)
    best = np.zeros((2, len(items)), np.int64)
    for x, (order, lcp) in enumerate(((l_order, l_lcp), (r_order, r_lcp))):
        best[x, order] = np.maximum(lcp, np.append(lcp[1:], -1))
    live = best.sum(axis=0) >= length
    if not live.any():
        return none
    lo, hi = np.full(len(items), -1, np.int64), np.zeros(len(items), np.int64)
    for j in range(length - gram + 1):
        rows = np.flatnonzero(live & (a >= j) & (b >= length - j))
        if len(rows) < 2:
            continue
        l_class, r_class = np.empty(len(items), np.int64), np.empty(len(items), np.int64)
        l_class[l_order], r_class[r_order] = np.cumsum(l_lcp < j), np.cumsum(r_lcp < length - j)
        key = l_class[rows] * (len(items) + 1) + r_class[rows]
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        again = rows[first[back] != np.arange(len(rows))]
        lo[again] = j
        hi[again] = np.where(hi[again] == 0, length - j, hi[again])  # j rises: the first is the least
    hit = lo >= 0
    spans = np.empty(int(hit.sum()), SPAN)
    spans["doc"], spans["sub"] = items["doc"][hit], items["sub"][hit]
    spans["lo"], spans["hi"] = items["at"][hit] - lo[hit], items["at"][hit] + hi[hit]
    return spans


# ---- the distributed part ------------------------------------------------------------------------------------------


def _pack(items: np.ndarray, text: np.ndarray, level: int = 6) -> bytes:
    """Stretches as one compressed row: fields column by column, ids and places as differences, then all bytes."""
    head = b"".join(np.diff(items[n], prepend=items[n].dtype.type(0)).tobytes() if n in ("doc", "at") else items[n].tobytes() for n in FIELDS.names)
    return zstandard.ZstdCompressor(level=level).compress(len(items).to_bytes(8, "little") + head + text.tobytes())


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at = int.from_bytes(raw[:8], "little"), 8
    items = np.empty(n, FIELDS)
    for name in FIELDS.names:
        kind = FIELDS[name]
        column = np.frombuffer(raw, kind, n, at)
        items[name] = np.cumsum(column) if name in ("doc", "at") else column
        at += n * kind.itemsize
    return items, np.frombuffer(raw, np.uint8, offset=at)


def anchor_hashes(text: np.ndarray, starts: np.ndarray, items: np.ndarray, gram: int) -> np.ndarray:
    """The hashes of the grams at the stretches' anchors."""
    grams = gather(text, starts + items["a"], np.full(len(items), gram, np.int64))
    return gram_hashes(grams, gram)[::gram] if len(grams) else np.zeros(0, np.uint64)


def _begins(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each stretch begins in the joined text, and its length."""
    lens = items["a"].astype(np.int64) + items["b"]
    return np.cumsum(lens) - lens, lens


def _blobs(home: np.ndarray, items: np.ndarray, text: np.ndarray, starts: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Stretches packed into a blob for each home, in order of document and place."""
    order = np.lexsort((items["at"], items["sub"], items["doc"], home))
    home, items, starts = home[order], items[order], starts[order]
    edges = np.append(np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])), len(home)) if len(home) else [0]
    names, blobs = [], []
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        part = items[x:y]
        names.append(int(home[x]))
        blobs.append(_pack(part, gather(text, starts[x:y], part["a"].astype(np.int64) + part["b"])))
    return names, blobs


def _named(names: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bin", "blob"])


def _shards(length: int, gram: int, parts: int):
    """Each batch's stretches as a blob for each partition; what repeats within the batch as one of spans, with a negative number."""

    def run(batches):
        for b in batches:
            doc, sub = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            data, off = buffers(b.column(2))
            first, last, at, h = stretches(data, off, length, gram)
            if not len(first):
                continue
            row = np.searchsorted(off, first, "right") - 1
            items = np.empty(len(first), FIELDS)
            items["doc"], items["sub"], items["at"] = doc[row], sub[row], at - off[row]
            items["a"], items["b"] = at - first, last + length - at
            kept, spans = collapse(data, first, items)
            names, blobs = _blobs((h[kept] % np.uint64(parts)).astype(np.int64), items[kept], data, first[kept])
            if len(spans):
                names.append(-1 - int(spans["doc"][0] % parts))
                blobs.append(zstandard.compress(merged(spans).tobytes()))
            yield _named(names, blobs)

    return run


def _split(gram: int, parts: int, fine: int, buffer: int):
    """The blobs of one partition as blobs of its bins, from buffers of about `buffer` bytes of text."""

    def out(held):
        items, text = np.concatenate([i for i, _ in held]), np.concatenate([t for _, t in held])
        starts, _ = _begins(items)
        home = ((anchor_hashes(text, starts, items, gram) // np.uint64(parts)) % np.uint64(fine)).astype(np.int64)
        return _named(*_blobs(home, items, text, starts))

    def run(batches):
        held, size = [], 0
        for b in batches:
            for name, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if name < 0:
                    yield _named([-1], [blob.as_py()])
                    continue
                held.append(_unpack(blob.as_py()))
                size += len(held[-1][1])
                if size > buffer:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    return run


class Bin:
    """Stretches of one bin as they come in. Copies are dropped, and anchors with more than `most` bytes of distinct stretches give theirs away."""

    def __init__(self, length: int, gram: int, most: int):
        self.length, self.gram, self.most, self.limit = length, gram, most, 4 * most
        self.items, self.text, self.size, self.hot = [], [], 0, np.zeros(0, np.uint64)

    def add(self, blob: bytes):
        """Take a blob in; yields what is given away: (spans, None) or (stretches, their text)."""
        items, text = _unpack(blob)
        if len(self.hot):
            starts, lens = _begins(items)
            away = np.isin(anchor_hashes(text, starts, items, self.gram), self.hot)
            yield items[away], gather(text, starts[away], lens[away])
            items, text = items[~away], gather(text, starts[~away], lens[~away])
        self.items.append(items)
        self.text.append(text)
        self.size += len(text)
        if self.size > self.limit:
            yield from self.shrink()
            self.limit = max(4 * self.most, 2 * self.size)

    def shrink(self):
        items, text = np.concatenate(self.items), np.concatenate(self.text)
        starts, lens = _begins(items)
        kept, spans = collapse(text, starts, items)
        yield spans, None
        if lens[kept].sum() > self.most:
            h = anchor_hashes(text, starts[kept], items[kept], self.gram)
            _, group = np.unique(h, return_inverse=True)
            away = np.bincount(group, lens[kept])[group] > self.most
            if away.any():
                self.hot = np.union1d(self.hot, h[away])
                gone, kept = kept[away], kept[~away]
                yield items[gone], gather(text, starts[gone], lens[gone])
        self.items, self.text = [items[kept]], [gather(text, starts[kept], lens[kept])]
        self.size = len(self.text[0])

    def close(self):
        yield from self.shrink()
        items, text = self.items[0], self.text[0]
        starts, lens = _begins(items)
        if not len(items):
            return
        h = anchor_hashes(text, starts, items, self.gram)
        order = np.argsort(h, kind="stable")  # anchors are apart from each other: take as many as make about a bin
        ends = np.flatnonzero(np.append(h[order][1:] != h[order][:-1], True)) + 1
        step = np.cumsum(lens[order])[ends - 1] // self.most
        cuts = np.concatenate([[0], ends[np.append(step[1:] != step[:-1], True)]])
        for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = np.sort(order[x:y])
            yield bin_spans(text, starts[own], items[own], self.length, self.gram), None


def _bins(length: int, gram: int, most: int):
    def spans_out(spans):
        spans = merged(spans)
        both = (spans["lo"] << 32) | spans["hi"]
        return pa.RecordBatch.from_arrays([pa.array(spans["doc"]), pa.array(spans["sub"]), pa.array(both), pa.nulls(len(spans), pa.binary())], ["doc", "sub", "span", "window"])

    def windows_out(items, text):
        starts, lens = _begins(items)
        n = lens - length + 1
        of, nth = np.repeat(np.arange(len(items)), n), ragged(np.zeros(len(items), np.int64), n)
        for c in range(0, len(of), WINDOWS):
            i, w = of[c : c + WINDOWS], nth[c : c + WINDOWS]
            lo = items["at"][i] - items["a"][i] + w
            data = gather(text, starts[i] + w, np.full(len(i), length, np.int64))
            column = pa.Array.from_buffers(pa.binary(), len(i), [None, pa.py_buffer(np.arange(0, len(data) + 1, length, dtype=np.int32)), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(items["doc"][i]), pa.array(items["sub"][i]), pa.array((lo << 32) | (lo + length)), column], ["doc", "sub", "span", "window"])

    def out(found):
        for rows, text in found:
            if len(rows):
                if text is None:
                    yield spans_out(rows)
                else:
                    yield from windows_out(rows, text)

    def run(batches):
        now, held = None, None
        for b in batches:
            for name, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if name < 0:
                    yield spans_out(np.frombuffer(zstandard.decompress(blob.as_py()), SPAN))
                    continue
                if held is not None and name != now:
                    yield from out(held.close())
                    held = None
                now, held = name, held or Bin(length, gram, most)
                yield from out(held.add(blob.as_py()))
        if held is not None:
            yield from out(held.close())

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """The documents with their order as _doc, _sub: the id, null last; rows that share an id are told apart by a hash of their text."""
    ids = docs.select("doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    sub = F.xxhash64(text_bytes()) if ids else F.lit(0).cast("long")
    return docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)), "_sub": sub})


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, bin_bytes: int = BIN_BYTES, most_parts: int = MOST_PARTS) -> DataFrame:
    """(_doc, _sub, spans) of keyed documents that have any: spans, each start << 32 | end in bytes, in no order, may overlap."""
    spark = docs.sparkSession
    bounded_batches(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one number
    bins = max(8, math.ceil(total * (1 + 2 * (length - 1) / (length - gram + 2)) / bin_bytes))
    parts = min(bins, most_parts)
    fine = math.ceil(bins / parts)
    sent = docs.where(F.octet_length("text") >= length).select("_doc", "_sub", text_bytes().alias("text"))
    rows = sent.mapInArrow(_shards(length, gram, parts), "bin int, blob binary")
    placed = rows.repartitionById(parts, F.pmod(F.col("bin"), F.lit(parts)))  # by hash some tasks would get several partitions
    if fine > 1:
        placed = placed.mapInArrow(_split(gram, parts, fine, 2 * bin_bytes), "bin int, blob binary")
    found = checkpointed(placed.sortWithinPartitions("bin").mapInArrow(_bins(length, gram, bin_bytes), "doc long, sub long, span long, window binary"))
    spans, hot = found.where("window is null").select("doc", "sub", "span"), found.where("window is not null")
    if hot.limit(1).count():
        spans = spans.union(later_windows(hot))
    return spans.groupBy(F.col("doc").alias("_doc"), F.col("sub").alias("_sub")).agg(F.collect_list("span").alias("spans"))


def later_windows(windows: DataFrame) -> DataFrame:
    """(doc, sub, span) of the windows whose text occurs in another one that starts earlier. A text that very many have is broadcast, and its windows stay where they are."""
    place = F.struct("doc", "sub", "span")
    first = checkpointed(windows.groupBy("window").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1"))
    total = windows.count()  # one number
    return with_owner(windows.select("window", "doc", "sub", "span"), first, "window", total).where(place != F.col("first")).select("doc", "sub", "span")


def _compressed(docs: DataFrame) -> DataFrame:
    """doc_id, _doc, _sub and the text's bytes compressed one by one, which halves what a shuffle writes of them."""

    def run(batches):
        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([c.compress(t) for t in b.column(3).to_pylist()], pa.binary())], ["doc_id", "_doc", "_sub", "text"])

    columns = docs.select("doc_id", "_doc", "_sub", text_bytes().alias("text"))
    return columns.mapInArrow(run, columns.schema)


def _cuts(spans: np.ndarray | None, text: bytes) -> list[tuple[int, int]]:
    """Packed spans of one document as disjoint runs in order."""
    if spans is None or not len(spans):
        return []
    s = np.sort(spans)
    lo, hi = s >> 32, np.maximum.accumulate(s & 0xFFFFFFFF)
    fresh = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return list(zip(lo[fresh].tolist(), hi[np.append(fresh[1:], len(s)) - 1].tolist(), strict=True))


def _inward(cuts: list[tuple[int, int]], text: bytes) -> list[tuple[int, int]]:
    """The runs without the bytes of characters that they would split."""
    out = []
    for lo, hi in cuts:
        while lo < hi and text[lo] & 0xC0 == 0x80:
            lo += 1
        while lo < hi < len(text) and text[hi] & 0xC0 == 0x80:
            hi -= 1
        if lo < hi:
            out.append((lo, hi))
    return out


def _kept(text: bytes, cuts: list[tuple[int, int]]) -> bytes:
    if not cuts:
        return text
    ends = [0, *(hi for _, hi in cuts)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(lo for lo, _ in cuts), len(text)], strict=True))


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False, **sizes) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep_text also spans (pairs of byte offsets) and kept (bytes).

    A byte goes if a string of `length` bytes that covers it also starts earlier, in a document of smaller doc_id or
    further ahead in the same. Matches never cross documents; overlaps count; strings are judged on the input. Null text is
    empty; texts shorter than `length` lose nothing; null ids come last; rows that share an id but not the text are ordered by
    a hash of their text, and rows alike in both are one document: each gets that document's result. An empty table gives
    no rows. Other columns are not read.
    """
    docs = keyed(docs.select("doc_id", "text"))
    spans = repeated_spans(docs, length, gram, **sizes)
    joined = _compressed(docs).join(spans, ["_doc", "_sub"], "left")

    def run(batches):
        for b in batches:
            rows = []
            lists = b.column(2)
            flat, off, null = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy(), lists.is_null().to_pylist()
            for i, text in enumerate(map(zstandard.decompress, b.column(1).to_pylist())):
                cuts = [] if null[i] else _cuts(flat[off[i] : off[i + 1]], text)
                kept = _kept(text, cuts)
                rows.append((len(text), len(text) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), cuts, kept))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            n = 6 if keep_text else 4
            arrays = [pa.array([list(map(list, x)) for x in c] if k == 4 else list(c), kinds[k]) for k, c in enumerate(cols[:n])]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], ["doc_id", *names[:n]])

    more = [("spans", T.ArrayType(T.ArrayType(T.LongType()))), ("kept", T.BinaryType())] if keep_text else []
    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, k) for n, k in [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()), *more])])
    return joined.select("doc_id", "text", "spans").mapInArrow(run, kind)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents with repeated passages cut out of `text` (whole characters only) and `n_chars` counted anew, in all their columns.

    A document of which nothing is left goes; one that was empty before stays, and a null text stays null. Documents are ordered as
    `substring_dedup` orders them, null ids last; rows alike in id and text keep the same text. An empty table gives no rows.
    """
    columns = docs.columns
    keys = keyed(docs.select(F.struct(*columns).alias("row"), "doc_id", "text"))
    joined = keys.join(repeated_spans(keys, length, gram), ["_doc", "_sub"], "left")

    def cut(batches):
        for b in batches:
            texts, out = b.column(1).to_pylist(), []
            for text, spans in zip(texts, b.column(2).to_pylist(), strict=True):
                if not spans or text is None:
                    out.append(text)
                    continue
                raw = text.encode()
                out.append(_kept(raw, _inward(_cuts(np.array(spans, np.int64), raw), raw)).decode())
            gone = pa.array([t == "" and s != "" for t, s in zip(out, texts, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, b.schema.field(1).type), gone], ["row", "text", "gone"])

    kind = T.StructType([keys.schema["row"], T.StructField("text", T.StringType()), T.StructField("gone", T.BooleanType())])
    left = joined.select("row", "text", "spans").mapInArrow(cut, kind).where("not gone")
    return with_text(left, docs, F.col("text"))
