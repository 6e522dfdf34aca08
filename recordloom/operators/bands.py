"""Boxes of pages that are rows: which of a page's boxes meet in a band of height, found in numpy for all pages of an Arrow batch at once.

The functions take a page's boxes as arrays, one for each measure, and give an array beside them, so the page stays where it is. Boxes are sorted by height once; a
box looks only at those in its band, and pairs are made PAIRS at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs of boxes that are held at once.
PAIRS = 1 << 20
#: More than any rounding of a band's edges; what is found is tested exactly.
SLACK = 1.0


def _udf(run, kind: T.DataType):
    """Keeps a projection of its own: merged into a higher-order function it could not be run."""
    return F.arrow_udf(run, kind).asNondeterministic()


def starts(lists: pa.Array) -> np.ndarray:
    """Where each list of an array begins among all values, and the end."""
    return np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _flat(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _numbers(*lists: pa.Array) -> list[np.ndarray]:
    return [_flat(x).astype(np.float64) for x in lists]


def pairs(page: np.ndarray, at: np.ndarray, asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b): for each box asked the boxes of its page whose `at` lies in [low, high], and maybe a few more; all of one box come together."""
    if not len(asked):
        return
    base = at - at.min()
    span = max(base.max(), (high - at.min()).max()) - min(0.0, (low - at.min()).min()) + 4 * SLACK
    key = page * span + base
    order = np.argsort(key, kind="stable")
    key, first = key[order], np.searchsorted(page, page[asked], "left")
    last = np.searchsorted(page, page[asked], "right")
    place = page[asked] * span - at.min()
    lo = np.maximum(np.searchsorted(key, place + low - SLACK, "left"), first)  # boxes come page by page, in any order as in this one
    n = np.maximum(np.minimum(np.searchsorted(key, place + high + SLACK, "right"), last) - lo, 0)
    ends, a = np.cumsum(n), 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        m = n[a:b]
        yield np.repeat(asked[a:b], m), order[np.repeat(lo[a:b] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
        a = b


def _pages(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = starts(lists)
    return off, np.repeat(np.arange(len(off) - 1), np.diff(off))


def _listed(off: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), values)


def any_beside(least: float, most: float | None):
    """Whether another box stands right of each box, in its row (a unit up or down), `least` to `most` units away: (left, right, cy, unit)."""
    flags = any_beside_flags(least, most)
    return _udf(lambda left, right, cy, unit: _listed(starts(left), pa.array(flags(left, right, cy, unit))), T.ArrayType(T.BooleanType()))


def any_beside_flags(least: float, most: float | None):
    """`any_beside` of pages' arrays, flat."""

    def run(left: pa.Array, right: pa.Array, cy: pa.Array, unit: pa.Array) -> np.ndarray:
        off, page = _pages(left)
        x1, x2, y, u = _numbers(left, right, cy, unit)
        found = np.zeros(len(y), bool)
        for a, b in pairs(page, y, np.arange(len(y)), y - u, y + u):
            gap = x1[b] - x2[a]
            ok = (a != b) & (np.abs(y[a] - y[b]) <= u[a]) & (gap >= least * u[a])
            found[a[ok if most is None else ok & (gap <= most * u[a])]] = True
        return found

    return run


def _nested(off: np.ndarray, who: list[np.ndarray], what: list[np.ndarray]) -> pa.Array:
    """For each box the places, in its page, of those found for it."""
    a, b = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (who, what))
    inner = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=off[-1]))])
    place = b - off[np.searchsorted(off, b, "right") - 1]
    return _listed(off, _listed(inner, pa.array(place.astype(np.int32))))


def _until_label(a: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of the pairs, sorted by a, come before the first one that stops."""
    n = np.cumsum(stop)
    first = np.searchsorted(a, a, "left")
    return n - (n[first] - stop[first]) == 0


def _measures(is_label, seg_id, *lists):
    off, page = _pages(is_label)
    return off, page, _flat(is_label).astype(bool), _numbers(seg_id)[0], _numbers(*lists)


def beside_lists(aside: float, most: float):
    """For each label the places of what stands right of it in its row, from left to right, up to the next label: (is_label, seg_id, left, right, top, cy, unit)."""

    def run(is_label: pa.Array, seg_id: pa.Array, left: pa.Array, right: pa.Array, top: pa.Array, cy: pa.Array, unit: pa.Array) -> pa.Array:
        off, page, label, ids, (x1, x2, t, y, u) = _measures(is_label, seg_id, left, right, top, cy, unit)
        asked, who, what = np.flatnonzero(label), [], []
        for a, b in pairs(page, y, asked, (y - aside * u)[asked], (y + aside * u)[asked]):
            gap = x1[b] - x2[a]
            ok = (a != b) & (np.abs(y[b] - y[a]) <= aside * u[a]) & (gap >= 0) & (gap <= most * u[a])
            a, b = a[ok], b[ok]
            order = np.lexsort((ids[b], t[b], x1[b], a))
            a, b = a[order], b[order]
            free = _until_label(a, label[b].astype(np.int64)) if len(a) else np.zeros(0, bool)
            who.append(a[free])
            what.append(b[free])
        return _nested(off, who, what)

    return run


def under_lists(below: float, aside: float):
    """For each label the places of what stands within `below` units under it, row by row, up to the next label: (is_label, seg_id, left, top, bottom, cy, unit)."""

    def run(is_label: pa.Array, seg_id: pa.Array, left: pa.Array, top: pa.Array, bottom: pa.Array, cy: pa.Array, unit: pa.Array) -> pa.Array:
        off, page, label, ids, (x1, t, low, y, u) = _measures(is_label, seg_id, left, top, bottom, cy, unit)
        asked, who, what = np.flatnonzero(label), [], []
        for a, b in pairs(page, y, asked, low[asked], (low + below * u)[asked]):
            ok = (a != b) & (y[b] >= low[a]) & (y[b] <= low[a] + below * u[a]) & (np.abs(x1[b] - x1[a]) <= aside * u[a])
            a, b = a[ok], b[ok]
            order = np.lexsort((ids[b], x1[b], t[b], a))
            a, b = a[order], b[order]
            free = _until_label(a, label[b].astype(np.int64)) if len(a) else np.zeros(0, bool)
            who.append(a[free])
            what.append(b[free])
        return _nested(off, who, what)

    return run


def continued_lists(far: float, aside: float):
    """For each label with values the places of what goes on with them, by (top, left, text): (values, is_label, text, left, top, bottom, cy, unit).

    Below the values, above the next label, which is no nearer than `far` units. values: the places that `beside_lists` or `under_lists` give.
    """

    def run(values: pa.Array, is_label: pa.Array, text: pa.Array, left: pa.Array, top: pa.Array, bottom: pa.Array, cy: pa.Array, unit: pa.Array) -> pa.Array:
        off, page = _pages(is_label)
        label, words = _flat(is_label).astype(bool), text.flatten().to_pylist()
        x1, t, low, y, u = _numbers(left, top, bottom, cy, unit)
        inner = values.flatten()
        cut = starts(inner)
        held, place = np.repeat(np.arange(len(y)), np.diff(cut)), inner.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        place = place + off[page[held]]
        floor, anchor = np.full(len(y), -np.inf), np.full(len(y), np.inf)
        np.maximum.at(floor, held, low[place])
        np.minimum.at(anchor, held, x1[place])
        limit = np.full(len(y), np.inf)
        labels = np.flatnonzero(label)
        if len(labels):  # the first label that begins below each
            span = max(t.max(), low.max()) - min(t.min(), low.min()) + 4 * SLACK
            by = labels[np.lexsort((t[labels], page[labels]))]
            begins = (t[by] - min(t.min(), low.min())) + page[by] * span
            after = np.searchsorted(begins, (low - min(t.min(), low.min())) + page * span, "right")
            there = after < len(by)
            there[there] = page[by[after[there]]] == page[there]
            limit[there] = t[by[after[there]]]
        asked = np.flatnonzero((np.diff(cut) > 0) & (np.isinf(limit) | (limit - low > far * u)))
        bottom_of = np.maximum.reduceat(y, off[:-1][np.diff(off) > 0]) if len(y) else np.zeros(0)
        most = np.zeros(len(off) - 1)
        most[np.diff(off) > 0] = bottom_of
        who, what = [], []
        for a, b in pairs(page, y, asked, floor[asked], np.maximum(floor[asked], np.minimum(limit[asked], most[page[asked]]))):
            ok = ~label[b] & (y[b] > floor[a]) & (low[b] <= limit[a]) & (x1[b] >= anchor[a] - aside * u[a])
            a, b = a[ok], b[ok]
            order = sorted(range(len(a)), key=lambda i: (a[i], t[b[i]], x1[b[i]], (words[b[i]] or "").encode()))
            who.append(a[order])
            what.append(b[order])
        return _nested(off, who, what)

    return run


def first_of_each_spot(share: float):
    """Whether each box shares no more than `share` of the smaller area with one that was kept before it: (left, top, width, height)."""

    def run(left: pa.Array, top: pa.Array, width: pa.Array, height: pa.Array) -> pa.Array:
        off = starts(left)
        x, y, w, h = _numbers(left, top, width, height)
        x2, y2, area, keep = x + w, y + h, w * h, np.ones(len(x), bool)
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            n = b - a
            block = max(1, PAIRS // max(n, 1))
            for i in range(a, b, block):  # a stretch of the page's boxes against all before its end
                p, q = slice(i, min(i + block, b)), slice(a, min(i + block, b))
                both = np.clip(np.minimum(x2[p, None], x2[q]) - np.maximum(x[p, None], x[q]), 0, None) * np.clip(np.minimum(y2[p, None], y2[q]) - np.maximum(y[p, None], y[q]), 0, None)
                hit = both > share * np.maximum(1, np.minimum(area[p, None], area[q]))
                for k in np.flatnonzero(np.tril(hit, i - a - 1).any(axis=1)).tolist():
                    keep[i + k] = not (hit[k, : i + k - a] & keep[a : i + k]).any()
        return _listed(off, pa.array(keep))

    return _udf(run, T.ArrayType(T.BooleanType()))


def _shares(counts: np.ndarray) -> np.ndarray:
    """`zones.ink_share` of each row of counts."""
    dark, mass = np.cumsum(counts, axis=1), np.cumsum(counts * np.arange(counts.shape[1]), axis=1)
    total, whole = dark[:, -1:], mass[:, -1:]
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = mass / dark - (whole - mass) / (total - dark)
        apart = np.where((dark != 0) & (total != dark), dark * (total - dark) * gap * gap, -1.0)
        best, row = apart.argmax(axis=1), np.arange(len(counts))
        share = np.where(apart[row, best] > 0, dark[row, best], 0.0) / total[:, 0]
    return np.nan_to_num(share, nan=0.0, posinf=0.0, neginf=0.0)


def ink_shares():
    """`zones.ink_share` of a column of counts, for all rows of an Arrow batch at once: (levels). Rows without counts, or with a null among them, have no ink."""

    def run(levels: pa.Array) -> pa.Array:
        off = starts(levels)
        n = np.diff(off)
        counts, place = np.zeros((len(n), max(int(n.max(initial=0)), 1))), np.arange(off[-1]) - np.repeat(off[:-1], n)
        counts[np.repeat(np.arange(len(n)), n), place] = _numbers(levels)[0]
        return pa.array(_shares(counts))

    return _udf(run, T.DoubleType())


def added_ink_shares(greys: int = 256):
    """`zones.ink_share` of the added counts of a row's crops: (levels: an array of counts a crop). Nulls count 0; with a crop that is null or has more than `greys` there is no ink.

    Rows are added PAIRS / `greys` at a time.
    """

    def run(crops: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for a in range(0, len(crops), PAIRS // greys):
            part = crops.slice(a, PAIRS // greys)
            off, levels = starts(part), part.flatten()
            cut, crop_of = starts(levels), np.repeat(np.arange(len(part)), np.diff(off))
            n = np.diff(cut)
            void = levels.is_null().to_numpy(zero_copy_only=False) | (n > greys)
            row, grey = np.repeat(crop_of, n), np.arange(cut[-1]) - np.repeat(cut[:-1], n)
            here = grey < greys
            values = levels.flatten().fill_null(0).to_numpy(zero_copy_only=False)
            counts = np.bincount(row[here] * greys + grey[here], weights=values[here], minlength=len(part) * greys).reshape(len(part), greys)
            counts[crop_of[void]] = 0
            out.append(_shares(counts))
        return pa.array(np.concatenate(out))

    return _udf(run, T.DoubleType())
