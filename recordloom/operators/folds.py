"""Folds over the boxes of pages, for all pages of an Arrow batch at once in numpy: rows, phrases, merged rows, crowds, codes with ticks, labels with their values.

A batch is `off`, where each page's boxes begin and end, and flat arrays of the boxes' measures. What a fold does to one box after the other it does here to the first box of all
pages, then to the second of all, and so on; texts are looked at once for all boxes that say the same. Pages of like size are taken together, as many as keep the cells of a
step bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from recordloom.functions.text import WHITE
from recordloom.operators import bands

#: Cells (boxes, or pairs of boxes) of pages that are held at once.
CELLS = 1 << 20

def pages_of(off: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def floats(*lists: pa.Array) -> list[np.ndarray]:
    """Flat values as doubles, null as NaN."""
    return [np.asarray(x.to_numpy(zero_copy_only=False), np.float64) for x in lists]


def once(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(of, different): the different texts, null as empty, and which of them each text is."""
    d = texts.fill_null("").dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def nonblank(texts: pa.Array) -> np.ndarray:
    of, words = once(texts)
    return pc.not_equal(pc.utf8_trim(words, characters=WHITE), "").to_numpy(zero_copy_only=False)[of]


def taken(values: pa.Array, at: np.ndarray) -> pa.Array:
    return values.take(pa.array(at))


def lists(off: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.asarray(off, np.int32)), values)


def ends(n: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def nth(sorted_groups: np.ndarray) -> np.ndarray:
    """The place of each row within its group; equal groups are next to each other."""
    if not len(sorted_groups):
        return np.zeros(0, np.int64)
    fresh = np.r_[True, sorted_groups[1:] != sorted_groups[:-1]]
    at = np.arange(len(fresh))
    return at - np.maximum.accumulate(np.where(fresh, at, 0))


def units(off: np.ndarray, height: np.ndarray, default: float = 15.0) -> np.ndarray:
    """`tables.unit` of each page: the upper median of the heights above zero."""
    page = pages_of(off)
    up = np.flatnonzero(height > 0)
    up = up[np.lexsort((height[up], page[up]))]
    n = np.bincount(page[up], minlength=len(off) - 1)
    out = np.full(len(n), default)
    out[n > 0] = height[up[(ends(n)[:-1] + n // 2)[n > 0]]]
    return out


def blocks(off: np.ndarray, cells: Callable[[int], int], least: int = 1) -> Iterator[tuple[np.ndarray, int]]:
    """(pages, width): pages with `least` boxes or more, from the smaller to the larger, of like size: as many as have CELLS cells, of cells(width) each, one at least."""
    n = np.diff(off)
    order = np.argsort(n, kind="stable")
    order = order[np.searchsorted(n[order], least) :]
    s, a = n[order], 0
    while a < len(order):
        z = int(np.searchsorted(s, s[a] + max(8, s[a] // 4), "right"))
        z = min(z, a + max(1, CELLS // cells(int(s[z - 1]))))
        yield order[a:z], int(s[z - 1])
        a = z


def _grid(off: np.ndarray, pages: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(at, there): the boxes of pages side by side, and whether there is one."""
    there = np.arange(width) < np.diff(off)[pages][:, None]
    return np.where(there, off[pages][:, None] + np.arange(width), 0), there


def steps(off: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """(pages, first, place): one place after the other of pages of like size; pages from `first` on have it."""
    for pages, width in blocks(off, lambda w: 1):
        n = np.diff(off)[pages]
        for j, first in enumerate(np.searchsorted(n, np.arange(width), "right").tolist()):
            yield pages, first, j


def row_numbers(off: np.ndarray, cy: np.ndarray, unit: np.ndarray, band: float) -> np.ndarray:
    """The number of each box's row: by centre, a row ends where one is more than `band` units from the row's first."""
    order, no = np.lexsort((cy, pages_of(off))), np.zeros(len(cy), np.int64)
    c, limit, found = cy[order], band * unit[order], np.zeros(len(cy), np.int64)
    for pages, first, j in steps(off):
        if j == 0:
            anchor, k = np.full(len(pages), np.nan), np.full(len(pages), -1)
        at = off[pages[first:]] + j
        fresh = ~(np.abs(c[at] - anchor[first:]) <= limit[at])
        k[first:] += fresh
        anchor[first:] = np.where(fresh, c[at], anchor[first:])
        found[at] = k[first:]
    no[order] = found
    return no


def phrases(off: np.ndarray, line: np.ndarray, box: list[np.ndarray], ratio: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """(opens, box): which of the words, sorted by page, line and place, open a phrase, and x1, y1, x2, y2 and confidence of the phrases they open.

    A word joins the open phrase of its line if the gap is at most `ratio` times the higher of the two.
    """
    x1, y1, x2, y2, conf = box
    opens, grown = np.ones(len(x1), bool), [x.copy() for x in box]
    for pages, first, j in steps(off):
        if j == 0:
            opened = off[pages].copy()
            now = [x[opened] for x in box]
            continue
        at = off[pages[first:]] + j
        n = [x[first:] for x in now]
        near = (line[at] == line[at - 1]) & (x1[at] - n[2] <= ratio * np.fmax(n[3] - n[1], y2[at] - y1[at]))
        opens[at] = ~near
        opened[first:] = np.where(near, opened[first:], at)
        for x, part, f, g in zip(n, box, (np.fmin, np.fmin, np.fmax, np.fmax, np.fmin), grown, strict=True):
            x[:] = np.where(near, f(x, part[at]), part[at])
            g[opened[first:]] = x
    return opens, [g[opens] for g in grown]


def merged(off: np.ndarray, box: list[np.ndarray], overlap: float, ratio: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(order, parts, box): phrases merged while two of a page are close and overlap in height; the first pair first, the left one's text first.

    `order` has the phrases, those that became one next to each other; `parts` how many each has.
    """
    x1, y1, x2, y2, conf = (x.copy() for x in box)
    n = len(x1)
    after, head, tail, alive = np.full(n, -1), np.arange(n), np.arange(n), np.ones(n, bool)

    def joins(a, b):  # a comes before b
        (ax, ay, az, aw), (bx, by, bz, bw) = a, b
        first = ax <= bx
        gap = np.where(first, bx - az, ax - bz)
        one, other = aw - ay, bw - by
        return (gap >= 0) & (gap <= ratio * np.maximum(one, other)) & (np.minimum(aw, bw) - np.maximum(ay, by) >= overlap * np.minimum(one, other)) & (one >= 0) & (other >= 0)

    for pages, width in blocks(off, lambda w: w * w, 2):
        at, there = _grid(off, pages, width)
        p = [x[at] for x in (x1, y1, x2, y2)]
        found = joins([x[:, :, None] for x in p], [x[:, None, :] for x in p]) & there[:, :, None] & there[:, None, :] & (np.arange(width)[:, None] < np.arange(width))
        todo = np.flatnonzero(found.any(axis=(1, 2)))
        while len(todo):
            ij = found[todo].reshape(len(todo), -1).argmax(axis=1)
            i, j = ij // width, ij % width
            a, b = at[todo, i], at[todo, j]
            left, right = np.where(x1[a] <= x1[b], a, b), np.where(x1[a] <= x1[b], b, a)
            after[tail[left]] = head[right]
            head[a], tail[a] = head[left], tail[right]
            x1[a], y1[a], x2[a], y2[a], conf[a] = np.minimum(x1[a], x1[b]), np.minimum(y1[a], y1[b]), np.maximum(x2[a], x2[b]), np.maximum(y2[a], y2[b]), np.minimum(conf[a], conf[b])
            alive[b] = False
            there[todo, j] = False
            for x, y in zip(p, (x1, y1, x2, y2), strict=True):
                x[todo, i] = y[a]
            rows, one = [x[todo] for x in p], [x[todo, i][:, None] for x in p]
            free = there[todo]
            found[todo, :, i] = joins(rows, one) & free & (np.arange(width) < i[:, None])
            found[todo, i, :] = joins(one, rows) & free & (np.arange(width) > i[:, None])
            found[todo, :, j] = False
            found[todo, j, :] = False
            todo = todo[found[todo].any(axis=(1, 2))]
    kept = np.flatnonzero(alive)
    spots, who, now, k = [], [], head[kept], np.arange(len(kept))
    while len(now):
        spots.append(now)
        who.append(k)
        now = after[now]
        k, now = k[now >= 0], now[now >= 0]
    whose = np.concatenate([*who, np.zeros(0, np.int64)])
    order = np.concatenate([*spots, np.zeros(0, np.int64)])[np.argsort(whose, kind="stable")]
    return order, np.bincount(whose, minlength=len(kept)), [kept, *[x[kept] for x in (x1, y1, x2, y2, conf)]]


def crowds(off: np.ndarray, cx: np.ndarray, cy: np.ndarray, free: np.ndarray, half: np.ndarray, least: int) -> np.ndarray:
    """The number of the crowd that each box is in, or -1: the densest boxes of a page, up to `half` from a box each way, one after the other; the first seed on ties. half: of each page."""
    crowd = np.full(len(cx), -1)
    for pages, width in blocks(off, lambda w: w * w, least):
        at, there = _grid(off, pages, width)
        alive = there & free[at]
        some = alive.sum(axis=1) >= least
        at, alive, h = at[some], alive[some], half[pages[some]][:, None, None]
        x, y = cx[at], cy[at]
        near = (np.abs(x[:, :, None] - x[:, None, :]) <= h) & (np.abs(y[:, :, None] - y[:, None, :]) <= h) & alive[:, :, None] & alive[:, None, :]
        count = near.sum(axis=2, dtype=np.int32)
        todo, k = np.arange(len(at)), 0
        while len(todo):
            best = count[todo].argmax(axis=1)
            ok = count[todo, best] >= least
            todo, best = todo[ok], best[ok]
            if not len(todo):
                break
            group = near[todo, best] & alive[todo]
            p, member = np.nonzero(group)
            crowd[at[todo[p], member]] = k
            alive[todo] &= ~group
            gone = np.add.reduceat(near[todo[p], member], ends(group.sum(axis=1))[:-1], axis=0, dtype=np.int32)
            count[todo] = (count[todo] - gone) * alive[todo]
            k += 1
    return crowd


def code_rows(page: np.ndarray, row: np.ndarray, cx: np.ndarray, cy: np.ndarray, width: np.ndarray, unit: np.ndarray, code: np.ndarray, tick: np.ndarray, least: int, rows: float, aside: float):
    """(first, start, codes, chosen, tick): rows of boxes, in reading order, with `least` codes or more: the first code, where in `codes` the row's begin and end, the box ticked and its tick, or -1.

    The first tick counts that is within `rows` units of the row and no farther from its nearest code than `aside` units and that code's width.
    """
    c = np.flatnonzero(code)
    c = c[np.lexsort((row[c], page[c]))]
    if len(c):
        fresh = np.flatnonzero(np.r_[True, (page[c][1:] != page[c][:-1]) | (row[c][1:] != row[c][:-1])])
        n = np.diff(np.r_[fresh, len(c)])
        c, n = c[np.repeat(n >= least, n)], n[n >= least]
    start = ends(n) if len(c) else np.zeros(1, np.int64)
    first = c[start[:-1]]
    chosen, used = np.full(len(first), -1), np.full(len(first), -1)
    t = np.flatnonzero(tick)
    if not len(first) or not len(t):
        return first, start, c, chosen, used
    of = np.repeat(np.arange(len(first)), np.diff(start))
    by = np.lexsort((c, cx[c], of))  # a row's codes from left to right
    line, place = of[by], cx[c[by]]
    same = np.r_[True, (line[1:] != line[:-1]) | (place[1:] != place[:-1])]
    leftmost = np.maximum.accumulate(np.where(same, np.arange(len(by)), 0))
    low = min(place.min(), cx[t].min())
    span = max(place.max(), cx[t].max()) - low + 4 * bands.SLACK
    key = line * span + (place - low)
    both = np.r_[t, first]
    order = np.argsort(page[both], kind="stable")
    asked = np.empty(len(both), np.int64)
    asked[order] = np.arange(len(both))
    asked, spots = asked[len(t) :], both[order]
    is_tick = order < len(t)
    reach = rows * unit[first]
    row_of = np.full(len(both), -1)
    row_of[asked] = np.arange(len(first))
    for a, b in bands.pairs(page[spots], cy[spots], asked, cy[first] - reach, cy[first] + reach):
        a, b = a[is_tick[b]], b[is_tick[b]]
        r, k = row_of[a], spots[b]
        ok = np.abs(cy[k] - cy[first[r]]) <= reach[r]
        r, k = r[ok], k[ok]
        at = np.searchsorted(key, r * span + (cx[k] - low), "left")
        right, left = np.minimum(at, len(by) - 1), np.maximum(at - 1, 0)
        right_ok, left_ok = (at < len(by)) & (line[right] == r), (at > 0) & (line[left] == r)
        left = leftmost[left]
        far = [np.where(ok, np.abs(place[i] - cx[k]), np.inf) for i, ok in ((left, left_ok), (right, right_ok))]
        near = c[by[np.where((far[0] < far[1]) | ((far[0] == far[1]) & (c[by[left]] < c[by[right]])), left, right)]]
        ok = np.abs(cx[near] - cx[k]) <= aside * unit[first[r]] + width[near]
        r, k, near = r[ok], k[ok], near[ok]
        i = np.lexsort((k, r))[::-1]  # a row's first tick is written last
        chosen[r[i]], used[r[i]] = near[i], k[i]
    return first, start, c, chosen, used


def label_places(off: np.ndarray, m: dict[str, np.ndarray], unit: np.ndarray, free: np.ndarray, named: np.ndarray, same_row: float, most: float, below: float, aside: float, far: float):
    """(label, box): the boxes that each label takes, in their order, one label of each page after the other; what is taken is not taken again.

    m: left, right, top, bottom, cy of the boxes, a page's in reading order. unit: of each page. free: what is not taken yet, and is marked here. named: the labels.
    """
    who, what, late, spot = [], [], [], []
    rank = np.empty(len(free), np.int64)
    order = np.lexsort((m["left"], pages_of(off)))  # ties in reading order
    rank[order] = np.arange(len(order))
    none = np.iinfo(np.int64).max
    for pages, width in blocks(off, lambda w: w):
        at, there = _grid(off, pages, width)
        is_label = named[at] & there
        p, place = np.nonzero(is_label)
        if not len(p):
            continue
        turn = nth(p)
        by = np.argsort(turn, kind="stable")
        cut = np.r_[np.flatnonzero(np.r_[True, np.diff(turn[by]) > 0]), len(by)]
        left, bottom, cy, top = (m[k][at] for k in ("left", "bottom", "cy", "top"))
        ranks, open_ = rank[at], free[at] & there
        floor_of = np.where(is_label, top, np.inf)
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            q, l = p[by[a:z]], place[by[a:z]]
            open_[q, l] = False
            box = at[q, l]
            u = unit[pages[q]][:, None]
            pick = (lambda v: v) if len(q) == len(pages) else (lambda v, q=q: v[q])  # in most steps all pages take part
            low, label = m["bottom"][box][:, None], pick(is_label)
            can, x, y, r = (pick(v) for v in (open_, left, cy, ranks))
            gap = x - m["right"][box][:, None]
            ok = can & (np.abs(y - m["cy"][box][:, None]) <= same_row * u) & (gap >= 0) & (gap <= most * u)
            got = ok & (r < np.where(ok & label, r, none).min(axis=1)[:, None])
            under = np.flatnonzero(~got.any(axis=1))
            if len(under):
                s, yu, lu = under, y[under], low[under]
                ok = can[s] & (yu >= lu) & (yu <= lu + below * u[s]) & (np.abs(x[s] - m["left"][box[s]][:, None]) <= aside * u[s])
                i = at[q[s]]
                got[s] = ok & (i < np.where(ok & label[s], i, none).min(axis=1)[:, None])
            has = np.flatnonzero(got.any(axis=1))
            tops = floor_of[q[has]]
            limit = np.where(tops > low[has], tops, np.inf).min(axis=1)[:, None]
            on = has[(limit - low[has] > far * u[has])[:, 0]]
            limit = limit[(limit - low[has] > far * u[has])[:, 0]]
            if len(on):
                g = got[on]
                anchor = np.where(g, x[on], np.inf).min(axis=1)[:, None]
                floor = np.where(g, bottom[q[on]], -np.inf).max(axis=1)[:, None]
                more = can[on] & ~label[on] & (y[on] > floor) & (bottom[q[on]] <= limit) & (x[on] >= anchor - aside * u[on]) & ~g
                i, j = np.nonzero(more)
                if len(i):
                    who.append(box[on[i]])
                    what.append(at[q[on[i]], j])
                    late.append(np.ones(len(i)))
                    spot.append(what[-1])
                    open_[q[on[i]], j] = False
            i, j = np.nonzero(got)
            who.append(box[i])
            what.append(at[q[i], j])
            late.append(np.zeros(len(i)))
            below_it = np.zeros(len(q), bool)
            below_it[under] = True
            spot.append(np.where(below_it[i], what[-1], rank[what[-1]]))  # what stands beside comes from left to right, the rest in reading order
            open_[q[i], j] = False
        free[at[there]] = open_[there]
    label, box, more, order = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (who, what, late, spot))
    by = np.lexsort((order, more, label))
    return label[by], box[by]
