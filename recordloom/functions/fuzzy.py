"""Fuzzy ratios of strings, 0 to 100, from their public definition: 200 * (longest common subsequence) / (sum of lengths)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each place of `a`."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of its length on the longer, or a shorter one at its edges."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    windows = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    return max(ratio(short, w) for w in windows)


@lru_cache(maxsize=100_000)
def score(a: str, b: str) -> float:
    """The better of both."""
    return max(token_sort_ratio(a, b), partial_ratio(a, b))


@F.pandas_udf(T.DoubleType())
def fuzzy_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else score(x, y) for x, y in zip(a, b, strict=True)])


def alphabet(synonyms: list[str]) -> str:
    return "".join(sorted({c for s in synonyms for c in s if not c.isspace()}))


def char_counts(text: Column, letters: str) -> Column:
    """How often each letter occurs in a text, in the order of `letters`."""
    return F.array(*[F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in letters])


def solid_length(text: Column) -> Column:
    """The characters of a text that are not blank."""
    return F.length(F.regexp_replace(text, r"(?U)\s+", ""))


def score_bound(size: Column, solid: Column, counts: Column, synonym: str, letters: str) -> Column:
    """C36 from above, without aligning anything.

    A common subsequence has at most the s characters that both texts share, and what it is divided by is at least s plus the letters m
    of the shorter text, as a window at an edge may be no longer than s. size: the text's characters, solid: those that are not blank.
    """
    own = {c: synonym.count(c) for c in letters if c in synonym}
    blanks = sum(c.isspace() for c in synonym)
    shared = sum((F.least(F.get(counts, F.lit(letters.index(c))), F.lit(n)) for c, n in own.items()), F.least(size - solid, F.lit(blanks)))
    least = F.least(solid, F.lit(len(synonym) - blanks))
    s = F.least(shared, least)
    return F.when(least <= 0, 100.0).otherwise(200.0 * s / (least + s))


class Synonyms:
    """A pool of fields with the texts it has seen: which fields a text matches, each with its best score. It goes to the workers whole, so it is small.

    All texts of a call are bounded at once, as in `score_bound`; only pairs that may reach the threshold are aligned. A guard holds for a field if it holds for any of its synonyms.
    """

    KEPT = 50_000

    def __init__(self, pool: dict[str, list[str]], threshold: float, guard: str | None = None):
        self.fields, self.threshold, self.guard, self.seen = list(pool.items()), threshold, guard, {}
        self.flat = [(k, s) for k, (_, ss) in enumerate(self.fields) for s in ss]
        self.letters = alphabet([s for _, s in self.flat])
        self.own = np.array([[s.count(c) for c in self.letters] for _, s in self.flat]).reshape(len(self.flat), len(self.letters))
        self.blanks = np.array([sum(c.isspace() for c in s) for _, s in self.flat])
        self.sizes = np.array([len(s) for _, s in self.flat]) - self.blanks

    def guards(self, text: str, field: int) -> bool:
        """Whether a text starts with a synonym of the field or is half to three times as long as one; without what the guard leaves out."""
        if self.guard is None:
            return True
        solid = self.guard == "solid"
        n = len(re.sub(r"[ \t\n\x0b\f\r]", "", text)) if solid else sum(unicodedata.category(c)[0] in "LN" for c in text)
        size = lambda s: len("".join(s.split())) if solid else sum(c.isalnum() for c in s)
        return any(text.startswith(s) or size(s) * 0.5 <= n <= size(s) * 3 for s in self.fields[field][1])

    def matches(self, texts: list[str]) -> list[list[tuple[int, float]]]:
        """(place of the field, score) of each text's fields whose best synonym scores enough, in the order of the pool."""
        if len(self.seen) > self.KEPT:
            self.seen = {}
        new = [t for t in dict.fromkeys(texts) if t not in self.seen]
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            solid = np.array([len("".join(t.split())) for t in part])
            counts, spare = np.array([[t.count(c) for c in self.letters] for t in part]).reshape(len(part), len(self.letters)), np.array([len(t) for t in part]) - solid
            for t, n, c, b in zip(part, solid, counts, spare, strict=True):
                least = np.minimum(n, self.sizes)
                s = np.minimum(np.minimum(c, self.own).sum(axis=1) + np.minimum(b, self.blanks), least)
                bound = np.where(least <= 0, 100.0, 200.0 * s / np.maximum(least + s, 1))
                best: dict[int, float] = {}
                for j in np.flatnonzero(bound >= self.threshold).tolist():
                    field, synonym = self.flat[j]
                    best[field] = max(best.get(field, 0.0), score(t, synonym))
                self.seen[t] = [(k, x) for k, x in best.items() if x >= self.threshold and self.guards(t, k)]
        return [self.seen[t] for t in texts]
