"""Edit-aware token counts.

A document is cut into pre-tokens by the tokenizer's own pattern. Leaves of LEAF pre-tokens carry their texts' length and number
of tokens, and a segment tree over the leaves holds the sums. An edit replaces a range of characters: the tree finds the
leaves it touches by character sums, their text is edited and cut anew together with boundary context, and the leaves are
exchanged until a new boundary falls on an old one, from where on pre-tokens are what they were. Edits that touch the same
leaves are made together, so a leaf is encoded once however many edits it has. Only the exchanged leaves are encoded, and only the
sums above them change.

Context: a pre-token is settled by its own characters and at most one character after it, but for runs of white space,
whose end gives its last blank to the next word; and the pattern looks nowhere behind. So it is enough to cut from the leaf
before the edit and to go on until a boundary behind the edit meets an old one outside white space.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.llm.common import bounded_batches

#: Where the public vocabulary files lie, and the one that is used.
VOCABULARIES, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that this vocabulary's pre-tokens follow.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 64
CUT = regex.compile(PATTERN)


class Encoder:
    """Counts of tokens of pre-tokens; those of short ones are remembered, a bounded number of them."""

    def __init__(self, folder: str, name: str, most: int = 400_000):
        import tiktoken

        with open(f"{folder}/{name}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}
        self.most, self.encoded = most, 0

    def counts(self, words: list[str]) -> list[int]:
        known, out = self.known, []
        self.encoded += len(words)
        for w in words:
            n = known.get(w)
            if n is None:
                n = len(self.bpe.encode_ordinary(w))
                if len(w) <= 32:
                    if len(known) >= self.most:
                        known.clear()
                    known[w] = n
            out.append(n)
        return out


@lru_cache(maxsize=2)
def encoder(folder: str = VOCABULARIES, name: str = VOCABULARY) -> Encoder:
    return Encoder(folder, name)


class Tree:
    """The pre-tokens of one text in leaves, with a segment tree of (characters, tokens) over them."""

    def __init__(self, text: str, enc: Encoder):
        self.enc = enc
        words = CUT.findall(text)
        self.leaves = [words[i : i + LEAF] for i in range(0, len(words), LEAF)]
        self._build([(sum(map(len, leaf)), sum(enc.counts(leaf))) for leaf in self.leaves])

    def _build(self, sums: list[tuple[int, int]] | np.ndarray) -> None:
        self.width = 1 << max(0, len(sums) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        if len(sums):
            self.sums[self.width : self.width + len(sums)] = sums
        at = self.width
        while at > 1:
            level = self.sums[at : 2 * at]
            at //= 2
            self.sums[at : 2 * at] = level[0::2] + level[1::2]

    @property
    def n_chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def n_tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and where that leaf begins; the last leaf for the end of the text."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if char - begin >= self.sums[node, 0] and self.sums[node + 1, 0]:
                begin += int(self.sums[node, 0])
                node += 1
        return node - self.width, begin

    def edit(self, start: int, stop: int, insert: str) -> None:
        """Replace the characters [start, stop) by `insert`."""
        self.edit_all([(start, stop, insert)])

    def edit_all(self, edits: list[tuple[int, int, str]]) -> None:
        """Make disjoint edits (start, stop, insert) in order; places are those of the text before all of them."""
        if not self.leaves:
            if edits:
                self.__init__("".join(insert for _, _, insert in edits), self.enc)
            return
        swaps, k = [], 0
        while k < len(edits):
            low, begin = self._context(edits[k])
            resume, keep, k = self._recut(edits, k, low, begin)
            fresh = [keep[i : i + LEAF] for i in range(0, len(keep), LEAF)]
            swaps.append((low, resume, fresh, [(sum(map(len, leaf)), sum(self.enc.counts(leaf))) for leaf in fresh]))
        self._exchange(swaps)

    def _context(self, edit: tuple[int, int, str]) -> tuple[int, int]:
        """The leaf before the one in which an edit begins, and where it begins."""
        leaf, begin = self.find(max(0, edit[0] - 1))
        return (leaf - 1, begin - int(self.sums[self.width + leaf - 1, 0])) if leaf else (leaf, begin)

    def _recut(self, edits: list[tuple[int, int, str]], k: int, low: int, begin: int) -> tuple[int, list[str], int]:
        """From leaf `low`, which begins at `begin`, on: the leaf from which all is as before, the pre-tokens up to it, and the first edit left."""
        upto, high, grow, n = k, -1, 1, len(self.leaves)
        while True:
            while upto < len(edits) and (upto == k or self._context(edits[upto])[0] <= high):
                high = max(high, self.find(edits[upto][1])[0])
                upto += 1
            text = "".join(w for leaf in self.leaves[low : high + 1] for w in leaf)
            pieces, at = [], 0
            for start, stop, insert in edits[k:upto]:
                pieces += [text[at : start - begin], insert]
                at = stop - begin
            new = "".join([*pieces, text[at:]])
            words = CUT.findall(new)
            if high + 1 == n:
                return n, words, upto
            # a leaf border behind the edits where the new cut has a border too, and no blank before it
            borders, place = set(np.cumsum([len(w) for w in words]).tolist()), 0
            for leaf in range(low, high + 1):
                place += int(self.sums[self.width + leaf, 0])
                moved = place + len(new) - len(text)
                if place > at and moved in borders and moved < len(new) and not new[moved - 1].isspace() and (not new[moved].isspace() or (new[moved] == " " and moved + 1 < len(new) and not new[moved + 1].isspace())):
                    size = np.cumsum([len(w) for w in words])
                    return leaf + 1, words[: int(np.searchsorted(size, moved)) + 1], upto
            high = min(n - 1, high + grow)
            grow *= 2

    def _exchange(self, swaps: list[tuple[int, int, list, list]]) -> None:
        """Put new leaves in the place of old ones [low, resume): sums change on the paths above them, or are summed anew where leaves moved."""
        if all(len(fresh) == resume - low for low, resume, fresh, _ in swaps):
            for low, resume, fresh, sums in swaps:
                self.leaves[low:resume] = fresh
                for i, s in enumerate(sums):
                    node = self.width + low + i
                    change = np.array(s) - self.sums[node]
                    while node:
                        self.sums[node] += change
                        node //= 2
            return
        flat, leaves, rows, at = self.sums[self.width : self.width + len(self.leaves)], [], [], 0
        for low, resume, fresh, sums in swaps:
            leaves += [*self.leaves[at:low], *fresh]
            rows += [flat[at:low], np.array(sums, np.int64).reshape(-1, 2)]
            at = resume
        self.leaves = [*leaves, *self.leaves[at:]]
        self._build(np.concatenate([*rows, flat[at:]]))

    def text(self) -> str:
        return "".join(w for leaf in self.leaves for w in leaf)


#: What the standard edits take out: runs of eight digits or more, addresses of mail, runs of three symbols or more.
REDACT = regex.compile(r"[0-9]{8,}|[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+|[^\s\p{L}\p{N}]{3,}")


def standard_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits of a text, in order and disjoint: redactions by a mark, and a line end at the end of a text without one."""
    edits = [(m.start(), m.end(), "<redacted>") for m in REDACT.finditer(text)]
    if text and not text.endswith("\n") and not (edits and edits[-1][1] == len(text)):
        edits.append((len(text), len(text), "\n"))
    return edits


def token_counts(docs: DataFrame, folder: str = VOCABULARIES, name: str = VOCABULARY, edits=standard_edits) -> DataFrame:
    """Per document: doc_id, n_tokens, n_edits, n_tokens_after, n_pretokens, n_reencoded.

    n_tokens counts the whole text's tokens, n_tokens_after those after the document's edits, which `edits` derives from the
    text as (start, stop, insert) in order and disjoint; n_reencoded are the pre-tokens that the edits had encoded again. Null text is
    empty and has none of anything; repeated rows stay; an empty table gives no rows. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        enc = encoder(folder, name)
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                tree = Tree(text or "", enc)
                before, size = tree.n_tokens, sum(map(len, tree.leaves))
                todo, enc.encoded = edits(text or ""), 0
                tree.edit_all(todo)
                rows.append((before, len(todo), tree.n_tokens, size, enc.encoded))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), pa.int64()) for c in cols)], ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_pretokens", "n_reencoded"])

    kind = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_edits", "n_tokens_after", "n_pretokens", "n_reencoded"))])
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, kind)
