"""FM-index over integer sequences: suffix array, wavelet matrix, sampled positions.

All searches are vectorised over the queries, so one index answers tens of
thousands of phrases in a few numpy passes.
"""

from __future__ import annotations

import numpy as np

from tallyforge.llm.tokens import ranges


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; after each round only groups with ties are sorted again."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    width = int(s.max()) + 2
    pack = max(1, min(8, int(62 // np.log2(width))))
    key = np.zeros(n, np.int64)
    for i in range(pack):
        key *= width
        key[: max(0, n - i)] += s[i:].astype(np.int64) + 1
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    fresh = np.concatenate(([True], key[order[1:]] != key[order[:-1]]))
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    h = pack
    while True:
        last = np.concatenate((fresh[1:], [True]))
        tied = np.flatnonzero(~(fresh & last))  # rows whose group has more than one suffix
        if not len(tied):
            return order
        at = order[tied]
        second = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        by = np.argsort(rank[at] * (n + 1) + second)
        at, second = at[by], second[by]
        order[tied] = at
        group = rank[at]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])))
        fresh[tied] = new
        rank[at] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        h *= 2


class FMIndex:
    """Backward search and locate over one shard.

    ``s`` holds symbols in ``[0, width)``; 0 is the break between passages and
    never part of a query. Every ``sample``-th text position is kept, as a
    bit vector with ranks; other rows walk back to one by LF steps.
    """

    def __init__(self, s: np.ndarray, width: int, sample: int = 8) -> None:
        s = np.concatenate((s + 1, [0])).astype(np.int64)  # the end sorts before every symbol and occurs once
        width += 1
        self.n, self.sample = len(s), sample
        sa = suffix_array(s)
        bwt = s[sa - 1]
        self.bwt = bwt.astype(np.int32)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=width)))).astype(np.int64)
        kept = sa % sample == 0
        self.kept = kept
        self.kept_rank = np.concatenate(([0], np.cumsum(kept))).astype(np.int32)
        self.kept_at = sa[kept].astype(np.int32)
        self.levels = max(1, int(width - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in reversed(range(self.levels)):
            bit = (bwt >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            bwt = np.concatenate((bwt[bit == 0], bwt[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``c`` in the first ``i`` symbols of the transform, by wavelet-matrix levels."""
        lo = np.zeros(len(i), np.int64)
        hi = i.astype(np.int64)
        for depth, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = ((c >> (self.levels - 1 - depth)) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo = np.where(bit, zeros + a, lo - a)
            hi = np.where(bit, zeros + b, hi - b)
        return hi - lo

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of each phrase (rows of an integer matrix) by backward search."""
        k = phrases.shape[1]
        phrases = phrases.astype(np.int64) + 1
        c = phrases[:, -1]
        lo, hi = self.first[c].copy(), self.first[c + 1].copy()
        live = np.flatnonzero(hi > lo)
        for j in reversed(range(k - 1)):
            c = phrases[live, j]
            both = self.rank(np.concatenate((c, c)), np.concatenate((lo[live], hi[live])))
            lo[live] = self.first[c] + both[: len(live)]
            hi[live] = self.first[c] + both[len(live) :]
            live = live[hi[live] > lo[live]]
        hi = np.maximum(hi, lo)
        return lo, hi

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text position of every row of the ranges, and the phrase of each."""
        row, phrase = ranges(lo, hi)
        at = np.full(len(row), -1, np.int64)
        todo = np.arange(len(row))
        for steps in range(self.sample + 1):
            found = self.kept[row[todo]]
            hit = todo[found]
            at[hit] = self.kept_at[self.kept_rank[row[hit]]] + steps
            todo = todo[~found]
            if not len(todo):
                break
            c = self.bwt[row[todo]].astype(np.int64)
            row[todo] = self.first[c] + self.rank(c, row[todo])
        return at % self.n, phrase
