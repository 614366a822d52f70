"""A compressed full-text index over sequences of word numbers, in numpy: BWT in a wavelet matrix with bit-packed ranks.

The text of a shard is a concatenation of segments, each closed by symbol 0, and every segment belongs to a document.
What is kept is the wavelet matrix (n log sigma bits), two bit vectors that mark the runs of suffixes with equal first words, and
the least document of each run: no suffix order and no text.

The suffixes are sorted by their first ``ORDER`` symbols, which is enough for backward search of patterns up to
``ORDER - 1`` symbols.
"""

from __future__ import annotations

import numpy as np

ORDER = 16


class RankBits:
    """A bit vector of n bits in n/8 bytes, with a running count for each 64 bits."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        w, r = i >> 6, (i & 63).astype(np.uint64)
        part = self.words[w] & ((np.uint64(1) << r) - np.uint64(1))
        return self.before[w] + np.bitwise_count(part).astype(np.int64)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray):
        self.levels: list[tuple[int, RankBits, int]] = []
        top = int(symbols.max()).bit_length() if len(symbols) else 1
        s = symbols
        for b in range(max(top, 1) - 1, -1, -1):
            bit = ((s >> b) & 1).astype(bool)
            zeros = int(len(s) - bit.sum())
            self.levels.append((b, RankBits(bit), zeros))
            s = np.concatenate((s[~bit], s[bit]))

    def descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i of the sequence ends up at the bottom along the path of symbol c."""
        for b, bits, zeros in self.levels:
            r = bits.rank1(i)
            i = np.where((c >> b) & 1, zeros + r, i - r)
        return i


class FMIndex:
    """``text``: word numbers from 1, each segment closed by 0; ``docs``: the document of each position."""

    def __init__(self, text: np.ndarray, docs: np.ndarray, window: int):
        assert window < ORDER
        n = len(text)
        self.n, self.window = n, window
        rank = text.astype(np.int64)
        ranks = {1: rank}
        k = 1
        while k < ORDER:
            nxt = np.full(n, -1, np.int64)
            nxt[: n - k] = rank[k:]
            key = rank * (n + int(text.max(initial=0)) + 2) + nxt + 1
            order = np.argsort(key, kind="stable")
            s = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], s[1:] != s[:-1])))
            k *= 2
            ranks[k] = rank
        bwt = text[order - 1]
        self.wave = WaveletMatrix(bwt)
        self.sigma = int(text.max(initial=0)) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.sigma))))
        self.bottom = self.wave.descend(np.arange(self.sigma), np.zeros(self.sigma, np.int64))
        self.short = self._group(ranks, order, window - 1)
        self.long = self._group(ranks, order, window)
        self.least = np.minimum.reduceat(docs[order], self.long[0][:-1]) if n else docs

    def _group(self, ranks: dict[int, np.ndarray], sa: np.ndarray, k: int) -> tuple[np.ndarray, RankBits]:
        """Runs of suffixes that agree in their first k symbols: (their starts and the end, bits that mark the starts)."""
        change = np.zeros(self.n, bool)
        change[:1] = True
        at = 0
        for p in (8, 4, 2, 1):
            if k & p:
                pos = sa + at
                r = np.where(pos < self.n, ranks[p][np.minimum(pos, self.n - 1)], -1)
                change[1:] |= r[1:] != r[:-1]
                at += p
        return np.append(np.flatnonzero(change), self.n).astype(np.int32), RankBits(change)

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the suffixes in [lo, hi) that follow symbol c, as the interval of c + pattern."""
        base = self.first[c] - self.bottom[c]
        return base + self.wave.descend(c, lo), base + self.wave.descend(c, hi)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of patterns given as rows of symbols; symbols outside the text's give empty ones."""
        m = len(patterns)
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, j]
            ok = (c > 0) & (c < self.sigma) & (lo < hi)
            lo[~ok] = hi[~ok] = 0
            if ok.any():
                lo[ok], hi[ok] = self.step(c[ok], lo[ok], hi[ok])
        return lo, hi

    def matching(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Stream segments against the index, right to left.

        For each position of ``flat`` where a whole window of its segment starts: the least document of the index that
        holds the window, or -1 if none does. Other positions: -1. A window costs one backward step from its right
        neighbour's interval, shortened by one symbol; where that one had no match it is searched afresh.
        """
        w, out = self.window, np.full(len(flat), -1, np.int64)
        lanes = np.flatnonzero(sizes >= w)
        lanes = lanes[np.argsort(-sizes[lanes], kind="stable")]
        if not len(lanes) or not self.n:
            return out
        s, count = starts[lanes], sizes[lanes] - w + 1
        lo = hi = np.zeros(len(lanes), np.int64)
        for t in range(int(count[0])):
            live = int(np.searchsorted(-count, -t, "left"))  # lanes that have more than t windows
            at = s[:live] + count[:live] - 1 - t
            if t:
                lo, hi = lo[:live], hi[:live]
                ok = lo < hi
                g = self.short[1].rank1(np.minimum(lo, self.n - 1) + 1) - 1
                lo, hi = np.where(ok, self.short[0][g], 0).astype(np.int64), np.where(ok, self.short[0][g + 1], 0).astype(np.int64)
                c = flat[at]
                ok &= (c > 0) & (c < self.sigma)
                lo[~ok] = hi[~ok] = 0
                if ok.any():
                    lo[ok], hi[ok] = self.step(c[ok], lo[ok], hi[ok])
            else:
                lo, hi = np.zeros(live, np.int64), np.zeros(live, np.int64)
            again = np.flatnonzero(lo >= hi)
            if len(again):
                lo[again], hi[again] = self.search(flat[at[again][:, None] + np.arange(w)])
            found = lo < hi
            out[at[found]] = self.least[self.long[1].rank1(lo[found] + 1) - 1]
        return out
