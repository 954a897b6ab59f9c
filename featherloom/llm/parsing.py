"""Locally consistent parsing of word sequences by recompression: runs and pairs get names that depend on content alone.

A name is a 64-bit hash of what it stands for, so all tasks of a cluster give equal runs and pairs the same name without a shared
table. In each pair round a coin, drawn from the name, makes every symbol a left or a right one; a left one and the right one
behind it become a pair. A symbol so depends on its neighbours only; ``Parse`` keeps, for each, the stretch of words that decided it.
Wherever that stretch stands, the same symbol stands.
"""

from __future__ import annotations

import numpy as np

from featherloom.llm.common import ODD, mix64

BASE, BASE2 = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
FAR = 1 << 40


class Powers:
    """base ** i and base ** -i modulo 2 ** 64, made longer when needed."""

    def __init__(self, base: int = BASE):
        self.base = base
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                a = np.full(size, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


class Stretches:
    """Hashes of any stretch of a word sequence."""

    def __init__(self, h: np.ndarray, powers: Powers):
        self.up, down = powers.upto(len(h) + 1)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * down[: len(h)], out=self.sums[1:])

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[hi] - self.sums[lo]) * self.up[lo] + (hi - lo).astype(np.uint64) * ODD)


def parse(h: np.ndarray, rounds: int, longest: int) -> tuple[np.ndarray, ...]:
    """(name, start, length, lo, hi) of the symbols of a word sequence given by its word hashes.

    ``lo``, ``hi`` bound the words that decided the symbol; beyond the ends of the text they are far away, as another place may go on
    there. Pairs longer than ``longest`` words are not made.
    """
    n = len(h)
    with np.errstate(over="ignore"):
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))       # runs of one word
        size = np.diff(np.concatenate([head, [n]]))
        name = np.where(size > 1, mix64(h[head] * ODD + size.astype(np.uint64)), h[head])
        lo, hi = head - 1, head + size + 1                                     # a run ends where another word is seen
        lo[0], hi[-1] = -FAR, FAR
        start, length = head, size
        for r in range(rounds):
            left = (mix64(name + np.uint64((r + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(63)) == 0
            pair = left[:-1] & ~left[1:] & (length[:-1] + length[1:] <= longest)
            first = np.concatenate([pair, [False]])
            second = np.concatenate([[False], pair])
            after = np.concatenate([hi[1:], [FAR]])
            before = np.concatenate([[-FAR], lo[:-1]])
            alone = ~first & ~second
            new_lo = np.where(alone & ~left, np.minimum(lo, before), lo)
            new_hi = np.where(first | (alone & left), np.maximum(hi, after), hi)
            name = np.where(first, mix64(name * ODD + np.concatenate([name[1:], name[-1:]])), name)
            length = np.where(first, length + np.concatenate([length[1:], [0]]), length)
            keep = ~second
            # a pair's stretch begins at its left symbol's and ends at its right one's
            new_lo[:-1] = np.where(pair, np.minimum(new_lo[:-1], lo[1:]), new_lo[:-1])
            name, start, length, lo, hi = name[keep], start[keep], length[keep], new_lo[keep], new_hi[keep]
    return name, start, length, lo, hi


class Windows:
    """All windows of a word sequence: ``anchor`` and ``whole`` (64 bits each) of the window at each word; ``twice`` lists anchors that
    this sequence may hold at two places.

    The anchor is the least hash of a symbol's deciding stretch among the symbols decided inside the window; a window without one
    has a second hash of itself. Equal windows have equal anchors, at the same place.
    """

    def __init__(self, h: np.ndarray, window: int, powers: tuple[Powers, Powers], rounds: int = 4, longest: int = 10):
        at = np.arange(max(len(h) - window + 1, 0))
        if not len(at):
            self.anchor = self.whole = self.twice = np.empty(0, np.uint64)
            return
        stretches = Stretches(h, powers[0])
        self.whole = stretches.of(at, at + window)
        _, _, _, lo, hi = parse(h, rounds, longest)
        good = (lo >= 0) & (hi <= len(h)) & (hi - lo <= window)
        lo, hi = lo[good], hi[good]
        mark = stretches.of(lo, hi)
        a, b = np.searchsorted(lo, at), np.searchsorted(hi, at + window, "right")     # both bounds never sink along the text
        many = np.maximum(b - a, 0)
        out = np.empty_like(self.whole)
        tables = [mark]
        while (1 << len(tables)) <= many.max():
            k = 1 << (len(tables) - 1)
            tables.append(np.minimum(tables[-1][:-k], tables[-1][k:]))
        for j, t in enumerate(tables):
            use = (many >> j) == 1
            out[use] = np.minimum(t[a[use]], t[b[use] - (1 << j)])
        alone = many == 0
        if alone.any():
            p = at[alone]
            out[alone] = Stretches(h, powers[1]).of(p, p + window)
            mark = np.concatenate([mark, out[alone]])
        values, count = np.unique(mark, return_counts=True)
        self.anchor, self.twice = out, values[count > 1]
