"""Matching blocks of two texts: longest common substring first, then the same
to its left and to its right (Ratcliff and Obershelp, without a junk rule).

Of equally long substrings the one that starts first in the left text counts,
then the one first in the right.  The longest one is found by bisection over its
length: two ranges share a substring of some length if a hash of some window of
that length is in both.  That takes n log n steps for n characters where a
table of all equal pairs takes n squared.  Small ranges use a plain table.
"""

from __future__ import annotations

import numpy as np

Block = tuple[int, int, int]
#: Pairs of characters up to which a plain table is faster.
_SMALL = 8_000
_BASE = np.uint64(0x2545F4914F6CDD1D)
_STIR = np.uint64(0x9E3779B97F4A7C15)


class _Windows:
    """Hashes of all windows of a text, by length."""

    def __init__(self, text: str):
        x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        x *= _STIR
        self.codes = x ^ (x >> np.uint64(29))
        self.held: dict[int, np.ndarray] = {1: self.codes}

    def of(self, length: int) -> np.ndarray:
        """Windows of 2k characters are pairs of windows of k."""
        out = self.held.get(length)
        if out is None:
            half = length // 2
            left, right = self.of(half), self.of(length - half)
            n = len(self.codes) - length + 1
            out = left[:n] * _BASE + (right[half : half + n] ^ _STIR)
            out ^= out >> np.uint64(31)
            out *= _STIR
            out ^= out >> np.uint64(29)
            self.held[length] = out
        return out


def _table(left: str, right: str, a: int, b: int, c: int, d: int) -> Block:
    best, at = (a, c, 0), {}
    places: dict[str, list[int]] = {}
    for j in range(c, d):
        places.setdefault(right[j], []).append(j)
    for i in range(a, b):
        now = {}
        for j in places.get(left[i], ()):
            k = now[j] = at.get(j - 1, 0) + 1
            if k > best[2]:
                best = (i - k + 1, j - k + 1, k)
        at = now
    return best


def _longest(left: str, right: str, lw: _Windows, rw: _Windows, a: int, b: int, c: int, d: int) -> Block:
    """The first longest common substring of left[a:b] and right[c:d]."""
    if (b - a) * (d - c) <= _SMALL:
        return _table(left, right, a, b, c, d)
    lo, hi, found = 0, min(b - a, d - c) + 1, None
    step = 8
    while hi - lo > 1:
        # lengths grow by doubling until one fails
        mid = min(lo + step, hi - 1) if step else (lo + hi) // 2
        x, y = lw.of(mid)[a : b - mid + 1], rw.of(mid)[c : d - mid + 1]
        hit = np.isin(x, y)
        first = int(hit.argmax())
        if hit[first]:
            lo, found = mid, (first, int(np.flatnonzero(y == x[first])[0]))
            step *= 2
        else:
            hi, step = mid, 0
    if found is None:
        return a, c, 0
    i, j = a + found[0], c + found[1]
    # equal hashes of unequal windows are next to impossible, yet never wrong
    return (i, j, lo) if left[i : i + lo] == right[j : j + lo] else _table(left, right, a, b, c, d)


def matching_blocks(left: str, right: str) -> list[Block]:
    """(start in left, start in right, length) in order; neighbours that touch
    in both texts are one."""
    if left == right:
        return [(0, 0, len(left))] if left else []
    lw, rw = _Windows(left), _Windows(right)
    todo, found = [(0, len(left), 0, len(right))], []
    while todo:
        a, b, c, d = todo.pop()
        i, j, n = _longest(left, right, lw, rw, a, b, c, d)
        if n:
            found.append((i, j, n))
            todo += [r for r in ((a, i, c, j), (i + n, b, j + n, d)) if r[0] < r[1] and r[2] < r[3]]
    out: list[Block] = []
    for i, j, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def appears_once(text: str, part: str) -> bool:
    """Whether a part that the text holds stands there at one place only."""
    return text.find(part, text.find(part) + 1) < 0
