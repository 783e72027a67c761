"""Matching blocks of two sequences: the longest common run, then the same to its left and to its right."""

from __future__ import annotations

from collections.abc import Hashable, Sequence

#: A block: where it begins in either sequence, and its length.
Block = tuple[int, int, int]


class _Runs:
    """All runs of items within b[lo:hi], as a suffix automaton: a state stands for runs that end at the same places and knows the first of these."""

    def __init__(self, b: Sequence[Hashable], lo: int, hi: int):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [lo]
        last = 0
        for j in range(lo, hi):
            last = self._extended(b[j], j + 1, last)

    def _state(self, follow: dict, link: int, length: int, first: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _extended(self, item: Hashable, end: int, last: int) -> int:
        new = self._state({}, 0, self.length[last] + 1, end)
        p = last
        while p >= 0 and item not in self.next[p]:
            self.next[p][item] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][item]
            if self.length[q] > self.length[p] + 1:
                short = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1, self.first[q])
                while p >= 0 and self.next[p].get(item) == q:
                    self.next[p][item] = short
                    p = self.link[p]
                self.link[q] = q = short
            self.link[new] = q
        return new

    def longest(self, a: Sequence[Hashable], lo: int, hi: int) -> Block:
        """The longest run of a[lo:hi] that is here too: of equally long ones the first in a, and where that comes first in b."""
        best, state, n = (lo, lo, 0), 0, 0
        for i in range(lo, hi):
            item = a[i]
            while state and item not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if item in self.next[state]:
                state, n = self.next[state][item], n + 1
                if n > best[2]:
                    best = i + 1 - n, self.first[state] - n, n
        return best


def matching_blocks(a: Sequence[Hashable], b: Sequence[Hashable]) -> list[Block]:
    """Blocks of equal items in order, those that meet in both sequences made one."""
    found, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        alo, ahi, blo, bhi = open_.pop()
        if alo == ahi or blo == bhi:
            continue
        i, j, n = _Runs(b, blo, bhi).longest(a, alo, ahi)
        if n:
            found.append((i, j, n))
            open_ += [(alo, i, blo, j), (i + n, ahi, j + n, bhi)]
    out: list[Block] = []
    for i, j, n in sorted(found):
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            i, j, n = out[-1][0], out[-1][1], out.pop()[2] + n
        out.append((i, j, n))
    return out


def opcodes(a: Sequence[Hashable], b: Sequence[Hashable]) -> tuple[list[tuple], float]:
    """How a becomes b as (tag, i1, i2, j1, j2), and the share of both that matches (0 to 100; two empty ones match)."""
    blocks = matching_blocks(a, b)
    out, i, j = [], 0, 0
    for x, y, n in [*blocks, (len(a), len(b), 0)]:
        tag = "replace" if i < x and j < y else "delete" if i < x else "insert" if j < y else None
        if tag:
            out.append((tag, i, x, j, y))
        i, j = x + n, y + n
        if n:
            out.append(("equal", x, i, y, j))
    total = len(a) + len(b)
    return out, 200.0 * sum(n for _, _, n in blocks) / total if total else 100.0
