"""Edit distance of long sequences, bit-parallel: a whole column of the table is two integers, however long it is."""

from __future__ import annotations

from collections.abc import Sequence


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Insertions, deletions and replacements from a to b (items hashable).

    Neighbouring cells of the table differ by one at most, so a column is kept as the set of places where it goes up and the set of those
    where it goes down, each one integer with a bit an item of a. A step to the next item of b is a dozen operations on such
    integers: time grows with len(a) * len(b) / 64, memory with len(a). What both begin or end with costs nothing.
    """
    lo, ends = 0, (len(a), len(b))
    while lo < min(ends) and a[lo] == b[lo]:
        lo += 1
    while min(ends) > lo and a[ends[0] - 1] == b[ends[1] - 1]:
        ends = ends[0] - 1, ends[1] - 1
    a, b = a[lo : ends[0]], b[lo : ends[1]]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    where = _places(a)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = full, 0, len(a)
    for item in b:
        same = where.get(item, 0)
        straight = same | down
        # an addition carries a match along a run of places that go up
        diagonal = (((same & up) + up) ^ up) | straight
        rise, fall = down | (full & ~(diagonal | up)), up & diagonal
        if rise & top:
            distance += 1
        elif fall & top:
            distance -= 1
        rise, fall = (rise << 1 | 1) & full, (fall << 1) & full
        up, down = fall | (full & ~(straight | rise)), rise & straight
    return distance


def _places(items: Sequence) -> dict:
    """For each distinct item an integer with the bits of its places set."""
    at: dict = {}
    for k, item in enumerate(items):
        at.setdefault(item, []).append(k)
    out = {}
    for item, own in at.items():
        held = bytearray(own[-1] // 8 + 1)
        for k in own:
            held[k >> 3] |= 1 << (k & 7)
        out[item] = int.from_bytes(held, "little")
    return out
