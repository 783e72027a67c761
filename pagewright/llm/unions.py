"""Union of indices by numpy: labels that point to the least index of their set."""

from __future__ import annotations

import numpy as np


def united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label with the sets of i[k] and j[k] made one, for every k; every label is the least index of its set."""
    label = label.copy()
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label = further
    return label


def pairs_within(sizes_a: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each k all (k, x, y) with x < sizes_a[k] and y < sizes_b[k], as three arrays."""
    total = sizes_a * sizes_b
    k = np.repeat(np.arange(len(total)), total)
    at = np.arange(int(total.sum())) - np.repeat(np.cumsum(total) - total, total)
    return k, at // sizes_b[k], at % sizes_b[k]


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start, and the length at the end."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.append(np.flatnonzero(new), n)


def whole_groups(batches, n_keys: int):
    """Arrow batches of sorted rows as lists of columns that end where a group (equal first n_keys columns) ends."""
    held = None
    for batch in batches:
        own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(own[0]):
            continue
        held = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
        last = runs(*held[:n_keys])[-2]
        if last:
            yield [c[:last] for c in held]
            held = [c[last:] for c in held]
    if held is not None:
        yield held
