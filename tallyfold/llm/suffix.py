"""Two-stage suffix sorting with adjacent common prefixes, in numpy, for one task's bounded piece of text."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (small non-negative integers) in order of their first ``depth`` symbols at least.

    Only suffixes that are smaller than their successor are sorted directly. They end up at the ends of their first symbols'
    buckets; one scan from the left then puts every other suffix at the front of its bucket, as its successor comes before it.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # A suffix is smaller than its successor if its symbol is smaller than the next different one.
    change = np.flatnonzero(np.append(text[:-1] != text[1:], True))
    run_end = change[np.searchsorted(change, np.arange(n))]
    after = np.append(text, -1)[run_end + 1]
    smaller = text < after
    direct = np.flatnonzero(smaller)
    # Symbols are packed big-endian, so comparing bytes compares symbols.
    padded = np.concatenate([text.astype(np.int64) + 1, np.zeros(depth, np.int64)])
    keys = np.lib.stride_tricks.sliding_window_view(padded.astype(">u2" if padded.max() < 1 << 16 else ">u4"), depth)[direct]
    keys = np.ascontiguousarray(keys)
    order = direct[np.argsort(keys.view(f"S{keys.dtype.itemsize * depth}").ravel(), kind="stable")]

    counts = np.bincount(text)
    ends = np.cumsum(counts)
    out = np.full(n, -1, np.int64)
    # Direct suffixes fill their buckets from the end.
    first = text[order]
    sizes = np.bincount(first, minlength=len(counts))
    out[np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(ends - sizes, sizes)] = order
    heads, symbols, larger, places = (ends - counts).tolist(), text.tolist(), (~smaller).tolist(), out.tolist()
    # The last suffix is larger than the empty one after it, which would come first of all.
    if larger[n - 1]:
        c = symbols[n - 1]
        places[heads[c]] = n - 1
        heads[c] += 1
    for k in range(n):
        i = places[k] - 1
        if i >= 0 and larger[i]:
            c = symbols[i]
            places[heads[c]] = i
            heads[c] += 1
    return np.array(places, np.int64)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place k > 0 the common prefix, up to ``depth``, of the suffixes at k - 1 and k; 0 for the first."""
    padded = np.concatenate([text.astype(np.int64), -1 - np.arange(depth)])
    length = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for step in range(depth):
        # Behind the end nothing is equal, as suffixes end at different places.
        alive = alive[(order[alive] + step < len(text)) & (order[alive - 1] + step < len(text)) & (padded[np.minimum(order[alive] + step, len(padded) - 1)] == padded[np.minimum(order[alive - 1] + step, len(padded) - 1)])]
        if not len(alive):
            break
        length[alive] += 1
    return length
