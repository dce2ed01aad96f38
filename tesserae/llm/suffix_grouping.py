"""Linear suffix array construction by grouping.

Suffixes are grouped by their Lyndon prefixes. Groups are processed in descending order: for each suffix of a group, the
pointer to the previous suffix of a smaller group is found by jumping along pointers already known; the suffixes pointed
at extend their Lyndon prefix by that of the group, the more pointers the larger, and move to new groups just behind their
old ones. A second pass emits each group's order from the smallest suffix up. No symbols are renamed and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The starts of all suffixes of a sequence of integers, in ascending order."""
    n = len(symbols)
    if n < 2:
        return np.arange(n)
    text = np.append(np.asarray(symbols, np.int64) - np.min(symbols) + 1, 0)  # the end is smaller than all
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    sizes = np.diff(np.append(first, n + 1))
    start_of = np.empty(n + 1, np.int64)
    start_of[order] = np.repeat(first, sizes)
    place_of = np.empty(n + 1, np.int64)
    place_of[order] = np.arange(n + 1)
    array, group, place = order.tolist(), start_of.tolist(), place_of.tolist()
    size = [0] * (n + 1)
    for a, c in zip(first.tolist(), sizes.tolist(), strict=True):
        size[a] = c
    previous = [-1] * (n + 1)

    right = n
    while right > 0:  # the group of the end alone, at 0, points at nothing that matters
        s = array[right]
        g = group[s]
        if g == right:  # a group of one, as most are: its pointer's target moves behind its own group
            j = s - 1
            while j >= 0 and group[j] >= g:
                j = previous[j]
            previous[s] = j
            if j >= 0:
                h = group[j]
                size[h] -= 1
                last = h + size[h]
                q, at = array[last], place[j]
                array[at], array[last] = q, j
                place[q], place[j] = at, last
                group[j] = last
                size[last] += 1
            right -= 1
            continue
        members = sorted(array[g : right + 1])
        pointers: dict[int, int] = {}
        for s in members:
            j = s - 1
            while j >= 0 and group[j] >= g:
                j = previous[j]
            previous[s] = j
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for p, c in pointers.items():
            by_count.setdefault(c, []).append(p)
        for c in sorted(by_count, reverse=True):
            moved = by_count[c]
            for p in moved:
                h = group[p]
                last = h + size[h] - 1
                q, at = array[last], place[p]
                array[at], array[last] = q, p
                place[q], place[p] = at, last
                size[h] -= 1
            behind = [group[p] + size[group[p]] for p in moved]  # all found before any is set: a group may move whole
            for p, new in zip(moved, behind, strict=True):
                group[p] = new
                size[new] += 1
        right = g - 1

    out, free, placed = [-1] * (n + 1), list(range(n + 1)), [False] * (n + 1)
    out[0] = n
    for i in range(n + 1):
        s = out[i] - 1
        while s >= 0 and not placed[s]:
            placed[s] = True
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            s = previous[s]
    return np.array(out[1:], np.int64)
