"""Suffix array by linear grouping.

First phase: suffixes are grouped by their first symbol, and groups are taken in
descending order. Every member of a group has a previous-smaller pointer, the nearest
position before it that is in a lower group; pointers of members already done are jumped
along. A position that k members point to has its prefix followed by k copies of the
group's, so it moves, together with all such positions of its own group, to a new group
just above; larger k first. At the end each group holds the suffixes of one Lyndon prefix.

Second phase: what follows a suffix's Lyndon prefix is its next smaller suffix, so suffixes
are emitted in ascending order: every emitted suffix lets those that it ends, found along
the previous-smaller pointers of the position before it, take the next place of their
groups. Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

import numpy as np


def lyndon_groups(symbols: np.ndarray) -> tuple[list[int], list[int]]:
    """Start rank of every position's final group and every position's previous-smaller pointer."""
    n = len(symbols)
    by_symbol = np.argsort(symbols, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(symbols[by_symbol]) != 0)) if n else np.empty(0, int)
    sizes = np.zeros(n, int)
    sizes[heads] = np.diff(np.append(heads, n))
    starts = np.empty(n, int)
    starts[by_symbol] = np.repeat(heads, sizes[heads])
    place = np.empty(n, int)
    place[by_symbol] = np.arange(n)
    order, size, group, at = by_symbol.tolist(), sizes.tolist(), starts.tolist(), place.tolist()
    prev = [-1] * n
    top = n
    while top > 0:
        own = group[order[top - 1]]
        members = order[own:top]
        if len(members) > 1:
            members.sort()
        top = own
        points: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= own:  # done or in this group: its pointer is known
                j = prev[j]
            prev[i] = j
            if j >= 0:
                points[j] = points.get(j, 0) + 1
        if not points:
            continue
        if len(points) == 1 or max(points.values()) == 1:
            rounds = [list(points)]
        else:
            by_count: dict[int, list[int]] = {}
            for j, k in points.items():
                by_count.setdefault(k, []).append(j)
            rounds = [by_count[k] for k in sorted(by_count, reverse=True)]
        for moved in rounds:
            for j in moved:
                g = group[j]
                left = size[g] - 1
                size[g] = left
                end, here = g + left, at[j]
                other = order[end]
                order[here], order[end] = other, j
                at[other], at[j] = here, end
            fresh = [group[j] + size[group[j]] for j in moved]
            for j, g in zip(moved, fresh):
                group[j] = g
                size[g] += 1
    return group, prev


def suffix_array(symbols: np.ndarray) -> list[int]:
    """Start positions of all suffixes of an integer sequence in ascending order."""
    n = len(symbols)
    group, prev = lyndon_groups(symbols)
    free = list(range(n))  # next place of the group that starts here
    placed = bytearray(n)
    out = [0] * n
    rank, s = -1, n
    while True:
        j = s - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            j = prev[j]
        rank += 1
        if rank == n:
            return out
        s = out[rank]
