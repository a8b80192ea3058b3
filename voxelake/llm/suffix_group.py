"""Suffix sorting by linear grouping, without recursive renaming.

Suffixes are first grouped by their first symbol.  Groups are processed in descending order: every suffix
of a group looks up its previous suffix of a lower group (reached over previous-smaller pointers of what
is already processed), and the suffixes so pointed to move into new groups right above their old ones,
apart by how many members of the group point to them.  After that a group holds the suffixes with one
longest Lyndon prefix.  The second phase walks the order from the least suffix on and puts each
predecessor chain into the next free places of its groups.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: Sequence[int] | np.ndarray) -> np.ndarray:
    """The starts of the suffixes in ascending order (a suffix sorts before what it is a prefix of)."""
    codes = np.unique(np.asarray(symbols), return_inverse=True)[1].ravel()
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64)
    group = (codes + 1).tolist() + [0]  # the end is less than every symbol
    kinds = int(codes.max()) + 2
    order = np.argsort(codes, kind="stable")
    cuts = np.searchsorted(codes[order], np.arange(kinds))
    members: list[list[int]] = [[n]] + [order[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]
    below = list(range(-1, kinds - 1))  # groups as a linked list by rank
    above = list(range(1, kinds)) + [-1]
    previous = [-1] * (n + 1)
    done = bytearray(n + 1)  # the group of a suffix has been, or is being, processed
    at = kinds - 1
    while at >= 0:
        own = [i for i in members[at] if group[i] == at]
        members[at] = own
        for i in own:
            done[i] = 1
        points: dict[int, int] = {}
        for i in own:  # ascending, so equals to the left have their pointers
            j = i - 1
            while j >= 0 and done[j]:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                points[j] = points.get(j, 0) + 1
        if points:
            # more members first: the last group put right above an old one is the lowest of its new ones
            if len(points) > 1:
                by_count: dict[int, list[int]] = {}
                for j, c in points.items():
                    by_count.setdefault(c, []).append(j)
                parts = [by_count[c] for c in sorted(by_count, reverse=True)]
            else:
                parts = [list(points)]
            for part in parts:
                fresh: dict[int, int] = {}
                for j in part:
                    old = group[j]
                    new = fresh.get(old)
                    if new is None:
                        new = fresh[old] = len(members)
                        members.append([])
                        up = above[old]
                        above.append(up)
                        below.append(old)
                        above[old] = new
                        if up >= 0:
                            below[up] = new
                    group[j] = new
                    members[new].append(j)
        at = below[at]
    free = [0] * len(members)
    g, total = 0, 0
    while g >= 0:
        free[g] = total
        total += len(members[g])
        g = above[g]
    sa = [-1] * (n + 1)
    placed = bytearray(n + 1)
    sa[0], placed[n] = n, 1
    for k in range(n + 1):
        j = sa[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            sa[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = previous[j]
    return np.array(sa[1:], np.int64)
