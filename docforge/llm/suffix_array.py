"""Suffix array by linear grouping, without recursive renaming.

Phase 1 refines groups of suffixes that begin with the same Lyndon word.
Groups are taken in descending order; the members of one look back to the
nearest suffix in a smaller group (previous-smaller pointers, which skip what
is already done), and what they point to is split off its group into higher
ones, the higher the more members point to it.  In the end a group is the set
of suffixes with one Lyndon prefix.  Phase 2 walks the suffixes in order and
emits, at the front of its group, each suffix whose Lyndon prefix ends just
before the one at hand; the pointers of phase 1 find them.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np


def suffix_array(symbols: list[int] | np.ndarray) -> list[int]:
    """Starts of all suffixes in order; a proper prefix comes first."""
    n = len(symbols)
    if not n:
        return []
    text = np.asarray(symbols)
    order = np.argsort(text, kind="stable")
    first = np.r_[True, text[order][1:] != text[order][:-1]]
    begin = np.flatnonzero(first)[np.cumsum(first) - 1]
    group = np.empty(n, np.int64)
    group[order] = begin + 1  # place 0 is the end of the text
    place = np.empty(n, np.int64)
    place[order] = np.arange(1, n + 1)
    size_of = np.zeros(n + 2, np.int64)
    starts, counts = np.unique(begin + 1, return_counts=True)
    size_of[starts] = counts
    order, group, place, size = [n, *order.tolist()], group.tolist(), place.tolist(), size_of.tolist()
    before = [-1] * n
    end = n + 1
    while end > 1:
        start = group[order[end - 1]]
        if end - start == 1:
            i = order[start]
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[i] = p
            if p >= 0:
                pointed = {1: [p]}
            else:
                pointed = {}
        else:
            hits: Counter[int] = Counter()
            for i in sorted(order[start:end]):
                p = i - 1
                while p >= 0 and group[p] >= start:
                    p = before[p]
                before[i] = p
                if p >= 0:
                    hits[p] += 1
            pointed = defaultdict(list)
            for p, k in hits.items():
                pointed[k].append(p)
        for k in sorted(pointed, reverse=True) if len(pointed) > 1 else pointed:
            taken: dict[int, int] = {}
            for p in pointed[k]:  # to the back of its group
                g = group[p]
                left = size[g] = size[g] - 1
                q, at = order[g + left], place[p]
                order[g + left], order[at] = p, q
                place[p], place[q] = g + left, at
                taken[g] = taken.get(g, 0) + 1
            for p in pointed[k]:
                group[p] += size[group[p]]
            for g, many in taken.items():
                size[g + size[g]] = many
        end = start
    out = [n] + [0] * n
    front = list(range(n + 2))
    placed = bytearray(n)
    for i in range(n + 1):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            placed[j] = 1
            j = before[j]
    return out[1:]
