"""A suffix array by linear grouping.

Suffixes are grouped by a prefix, at first by one symbol. The groups are processed in descending order. Each member of a group
points to the nearest suffix before it that lies in a smaller group; the suffixes pointed at are thereby known to go on with
this group's prefix, and are split off into a new group just behind their own, those with more pointers behind those with fewer.
In the end a group's prefix is the longest Lyndon word with which its suffixes begin.

A suffix is its group's prefix followed by the next smaller suffix. So when suffixes are emitted in ascending order, starting
from the empty one, each emitted suffix lets those that it follows take the next free place of their groups; the pointers list
them. Nothing is renamed, and nothing recurs.
"""

from __future__ import annotations


def suffix_order(text: list[int]) -> list[int]:
    """The starts of all suffixes of a list of numbers, in ascending order; a suffix is smaller than those that go on from it."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    group, where, size = [0] * n, [0] * n, [0] * n
    start = 0
    for k, i in enumerate(order):
        if k and text[i] != text[order[k - 1]]:
            start = k
        group[i], where[i] = start, k
        size[start] += 1
    before = _grouped(order, group, where, size)
    return _emitted(group, before)


def _grouped(order: list[int], group: list[int], where: list[int], size: list[int]) -> list[int]:
    """Refines the groups (named by the first of their places in ``order``) and returns the pointers."""
    before = [-1] * len(order)
    end = len(order) - 1
    while end >= 0:
        start = group[order[end]]
        if start == end:
            i = order[end]
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                g = group[j]
                s = size[g]
                if s > 1:
                    last = g + s - 1
                    at, other = where[j], order[last]
                    order[at], where[other] = other, at
                    order[last], where[j] = j, last
                    size[g], size[last], group[j] = s - 1, 1, last
        else:
            pointers: dict[int, int] = {}
            for i in sorted(order[start : end + 1]):
                j = i - 1
                while j >= 0 and group[j] >= start:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    pointers[j] = pointers.get(j, 0) + 1
            levels: dict[int, list[int]] = {}
            for j, count in pointers.items():
                levels.setdefault(count, []).append(j)
            for count in sorted(levels, reverse=True):
                _split(levels[count], order, group, where, size)
        end = start - 1
    return before


def _split(members: list[int], order: list[int], group: list[int], where: list[int], size: list[int]) -> None:
    """Moves members to the ends of their groups and makes them groups of their own there."""
    moved: dict[int, list[int]] = {}
    for j in members:
        g = group[j]
        size[g] -= 1
        last = g + size[g]
        at, other = where[j], order[last]
        order[at], where[other] = other, at
        order[last], where[j] = j, last
        moved.setdefault(g, []).append(j)
    for g, own in moved.items():
        fresh = g + size[g]
        size[fresh] = len(own)
        for j in own:
            group[j] = fresh


def _emitted(group: list[int], before: list[int]) -> list[int]:
    n = len(group)
    out, free, placed = [0] * n, list(range(n)), bytearray(n)
    j = n - 1  # what the empty suffix follows
    while j >= 0:
        out[free[group[j]]] = j
        free[group[j]] += 1
        placed[j] = 1
        j = before[j]
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = before[j]
    return out
