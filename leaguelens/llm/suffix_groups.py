"""Suffix arrays by linear grouping construction."""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of ``text``, whose last symbol must be smaller than all others.

    First phase: suffixes are grouped by their Lyndon prefix.  Groups start as first
    symbols and are processed in descending order; each suffix of a group points to the
    nearest suffix before it in a smaller group, and the suffixes pointed to move, by the
    number of pointers, into groups right after their own.  Second phase: scanning the
    order from the left, each suffix puts the one before it, and those along its
    pointers, at the front of their groups.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)  # stable: ascending inside a group
    place, group = [0] * n, [0] * n  # position in ``order``; start of the group
    size = [0] * n  # by group start
    start = 0
    for k, s in enumerate(order):
        if text[s] != text[order[start]]:
            start = k
        place[s], group[s] = k, start
        size[start] += 1
    before = [-2] * n
    end = n
    while end:
        start = group[order[end - 1]]
        if end - start == 1:
            s = order[start]
            j = s - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[s] = j
            if j >= 0:
                g = group[j]
                if size[g] > 1:
                    size[g] -= 1
                    at, last = place[j], g + size[g]
                    other = order[last]
                    order[at], place[other] = other, at
                    order[last] = j
                    place[j] = group[j] = last
                    size[last] = 1
            end = start
            continue
        hits: dict[int, int] = {}
        for s in sorted(order[start:end]):
            j = s - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[s] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        levels: dict[int, list[int]] = {}
        for j, c in hits.items():
            levels.setdefault(c, []).append(j)
        for c in sorted(levels, reverse=True):
            moved: dict[int, list[int]] = {}
            for j in levels[c]:
                if size[group[j]] > 1:
                    moved.setdefault(group[j], []).append(j)
            for g, members in moved.items():
                if len(members) == size[g]:
                    continue
                size[g] -= len(members)
                first = last = g + size[g]
                size[first] = len(members)
                for j in members:
                    # members already in the tail need no swap with one another
                    at, other = place[j], order[last]
                    order[at], place[other] = other, at
                    order[last] = j
                    place[j] = last
                    group[j] = first
                    last += 1
        end = start
    free = list(range(n))  # by group start: its first free place
    done = [False] * n
    out = [0] * n
    out[0] = n - 1
    done[n - 1] = True
    free[0] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = before[j]
    return out
