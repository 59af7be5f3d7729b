"""Suffix array by linear grouping.

The Lyndon prefix of a suffix is its longest prefix that is smaller than all
its own suffixes; behind it starts the next smaller suffix. Suffixes with one
Lyndon prefix are a group, and groups in the order of their prefixes are the
suffix array up to the order inside groups.

First phase: suffixes are grouped by their first symbol. Groups are taken from
the largest down. Each member of the group points to the nearest suffix before
it that is in a smaller group (all that are not smaller have been taken, so
the pointer skips them, with path compression). A suffix that k members of the
group point to has its prefix extended by k copies of the group's prefix, and
moves with its like into a new group just above its old one.

Second phase: from the smallest suffix up, each suffix that receives its rank
emits the suffixes whose next smaller suffix it is, each at the next free
place of its group. No names are given anew and nothing is sorted again.
"""

from __future__ import annotations

from collections.abc import Sequence


def lyndon_groups(text: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Group of each suffix, length of each group's prefix, and the groups from the smallest to the largest."""
    n = len(text)
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        by_symbol.setdefault(c, []).append(i)
    members = [by_symbol[c] for c in sorted(by_symbol)]
    length = [1] * len(members)
    group = [0] * n
    for g, own in enumerate(members):
        for i in own:
            group[i] = g
    # groups in order, as a list with links: below[g] is the next smaller one
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    live = [len(own) for own in members]  # members that have not moved on
    left = list(range(-1, n - 1))  # a suffix that is taken: where to look on for a smaller one
    taken = bytearray(n)
    g = len(members) - 1
    while g >= 0:
        own = members[g]
        if live[g] != len(own):
            own = [i for i in own if group[i] == g]
        for i in own:
            taken[i] = 1
        times: dict[int, int] = {}
        for i in own:
            j = left[i]
            if j >= 0 and taken[j]:
                while j >= 0 and taken[j]:
                    j = left[j]
                k = i
                while k != j:  # shorten the way for those that come after
                    left[k], k = j, left[k]
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        size = length[g]
        moved: dict[tuple[int, int], list[int]] = {}
        for j, k in times.items():
            old = group[j]
            if live[old] == 1:  # alone in its group, which may keep its place
                length[old] += k * size
            elif (old, k) in moved:
                moved[old, k].append(j)
            else:
                moved[old, k] = [j]
        # placed just above the old group: more copies are larger, so they come first and are pushed up
        for (old, k), some in sorted(moved.items(), key=_copies) if len(moved) > 1 else moved.items():
            new = len(members)
            members.append(some)
            length.append(length[old] + k * size)
            live.append(len(some))
            live[old] -= len(some)
            up = above[old]
            above.append(up)
            below.append(old)
            above[old] = new
            if up >= 0:
                below[up] = new
            for j in some:
                group[j] = new
        g = below[g]
    order = []
    g = next((x for x in range(len(members)) if below[x] < 0), -1)
    while g >= 0:
        order.append(g)
        g = above[g]
    return group, length, order


def _copies(item: tuple[tuple[int, int], list[int]]) -> int:
    return -item[0][1]


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of all suffixes in lexicographic order (a prefix of another suffix comes before it)."""
    n = len(text)
    if not n:
        return []
    group, length, order = lyndon_groups(text)
    size = [0] * len(length)
    for g in group:
        size[g] += 1
    place, at = [0] * len(length), 0
    for g in order:
        place[g] = at
        at += size[g]
    # for each suffix the suffixes whose next smaller one it is, as linked lists
    head, rest = [-1] * (n + 1), [-1] * n
    for i in range(n):
        s = i + length[group[i]]
        rest[i] = head[s]
        head[s] = i
    out = [-1] * n
    for r in range(-1, n):
        i = head[n if r < 0 else out[r]]
        while i >= 0:
            g = group[i]
            out[place[g]] = i
            place[g] += 1
            i = rest[i]
    return out
