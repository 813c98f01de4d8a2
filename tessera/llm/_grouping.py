"""Suffix arrays by linear grouping.

Suffixes are first grouped by their first symbol. Groups are taken in
descending order; each suffix of the group points to the nearest suffix on its
left in a lower group. The suffixes pointed to are moved up within their own
groups, further the more pointers they get. In the end each group holds the
suffixes with the same Lyndon prefix. A second pass from the smallest suffix
emits the order inside the groups along the same pointers; no names are
assigned again and nothing recurses.
"""

from __future__ import annotations

from collections.abc import Sequence


def grouped(text: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """(group of each suffix, as the group's first place in the order; pointers; the text with its sentinel)."""
    s = [*text, 0]
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    place, group, end = [0] * n, [0] * n, [0] * (n + 1)
    first = 0
    for k, i in enumerate(order):
        if s[i] != s[order[first]]:
            end[first] = k
            first = k
        place[i], group[i] = k, first
    end[first] = n
    left = [-1] * n
    high = n
    while high:
        low = group[order[high - 1]]
        pointers: dict[int, int] = {}
        for i in sorted(order[low:high]):
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = left[j]
            left[i] = j
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        moves: dict[int, dict[int, list[int]]] = {}
        for j, count in pointers.items():
            moves.setdefault(count, {}).setdefault(group[j], []).append(j)
        for count in sorted(moves, reverse=True):
            for g, members in moves[count].items():
                last = end[g]
                new = last - len(members)
                for j in members:
                    last -= 1
                    other, at = order[last], place[j]
                    order[at], place[other] = other, at
                    order[last], place[j] = j, last
                    group[j] = new
                if new > g:
                    end[new], end[g] = end[g], new
        high = low
    return group, left, s


def suffix_array(text: Sequence[int]) -> list[int]:
    """Starts of the suffixes of ``text`` (symbols above 0) in ascending order."""
    group, left, s = grouped(text)
    n = len(s)
    slot, out, placed = list(range(n)), [-1] * n, [False] * n
    out[0], placed[n - 1] = n - 1, True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[slot[g]] = j
            slot[g] += 1
            placed[j] = True
            j = left[j]
    return out[1:]


def common_prefixes(text: Sequence[int], order: Sequence[int]) -> list[int]:
    """Length of the common prefix of each suffix in the order with the one before (0 for the first)."""
    n = len(text)
    rank, out, h = [0] * n, [0] * n, 0
    for k, i in enumerate(order):
        rank[i] = k
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            out[rank[i]] = h
            h = max(h - 1, 0)
        else:
            h = 0
    return out
