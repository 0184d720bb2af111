"""Suffix arrays of many short texts at once, by grouping suffixes by their Lyndon prefixes.

First phase: suffixes with the same first symbol form a group.  The groups of a text are processed from the greatest down.
Every member's previous-smaller pointer is the nearest position to its left in a smaller group; processed positions leave a
linked list, so the pointer is read off it.  The positions pointed at are moved to the top of their own group, ordered by how
many pointers they got: their Lyndon prefix grows by that many copies of the processed group's.  In the end a group holds the
suffixes with one Lyndon prefix.  Second phase: going through the order from the least suffix on, each emitted suffix
emits, along the previous-smaller pointers of the position before it, the next member of their groups.  Nothing is renamed or
sorted again.

All texts of a batch advance together: a step processes one group, or emits one suffix, of each text with numpy operations.
"""

from __future__ import annotations

import numpy as np

from keytempo.llm.common import concat_ranges


def _skip(members: np.ndarray, table: np.ndarray, inside: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    """table[m], followed on while it is a member itself; -1 ends the way."""
    to = table[members]
    scratch[members] = to
    while True:
        more = np.flatnonzero((to >= 0) & inside[to])
        if not len(more):
            return to
        to[more] = scratch[to[more]]  # ways double in length
        scratch[members] = to


def groups(text: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First phase: each position's group (named by its first place in the order) and its previous-smaller pointer.

    ``text`` holds the texts one after the other, ``begin`` their limits; each ends in a symbol smaller than all its others.
    """
    n, lanes = len(text), len(begin) - 1
    lane = np.repeat(np.arange(lanes), np.diff(begin))
    order = np.lexsort((text, lane))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = (text[order][1:] != text[order][:-1]) | (lane[order][1:] != lane[order][:-1])
    heads = np.flatnonzero(new)
    group = np.empty(n, np.int64)
    group[order] = heads[np.cumsum(new) - 1]
    size = np.zeros(n, np.int64)
    size[heads] = np.diff(np.append(heads, n))
    left, right = np.arange(-1, n - 1), np.arange(1, n + 1)
    left[begin[:-1]] = -1
    right[begin[1:] - 1] = -1
    previous = np.full(n, -1, np.int64)
    inside, chosen, scratch = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int64)
    top = begin[1:].copy()
    live = np.flatnonzero(top > begin[:-1])
    while len(live):
        start = group[order[top[live] - 1]]
        members = order[concat_ranges(start, top[live] - start)]
        inside[members] = True
        back = _skip(members, left, inside, scratch)
        ahead = _skip(members, right, inside, scratch)
        inside[members] = False
        previous[members] = back
        some = ahead >= 0
        left[ahead[some]] = back[some]
        some = back >= 0
        right[back[some]] = ahead[some]
        parent, count = np.unique(back[some], return_counts=True)
        if len(parent):
            own = group[parent]
            by = np.lexsort((count, own))
            parent, count, own = parent[by], count[by], own[by]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            many = np.diff(np.append(first, len(own)))
            floor = own[first] + size[own[first]] - many  # the places at the top of each group
            target = concat_ranges(floor, many)
            chosen[parent] = True
            leaving = order[target]
            leaving = leaving[~chosen[leaving]]
            chosen[parent] = False
            vacated = place[parent]
            vacated = vacated[vacated < np.repeat(floor, many)]
            order[vacated], place[leaving] = leaving, vacated
            order[target], place[parent] = parent, target
            cut = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (count[1:] != count[:-1])]))
            size[own[first]] -= many
            named, sizes = target[cut], np.diff(np.append(cut, len(own)))
            size[named] = sizes
            group[parent] = np.repeat(named, sizes)
        top[live] = start
        live = live[start > begin[live]]
    return group, previous


def suffix_order(text: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The suffix arrays of the texts, one after the other, as positions in ``text``."""
    group, previous = groups(text, begin)
    n = len(text)
    order, free, emitted = np.full(n, -1, np.int64), np.arange(n), np.zeros(n, bool)
    last = begin[1:] - 1
    order[begin[:-1]] = last
    emitted[last] = True
    free[group[last]] += 1
    at, low, high = begin[:-1].copy(), begin[:-1].copy(), begin[1:].copy()
    walk = last - 1
    walk = np.where(walk >= low, walk, -1)
    while len(at):
        ends = walk < 0
        ends |= emitted[walk]
        go = np.flatnonzero(~ends)
        j = walk[go]
        g = group[j]
        order[free[g]] = j
        free[g] += 1
        emitted[j] = True
        walk[go] = previous[j]
        stop = np.flatnonzero(ends)
        at[stop] += 1
        done = stop[at[stop] >= high[stop]]
        stop = stop[at[stop] < high[stop]]
        w = order[at[stop]] - 1
        walk[stop] = np.where(w >= low[stop], w, -1)
        if len(done):
            keep = np.ones(len(at), bool)
            keep[done] = False
            at, low, high, walk = at[keep], low[keep], high[keep], walk[keep]
    return order
