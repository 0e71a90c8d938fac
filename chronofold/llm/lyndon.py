"""Suffix arrays by grouping suffixes by their Lyndon prefix, for many strings at once.

Phase 1 refines groups of suffixes, from the highest group down: for each suffix of the
group in hand, the pointer to its previous smaller suffix is found by jumping along the
pointers of higher groups; the suffixes pointed at leave their groups for new ones right
behind, ordered by how many pointers they got. In the end a group holds the suffixes of
one longest Lyndon prefix. Phase 2 writes the order out in one pass: each suffix, in
order, places the not yet placed suffixes on the pointer chain before it at the next free
place of their groups. No names are given and nothing recurs.

All strings of a call have the same length and advance together, a group each a step, so
that numpy works on one vector over the strings. Each string must start with a symbol
that is smaller than all others and occurs once.
"""

from __future__ import annotations

import numpy as np


def _ragged(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    size = end - start
    return np.repeat(end - np.cumsum(size), size) + np.arange(size.sum())


def _runs(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of a sequence that changes behind the places where ``change`` is set."""
    edge = np.flatnonzero(change) + 1
    start = np.zeros(len(edge) + 1, np.int64)
    start[1:] = edge
    size = np.empty(len(start), np.int64)
    size[:-1] = edge
    size[-1] = len(change) + 1
    return start, size - start


def lyndon_groups(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each suffix's group and pointer to its previous smaller suffix, over ``text`` (strings x
    length), positions counted over the flattened array."""
    lanes, n = text.shape
    flat = text.ravel().astype(np.int64)
    base = np.repeat(np.arange(lanes, dtype=np.int64) * n, n)
    order = np.argsort(base * (int(flat.max()) + 1) + flat, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    head = np.ones(len(order), bool)
    head[1:] = (flat[order[1:]] != flat[order[:-1]]) | (base[order[1:]] != base[order[:-1]])
    first = np.flatnonzero(head)
    end = np.zeros(len(order) + 1, np.int64)  # by group start
    end[first] = np.r_[first[1:], len(order)]
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(first, np.diff(np.r_[first, len(order)]))
    prev = np.full(len(order), -1, np.int64)
    moving = np.zeros(len(order), bool)
    top = (np.arange(lanes, dtype=np.int64) + 1) * n  # end of the highest group not yet in hand
    bottom = np.arange(lanes, dtype=np.int64) * n + 1  # the guard's own group needs nothing
    live = np.arange(lanes)
    while len(live):
        lo = group[order[top[live] - 1]]
        at = _ragged(lo, top[live])
        top[live] = lo
        live = live[lo > bottom[live]]
        who = order[at]
        mine = group[who]
        j = who - 1
        todo = np.flatnonzero(group[j] >= mine)
        while len(todo):
            jt = j[todo]
            jt = np.where(group[jt] > mine[todo], prev[jt], jt - 1)
            j[todo] = jt
            todo = todo[group[jt] >= mine[todo]]
        prev[who] = j
        p, times = np.unique(j, return_counts=True)
        old = group[p]
        by = np.lexsort((times, old))
        p, times, old = p[by], times[by], old[by]
        other = old[1:] != old[:-1]
        new_old, moved = _runs(other)
        g = old[new_old]
        tail = end[g] - moved
        places = _ragged(tail, end[g])
        # Who sits in the tail and does not move changes places with who moves and sits before it.
        moving[p] = True
        sitting = order[places]
        out = sitting[~moving[sitting]]
        moving[p] = False
        before = rank[p] < np.repeat(tail, moved)
        hole = rank[p][before]
        order[hole] = out
        rank[out] = hole
        order[places] = p
        rank[p] = places
        run, size = _runs(other | (times[1:] != times[:-1]))
        end[g] = tail
        end[places[run]] = places[run] + size
        group[p] = np.repeat(places[run], size)
    return group, prev


def suffix_arrays(text: np.ndarray) -> np.ndarray:
    """Strings x length: the positions in each string in the order of their suffixes."""
    lanes, n = text.shape
    group, prev = lyndon_groups(text)
    free = np.arange(lanes * n, dtype=np.int64)  # next free place, by group start
    out = np.full(lanes * n, -1, np.int64)
    placed = np.zeros(lanes * n, bool)
    base = np.arange(lanes, dtype=np.int64) * n

    def chain(j: np.ndarray) -> None:
        while len(j):
            j = j[~placed[j]]
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = prev[j]
            j = j[j >= 0]

    chain(base + n - 1)
    for k in range(n):
        s = out[base + k]
        chain(s[s > base] - 1)
    return out.reshape(lanes, n) - base[:, None]
