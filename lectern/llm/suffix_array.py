"""Suffix arrays by induced sorting, and permuted common prefixes, with numpy.

Suffixes are classified as larger (L) or smaller (S) than their right neighbour. The leftmost-smaller (LMS) substrings
are sorted by induction, named, and if names repeat the string of names is sorted recursively; the order of the LMS
suffixes then induces that of all L and S suffixes. Induction goes bucket by bucket (one bucket per symbol): everything
that a bucket induces into later ones is one numpy scatter, and what it induces into itself takes a round for each
repetition of the symbol. Strings of names have too many symbols for that and are ranked by doubling instead, as deep as
the caller asks.
"""
from __future__ import annotations

import numpy as np


def _ranked(names: np.ndarray, depth: int) -> np.ndarray:
    """The order of suffixes of a string of names by their first `depth` names at least (all of them if 0)."""
    n = len(names)
    rank = names.astype(np.int64)
    k = 1
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: n - k] = rank[k:] + 1
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        k *= 2
        if new[-1] == n - 1 or k >= n or (depth and k >= depth):
            return order


def _induce(text: np.ndarray, larger: np.ndarray, heads: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that LMS suffixes in the given order induce."""
    n, symbols = len(text), len(heads)
    sa = np.full(n, -1, np.int64)
    # LMS suffixes at the ends of their buckets, in order.
    c = text[lms]
    order = np.argsort(c, kind="stable")
    lms, c = lms[order], c[order]
    count = np.bincount(c, minlength=symbols)
    sa[(ends - count)[c] + np.arange(len(c)) - (np.cumsum(count) - count)[c]] = lms

    def put(at: np.ndarray, free: np.ndarray, step: int) -> None:
        """Places suffixes, in order, at the free head (step 1) or end (-1) of their buckets."""
        d = text[at]
        o = np.argsort(d, kind="stable")
        at, d = at[o], d[o]
        cnt = np.bincount(d, minlength=symbols)
        place = np.arange(len(d)) - (np.cumsum(cnt) - cnt)[d]
        if step > 0:
            sa[free[d] + place] = at
            free += cnt
        else:
            sa[free[d] - 1 - place] = at
            free -= cnt

    present = np.flatnonzero(ends > heads)
    free = heads.copy()
    if larger[n - 1]:  # the last suffix is larger than the empty one
        put(np.array([n - 1]), free, 1)
    for b in present:
        done = heads[b]
        while done < free[b]:  # L suffixes, the bucket's own included
            block, done = sa[done : free[b]], free[b]
            p = block[block > 0] - 1
            p = p[larger[p]]
            if len(p):
                put(p, free, 1)
        block = sa[max(free[b], ends[b] - count[b]) : ends[b]]  # LMS suffixes
        p = block[block > 0] - 1
        if len(p):
            put(p[larger[p]], free, 1)
    top = free.copy()  # each bucket: L suffixes up to here
    free = ends.copy()
    for b in present[::-1]:
        done = ends[b]
        while done > free[b]:
            block, done = sa[free[b] : done][::-1], free[b]
            p = block[block > 0] - 1
            p = p[~larger[p]]
            if len(p):
                put(p, free, -1)
        block = sa[heads[b] : top[b]][::-1]
        p = block[block > 0] - 1
        p = p[~larger[p]]
        if len(p):
            put(p, free, -1)
    return sa


def suffix_array(text: np.ndarray, depth: int = 0) -> np.ndarray:
    """Starts of the suffixes of a string of small integers, sorted; a suffix is smaller than its extensions.

    With a depth, suffixes that agree in that many symbols may stand in any order among themselves."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    text = text.astype(np.int64)
    # Type of each suffix: that of the next position where neighbours differ; the last is L.
    differ = np.ones(n, bool)
    differ[:-1] = text[:-1] != text[1:]
    at = np.flatnonzero(differ)
    kind = np.ones(len(at), bool)
    kind[:-1] = text[at[:-1]] > text[at[:-1] + 1]
    larger = kind[np.searchsorted(at, np.arange(n))]
    count = np.bincount(text)
    ends = np.cumsum(count)
    heads = ends - count
    lms = np.flatnonzero(~larger[1:] & larger[:-1]) + 1
    if len(lms) < 2:
        return _induce(text, larger, heads, ends, lms)
    first = _induce(text, larger, heads, ends, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = first[is_lms[first]]
    # Names: neighbours in this order are equal if their LMS substrings (up to the next LMS position) are.
    index = np.full(n, -1, np.int64)
    index[lms] = np.arange(len(lms))
    length = np.append(np.diff(lms), n - lms[-1]) + 1
    a, b = order[:-1], order[1:]
    la, lb = length[index[a]], length[index[b]]
    same = la == lb
    live = np.flatnonzero(same)
    i = 0
    while len(live):
        inside = i < la[live]
        live = live[inside]
        x, y = a[live] + i, b[live] + i
        ok = (x < n) & (y < n)
        ok[ok] = text[x[ok]] == text[y[ok]]
        same[live[~ok]] = False
        live = live[ok]
        i += 1
    name = np.concatenate(([0], np.cumsum(~same)))
    if name[-1] < len(lms) - 1:
        names = np.empty(len(lms), np.int64)
        names[index[order]] = name
        # An LMS substring has two symbols of its own at least.
        wanted = depth // 2 + 1 if depth else 0
        order = lms[suffix_array(names, wanted) if name[-1] < 256 else _ranked(names, wanted)]
    return _induce(text, larger, heads, ends, order)


def permuted_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """PLCP, cut at `most`: for each position, how much its suffix shares with the one before it in the suffix array.

    Compared eight bytes at a time, all positions at once; a position leaves when a difference is found."""
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    padded = np.concatenate([text.astype(np.uint8), np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (n + 1, 8), (1, 1))
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(phi >= 0)
    got = 0
    while len(live) and got < most:
        x, y = np.minimum(live + got, n), np.minimum(phi[live] + got, n)
        same = eight[x] == eight[y]
        run = np.where(same.all(axis=1), 8, np.argmin(same, axis=1))
        out[live] += run
        live = live[run == 8]
        got += 8
    rest = np.minimum(n - np.arange(n), np.where(phi >= 0, n - phi, 0))
    return np.minimum(np.minimum(out, rest), most)
