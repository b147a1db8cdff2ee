"""Suffix arrays by induced sorting, and permuted common prefixes, in vector form.

Suffixes are classified as smaller (S) or larger (L) than the next one; leftmost S suffixes are
sorted by their substrings, induced from the ends of their buckets; the substrings get names and
the string of names is sorted recursively; the order of all suffixes is induced from it. A bucket
is induced in waves: the entries already in it yield their left neighbours, all at once and in
order, and those that land in the same bucket form the next wave, so a pass costs one vector
operation for each bucket and wave, and linear work in all. From an alphabet of ``ALPHABET``
characters on (names of a reduced string), buckets are too small for that; such a string is
ranked by prefix doubling.
"""

from __future__ import annotations

import numpy as np

ALPHABET = 2048


def _types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is S; the last one, a unique least character, is."""
    n = len(t)
    s = np.zeros(n, dtype=bool)
    s[-1] = True
    if n == 1:
        return s
    less, same = t[:-1] < t[1:], t[:-1] == t[1:]
    # the nearest position to the right whose comparison is decided
    at = np.where(same, n - 1, np.arange(n - 1))
    at = np.minimum.accumulate(at[::-1])[::-1]
    s[:-1] = np.where(at == n - 1, True, less[np.minimum(at, n - 2)])
    return s


def _induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The suffix array that the order of `lms` induces."""
    n = len(t)
    sa = np.full(n, -1, dtype=np.int32)
    tail = ends.copy()
    # leftmost S suffixes at the ends of their buckets, in order
    c = t[lms]
    order = np.argsort(c, kind="stable")
    sorted_, cs = lms[order], c[order]
    first = np.searchsorted(cs, np.arange(len(starts)))
    count = np.bincount(cs, minlength=len(starts))
    sa[(ends[cs] - count[cs]) + (np.arange(len(cs)) - first[cs])] = sorted_
    held = count
    # L suffixes from the left
    head = starts.copy()
    used = np.flatnonzero(ends > starts)
    for b in used:
        at = starts[b]
        while at < head[b]:  # waves of L suffixes of this bucket
            stop = head[b]
            _place_left(t, s, sa, sa[at:stop], head)
            at = stop
        if held[b]:
            _place_left(t, s, sa, sa[ends[b] - held[b] : ends[b]], head)
    # S suffixes from the right; the leftmost S ones are placed anew
    keep = head
    last = sa[0] if n else -1
    for b in used:
        sa[keep[b] : ends[b]] = -1
    sa[0] = last  # the least suffix, the last character
    tail = ends.copy()
    tail[t[n - 1]] -= 1
    for b in used[::-1]:
        at = ends[b]
        low = tail[b]
        if b == t[n - 1]:
            at = low = ends[b] - 1
        while at > low:
            _place_right(t, s, sa, sa[low:at], tail)
            at, low = low, tail[b]
        if keep[b] > starts[b]:
            _place_right(t, s, sa, sa[starts[b] : keep[b]], tail)
            # S suffixes of this bucket that its own L suffixes yield cannot be: an S before an L is smaller
    return sa


def _place_left(t, s, sa, entries, head) -> None:
    j = entries[entries > 0] - 1
    j = j[~s[j]]
    if not len(j):
        return
    c = t[j]
    order = np.argsort(c, kind="stable")
    j, c = j[order], c[order]
    cut = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    size = np.diff(np.append(cut, len(c)))
    u = c[cut]
    sa[np.repeat(head[u] - cut, size) + np.arange(len(c))] = j
    head[u] += size


def _place_right(t, s, sa, entries, tail) -> None:
    j = entries[entries > 0] - 1
    j = j[s[j]][::-1]
    if not len(j):
        return
    c = t[j]
    order = np.argsort(c, kind="stable")
    j, c = j[order], c[order]
    cut = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
    size = np.diff(np.append(cut, len(c)))
    u = c[cut]
    sa[np.repeat(tail[u] - 1 + cut, size) - np.arange(len(c))] = j
    tail[u] -= size


def _doubled(r: np.ndarray) -> np.ndarray:
    """The suffix array of a string over a large alphabet, by prefix doubling: only suffixes
    that still share their rank are sorted again."""
    n = len(r)
    order = np.argsort(r, kind="stable").astype(np.int32)
    rs = r[order]
    first = np.append(True, rs[1:] != rs[:-1])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # the place of its group
    k = 1
    single = first & np.append(first[1:], True)
    open_ = np.flatnonzero(~single)  # places whose suffixes are not told apart
    while len(open_):
        at = order[open_].astype(np.int64)
        group = rank[at]
        next_ = at + k
        key = (group.astype(np.uint64) << np.uint64(32)) | np.where(next_ < n, rank[np.minimum(next_, n - 1)] + 1, 0).astype(np.uint64)
        by = np.argsort(key)
        key, at, group = key[by], at[by], group[by]
        order[open_] = at
        first = np.append(True, key[1:] != key[:-1])
        rank[at] = open_[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        single = first & np.append(first[1:], True)
        open_ = open_[~single]
        k *= 2
    return order


def suffix_array(t: np.ndarray, alphabet: int) -> np.ndarray:
    """The suffix array of `t`, whose last character is its least and occurs once."""
    n = len(t)
    if n <= 2:
        return np.arange(n, dtype=np.int32)[::-1].copy()
    if alphabet > ALPHABET:
        return _doubled(t)
    s = _types(t)
    count = np.bincount(t, minlength=alphabet)
    ends = np.cumsum(count)
    starts = ends - count
    lms = np.flatnonzero(s[1:] & ~s[:-1]).astype(np.int32) + np.int32(1)
    sa = _induce(t, s, lms, starts, ends)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    by = sa[is_lms[sa]]
    # names: equal substrings from one leftmost S position to the next share one
    m = len(lms)
    place = np.zeros(n, dtype=np.int32)
    place[lms] = np.arange(m, dtype=np.int32)
    length = np.append(np.diff(lms), 0)
    q = place[by]
    a, b = q[:-1], q[1:]
    differ = length[a] != length[b]
    open_ = np.flatnonzero(~differ)
    k = 0
    while len(open_):  # compare the substrings, their ends included, character by character
        x, y = lms[a[open_]] + k, lms[b[open_]] + k
        ne = t[np.minimum(x, n - 1)] != t[np.minimum(y, n - 1)]
        differ[open_[ne]] = True
        k += 1
        open_ = open_[~ne]
        open_ = open_[length[a[open_]] >= k]
    names = np.empty(m, dtype=np.int64)
    number = np.concatenate([[0], np.cumsum(differ)])
    names[q] = number
    if int(number[-1]) == m - 1:
        order = by
    else:
        order = lms[suffix_array(names, int(number[-1]) + 1)]
    return _induce(t, s, order, starts, ends)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position the length of the prefix it shares with the suffix before it in the
    array. Only irreducible positions are compared; behind one, the length falls by one a step."""
    n = len(t)
    phi = np.full(n, -1, dtype=np.int32)
    phi[sa[1:]] = sa[:-1]
    reducible = phi > 0
    reducible[0] = False
    reducible[1:] &= t[:-1] == t[phi[1:] - 1]
    at = np.flatnonzero(~reducible & (phi >= 0)).astype(np.int32)
    value = np.zeros(n, dtype=np.int32)
    x, y = at, phi[at]
    # four characters of 16 bits at a time; the last character occurs once, so no step goes past it
    lanes = 4 if int(t.max(initial=0)) < 1 << 16 else 1
    block = np.zeros(n, dtype=np.uint64)
    for c in range(lanes):
        block[: max(n - c, 0)] |= t[c:].astype(np.uint64) << np.uint64(16 * c)
    k = 0
    while len(at):
        differ = block[x] ^ block[y]
        stop = differ != 0
        rest = differ[stop]
        same = np.full(len(rest), k, dtype=np.int32)
        for c in range(1, lanes):
            same += (rest & np.uint64((1 << 16 * c) - 1)) == 0
        value[at[stop]] = same
        go = ~stop
        at, x, y = at[go], x[go] + lanes, y[go] + lanes
        k += lanes
    i = np.arange(n, dtype=np.int32)
    from_ = np.maximum.accumulate(np.where(reducible, np.int32(0), i))
    return np.maximum(value[from_] - (i - from_), 0)
