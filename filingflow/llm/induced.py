"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour. The leftmost-smaller (LMS) substrings are
sorted and named; where names repeat, the string of names is sorted by the same function. All other suffixes are then
induced from the sorted LMS suffixes in two linear scans; the LMS substrings are sorted by the same scans. Over a small
alphabet a scan takes a whole bucket at a time: what a bucket induces into itself comes as further waves of the same bucket.
Over the large alphabet of names a scan takes one suffix at a time.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are scanned by buckets.
SMALL = 2048


def _types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its right neighbour; the last one, the sentinel, is."""
    n = len(s)
    smaller = np.ones(n, bool)
    if n > 1:
        step = np.diff(s)
        at = np.where(step != 0, np.arange(n - 1), n - 2)
        at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ; the sentinel is below all
        smaller[:-1] = step[at] > 0
    return smaller


def _put(out: np.ndarray, suffixes: np.ndarray, symbols: np.ndarray, edge: np.ndarray, down: bool) -> None:
    """Place suffixes, in this order, at the edges of the buckets of their first symbols, and move the edges."""
    order = np.argsort(symbols, kind="stable")
    symbols, suffixes = symbols[order], suffixes[order]
    first = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1]]))
    size = np.diff(np.append(first, len(symbols)))
    within = np.arange(len(symbols)) - np.repeat(first, size)
    if down:
        out[edge[symbols] - 1 - within] = suffixes
        edge[symbols[first]] -= size
    else:
        out[edge[symbols] + within] = suffixes
        edge[symbols[first]] += size


def _induce_buckets(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    size = np.bincount(s, minlength=k)
    end = np.cumsum(size)
    start = end - size
    out = np.empty(len(s), np.int32 if len(s) < 1 << 31 else np.int64)
    head, tail = start.copy(), end.copy()
    cut = np.searchsorted(s[lms], np.arange(k + 1).astype(s.dtype))  # the LMS suffixes come in the order of their first symbols

    def take(suffixes: np.ndarray, want: bool) -> None:
        before = suffixes[suffixes > 0] - 1
        before = before[smaller[before] == want]
        if len(before):
            _put(out, before, s[before], tail if want else head, want)

    used = np.flatnonzero(size)
    for c in used:
        at = start[c]
        while at < head[c]:
            at, seen = head[c], at
            take(out[seen:at], False)
        if cut[c] < cut[c + 1]:
            take(lms[cut[c] : cut[c + 1]], False)
    tail[s[-1]] -= 1
    out[tail[s[-1]]] = len(s) - 1
    for c in used[::-1]:
        at = end[c]
        while at > tail[c]:
            at, seen = tail[c], at
            take(out[at:seen][::-1], True)
        if start[c] < head[c]:
            take(out[start[c] : head[c]][::-1], True)
    return out


def _induce_one_by_one(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    n = len(s)
    size = np.bincount(s, minlength=k)
    end = np.cumsum(size)
    head, tail, edge = (end - size).tolist(), end.tolist(), end.tolist()
    own = s.tolist()
    # the left neighbour of each suffix if it is of type L, or S, else -1; so has -1, an empty place
    left = np.arange(-1, n)
    left[-1] = -1
    large = np.where((left >= 0) & ~smaller[left], left, -1).tolist()
    small = np.where((left >= 0) & smaller[left], left, -1).tolist()
    out = [-1] * n
    for i in reversed(lms.tolist()):
        edge[own[i]] -= 1
        out[edge[own[i]]] = i
    for i in out:  # what is placed further on is met later in the same loop
        j = large[i]
        if j >= 0:
            c = own[j]
            h = head[c]
            out[h] = j
            head[c] = h + 1
    for i in reversed(out):
        j = small[i]
        if j >= 0:
            c = own[j]
            h = tail[c] - 1
            out[h] = j
            tail[c] = h
    out[0] = n - 1
    return np.array(out, np.int64)


def _names(s: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """A name for each LMS substring, in text order: equal ones share a name, and names are in sorted order."""
    following = np.append(lms[1:], lms[-1])
    length = np.zeros(len(s), np.int64)
    length[lms] = following - lms + 1
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        equal = s[a[live] + k] == s[b[live] + k]
        same[live[~equal]] = False
        live = live[equal]
        k += 1
        live = live[length[a[live]] > k]
    name = np.empty(len(s), np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms]


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """The starts of the suffixes of ``s`` in sorted order. Symbols are below ``k``; the last is a 0 that occurs once."""
    s = np.asarray(s)
    if len(s) == 1:
        return np.zeros(1, np.int64)
    smaller = _types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    induce = _induce_buckets if k <= SMALL else _induce_one_by_one
    if k <= SMALL:
        s = s.astype(np.uint16)  # such symbols are sorted by radix
    if len(lms) > 1:
        by_symbol = lms[np.argsort(s[lms], kind="stable")]
        marked = np.zeros(len(s), bool)
        marked[lms] = True
        ordered = induce(s, smaller, by_symbol, k)
        name = _names(s, lms, ordered[marked[ordered]])
        top = int(name.max()) + 1
        lms = lms[suffix_array(name, top) if top < len(lms) else np.argsort(name)]
    return induce(s, smaller, lms, k)


def common_prefixes(s: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, before): for every place of the text, in text order, the length of the longest common prefix of its suffix
    and the suffix before it in sorted order, and where that one starts (the first suffix has itself and 0).

    Where the symbols left of the two agree, the prefix is one shorter than that of the place to the left; only the other
    places are compared, four symbols at a time.
    """
    n = len(s)
    before = np.empty(n, np.int64)
    before[order[0]] = order[0]
    before[order[1:]] = order[:-1]
    wide = np.concatenate([s, np.zeros(4, s.dtype)]).astype(np.uint64)
    four = wide[:n] | wide[1 : n + 1] << np.uint64(16) | wide[2 : n + 2] << np.uint64(32) | wide[3 : n + 3] << np.uint64(48)
    fresh = np.ones(n, bool)
    fresh[1:] = (s[:-1] != s[before[1:] - 1]) | (before[1:] == 0) | (before[:-1] == np.arange(n - 1))
    fresh[order[0]] = True
    at = np.flatnonzero(fresh)
    found = np.zeros(len(at), np.int64)
    live = np.flatnonzero(before[at] != at)
    i, j = at[live], before[at[live]]
    while len(live):
        equal = four[i] == four[j]
        stop = live[~equal]
        differ = four[i[~equal]] ^ four[j[~equal]]
        found[stop] += ((differ & np.uint64(0xFFFF)) == 0).astype(np.int64) + ((differ & np.uint64(0xFFFFFFFF)) == 0) + ((differ & np.uint64(0xFFFFFFFFFFFF)) == 0)
        live, i, j = live[equal], i[equal] + 4, j[equal] + 4
        found[live] += 4
    last = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    value = np.zeros(n, np.int64)
    value[at] = found
    return np.maximum(value[last] - (np.arange(n) - last), 0), before
