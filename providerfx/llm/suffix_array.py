"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified by whether they are smaller than the next one. The substrings between leftmost-smaller places
are sorted, several characters at a time, and named; if names repeat, the string of names is sorted the same way,
recursively. All suffixes are then induced from the leftmost-smaller ones, by one scan over the array in each direction.
A scan takes as many entries at a time as are final, that is, up to the first place that they themselves fill, for any
alphabet.
"""

from __future__ import annotations

import numpy as np

from providerfx.llm.words import load

#: Entries that a scan tries to take at a time, at least and at first.
STEP = 64


def classify(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; t ends with a unique smallest character."""
    up = np.zeros(len(t), bool)
    d = np.diff(t)
    differs = np.flatnonzero(d)
    up[:-1] = d[differs[np.searchsorted(differs, np.arange(len(d)))]] > 0
    up[-1] = True
    return up


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    new = np.empty(len(values) + 1, bool)
    new[0] = new[-1] = True
    np.not_equal(values[1:], values[:-1], out=new[1:-1])
    edge = new.nonzero()[0]
    return edge[:-1], edge[1:] - edge[:-1]


def scan(sa: np.ndarray, t: np.ndarray, kind: np.ndarray, place: np.ndarray) -> None:
    """Fill in the predecessors of the entries of sa that are of this kind, from its start on; place: the next place of each character."""
    n, at, step = len(sa), 0, STEP
    while at < n:
        z = min(n, at + step)
        cur = sa[at:z]
        prev = cur - 1
        own = ((cur > 0) & kind[prev]).nonzero()[0]
        if not len(own):
            at, step = z, 2 * step
            continue
        prev = prev[own]
        c = t[prev]
        order = c.argsort(kind="stable")
        c = c[order]
        first, size = runs(c)
        to = place[c[first]]
        end = min(z, int(to.min()))
        if end < z:  # entries from there on are not final yet; of each character the first ones are kept
            keep = (own[order] < end - at).nonzero()[0]
            order, c = order[keep], c[keep]
            first, size = runs(c)
            to = place[c[first]]
        sa[(to - first).repeat(size) + np.arange(len(c))] = prev[order]
        place[c[first]] = to + size
        step = max(STEP, 2 * (end - at)) if end < z else 2 * step
        at = end


def induced(t: np.ndarray, up: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, induced from the leftmost-smaller ones (`lms`) in their order."""
    n, count = len(t), np.bincount(t, minlength=size)
    ends = np.cumsum(count)
    sa = np.full(n, -1, np.int32)
    c = t[lms]
    order = c.argsort(kind="stable")
    first, many = runs(c[order])
    sa[(ends[c[order][first]] - many - first).repeat(many) + np.arange(len(c))] = lms[order]
    scan(sa, t, ~up, ends - count)
    sa[(sa >= 0) & up[sa]] = -1
    scan(sa[::-1], t, up, n - ends)
    sa[0] = n - 1
    return sa


def names_of(t: np.ndarray, up: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """How many of the substrings from one leftmost-smaller place up to and with the next are smaller than each.

    Characters are compared with their class; then no substring is the beginning of another one.
    """
    symbol = 2 * t.astype(np.int64) + up + 1
    bits = int(2 * size + 1).bit_length()
    step = 63 // bits
    left = np.append(np.diff(lms) + 1, 1)
    rank, active, k = np.zeros(len(lms), np.int64), np.arange(len(lms)), 0
    while len(active):
        word = np.zeros(len(active), np.int64)
        for j in range(k, k + step):
            at = lms[active] + j
            word = (word << bits) | np.where(left[active] > j, symbol[np.minimum(at, len(t) - 1)], 0)
        order = word.argsort(kind="stable") if not k else np.lexsort((word, rank[active]))
        word, active = word[order], active[order]
        old = rank[active]
        group, many = runs(old)
        new = np.concatenate([[True], (word[1:] != word[:-1]) | (old[1:] != old[:-1])]).nonzero()[0]
        same = np.diff(np.append(new, len(active)))
        rank[active] = old + new.repeat(same) - group.repeat(many)
        k += step
        active = active[(same > 1).repeat(same) & (left[active] > k)]
    return rank


def ordered(t: np.ndarray, size: int) -> np.ndarray:
    """All suffixes of t in order; its characters are below `size`, the last is the only 0."""
    if len(t) == 1:
        return np.zeros(1, np.int64)
    t = t.astype(np.int16 if size <= 1 << 15 else np.int32)  # short characters are sorted by radix
    up = classify(t)
    lms = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    rank = names_of(t, up, lms, size)
    found, name = np.unique(rank, return_inverse=True)
    by = rank.argsort() if len(found) == len(lms) else ordered(name, len(found))
    return induced(t, up, lms[by], size)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a byte string in order."""
    t = np.zeros(len(s) + 1, np.int32)
    t[:-1] = s.astype(np.int32) + 1
    return ordered(t, int(t.max()) + 1)[1:]


def permuted_prefixes(s: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For every start in `order`, by position: bytes it shares with the start before it in order, at most `limit`.

    Bytes beyond the end of s count as zero bytes.
    """
    pad = np.concatenate([s, np.zeros(limit + 16, np.uint8)])
    eight = load(pad)
    out = np.zeros(len(s), np.int32)
    if len(order) < 2:
        return out
    p, q, k = order[1:].astype(np.int64), order[:-1].astype(np.int64), 0
    while p.size and k < limit:
        x = eight[p + k] ^ eight[q + k]
        stop = x != 0
        low = x[stop] & (~x[stop] + np.uint64(1))
        out[p[stop]] = np.minimum(k + np.log2(low.astype(np.float64)).astype(np.int64) // 8, limit)
        p, q, k = p[~stop], q[~stop], k + 8
    out[p] = limit
    return out
