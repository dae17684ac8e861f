"""Suffix arrays of byte shards by induced sorting, and permuted common prefixes.

Suffixes are classified; the leftmost-smaller (LMS) substrings are sorted and named; if names repeat, the
string of names is sorted recursively; the order of the LMS suffixes then induces that of all others. At the
byte level induction works bucket by bucket on whole arrays: a bucket's suffixes induce their left neighbours
in one stable sort by symbol, which keeps the order of the sequential scan. Strings of names, with their
large alphabets, are scanned one by one.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def smaller_types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its right neighbour; the last symbol is the unique smallest."""
    n = len(t)
    up = np.append(t[1:] > t[:-1], True)
    at = np.where(t[1:] != t[:-1], np.arange(n - 1, dtype=np.int32), np.int32(n - 1))
    out = np.ones(n, bool)
    out[:-1] = up[np.minimum.accumulate(at[::-1])[::-1]]
    return out


def induce(t: np.ndarray, small: np.ndarray, seeds: list[np.ndarray], size: int) -> tuple[list, list]:
    """Larger-type and smaller-type suffixes per bucket, from the LMS seeds of each bucket in order."""
    n = len(t)

    def push(into: list[list], rows: np.ndarray, want: bool) -> None:
        left = rows[rows > 0] - 1
        left = left[small[left] == want]
        if not len(left):
            return
        c = t[left]
        order = np.argsort(c, kind="stable")
        left, c = left[order], c[order]
        cuts = np.flatnonzero(np.diff(c)) + 1
        for part, first in zip(np.split(left, cuts), np.concatenate([[0], cuts])):
            into[c[first]].append(part)

    larger: list[list] = [[] for _ in range(size)]
    for c in range(size):
        i = 0
        if len(larger[c]) > 1:
            larger[c] = [np.concatenate(larger[c])]
        while i < len(larger[c]):
            push(larger, larger[c][i], False)
            i += 1
        if len(seeds[c]):
            push(larger, seeds[c], False)
    up = [np.concatenate(x) if x else np.zeros(0, np.int32) for x in larger]
    smaller: list[list] = [[] for _ in range(size)]
    smaller[0].append(np.array([n - 1], np.int32))
    for c in range(size - 1, -1, -1):
        i = 0
        if len(smaller[c]) > 1:
            smaller[c] = [np.concatenate(smaller[c])]
        while i < len(smaller[c]):
            push(smaller, smaller[c][i], True)
            i += 1
        if len(up[c]):
            push(smaller, up[c][::-1], True)
    return up, [np.concatenate(x)[::-1] if x else np.zeros(0, np.int32) for x in smaller]


def by_bucket(t: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    c = t[rows]
    order = np.argsort(c, kind="stable")
    return np.split(rows[order], np.searchsorted(c[order], np.arange(1, size)))


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of symbols below ``size``; the last symbol is 0 and occurs nowhere else."""
    used = np.flatnonzero(np.bincount(t, minlength=size))
    number = np.zeros(size, np.uint8 if len(used) <= 256 else np.uint16)
    number[used] = np.arange(len(used))
    t, size = number[t], len(used)
    if len(t) == 1:
        return np.zeros(1, np.int32)
    small = smaller_types(t)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    names, count = name_substrings(t, small, lms)
    sorted_lms = lms[np.argsort(names) if count == len(lms) else sort_names(names)]
    up, low = induce(t, small, by_bucket(t, sorted_lms, size), size)
    return np.concatenate([x for pair in zip(up, low) for x in pair])


def name_substrings(s: np.ndarray, small: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the LMS substrings (equal ones alike), in text order, and how many different there are.

    Symbols count with their type, so no substring is the beginning of another. Only substrings that are
    still tied look at their next symbol.
    """
    symbol = 2 * s.astype(np.int32) + small
    end = np.append(lms[1:], lms[-1])
    order = np.argsort(symbol[lms], kind="stable")
    key = symbol[lms][order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    depth = 1
    while True:
        # groups of ties whose substrings go on (all of a group or none)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(order)))
        go = (size > 1) & (lms[order[first]] + depth <= end[order[first]])
        if not go.any():
            break
        at = np.repeat(first[go] - np.concatenate([[0], np.cumsum(size[go])[:-1]]), size[go]) + np.arange(size[go].sum())
        rows = order[at]
        group = np.repeat(np.arange(go.sum()), size[go])
        nxt = symbol[lms[rows] + depth]
        by = np.lexsort((nxt, group))
        order[at] = rows[by]
        group, nxt = group[by], nxt[by]
        new[at[1:]] |= nxt[1:] != nxt[:-1]
        depth += 1
    names = np.empty(len(lms), np.int64)
    names[order] = np.cumsum(new) - 1
    return names, int(new.sum())


def sort_names(s: np.ndarray) -> np.ndarray:
    """Suffix array of a string of names; the last name is 0 and occurs nowhere else."""
    if len(s) == 1:
        return np.zeros(1, np.int64)
    small = smaller_types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    names, count = name_substrings(s, small, lms)
    return scan(s, small, lms[np.argsort(names) if count == len(lms) else sort_names(names)])


def scan(s: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Suffix array from sorted LMS places by two sequential passes over integer symbols."""
    n = len(s)
    ends = np.cumsum(np.bincount(s))
    starts = np.concatenate([[0], ends[:-1]])
    sa = np.full(n, -1, np.int64)
    c = s[seeds]
    by = np.argsort(c, kind="stable")
    c, left = c[by], np.concatenate([[0], np.cumsum(np.bincount(c, minlength=len(ends)))])
    sa[ends[c] - left[c + 1] + np.arange(len(c))] = seeds[by]
    sa = sa.tolist()
    # symbol of the left neighbour if it is of the pass' type, else -1
    before = np.concatenate([[-1], s[:-1]])
    is_small = np.concatenate([[False], small[:-1]])
    larger, place = np.where(is_small, -1, before).tolist(), starts.tolist()
    for i in sa:
        if i > 0:
            c = larger[i]
            if c >= 0:
                p = place[c]
                sa[p] = i - 1
                place[c] = p + 1
    smaller, place = np.where(is_small, before, -1).tolist(), ends.tolist()
    for i in reversed(sa):
        if i > 0:
            c = smaller[i]
            if c >= 0:
                p = place[c] - 1
                sa[p] = i - 1
                place[c] = p
    sa[0] = n - 1
    return np.array(sa)


def words8(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one word (zeros beyond the end)."""
    w = raw.astype(np.uint64)
    for k in (1, 2, 4):
        nxt = np.zeros_like(w)
        nxt[:-k] = w[k:]
        w = w | nxt << U(8 * k)
    return w


def common_prefixes(raw: np.ndarray, sa: np.ndarray, rest: np.ndarray, most: int) -> np.ndarray:
    """Permuted common prefixes: for each place, the prefix shared with its predecessor in suffix order, up to
    ``most``. Only places with ``most`` bytes left on both sides (``rest``) are compared; others get 0."""
    n = len(raw)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int32)
    a = np.flatnonzero((before >= 0) & (rest >= most))
    a = a[rest[before[a]] >= most]
    b = before[a]
    w = words8(raw)
    for done in range(0, most, 8):
        x = w[a + done] ^ w[b + done]
        differ = x != 0
        low = x[differ] & (~x[differ] + U(1))
        out[a[differ]] = np.minimum(most, done + np.log2(low.astype(float)).astype(np.int32) // 8)
        a, b = a[~differ], b[~differ]
    out[a] = most
    return out


def common_symbols(t: np.ndarray, sa: np.ndarray, rest: np.ndarray, most: int) -> np.ndarray:
    """The same for strings of numbered symbols."""
    before = np.full(len(t), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(len(t), np.int32)
    a = np.flatnonzero((before >= 0) & (rest >= most))
    a = a[rest[before[a]] >= most]
    b = before[a]
    for done in range(most):
        same = t[a + done] == t[b + done]
        out[a[~same]] = done
        a, b = a[same], b[same]
    out[a] = most
    return out
