"""Suffix arrays of a shard by induced sorting, in array operations.

Suffixes are classified as S (smaller than the next suffix) or L. The substrings
between leftmost S suffixes (LMS) are sorted and named, the string of names is
sorted by naming pairs of names again and again, and the order of all other
suffixes is induced from that of the LMS suffixes in one scan over the buckets of
first letters upwards (L) and one downwards (S).

``depth`` bounds how far suffixes are told apart: suffixes that agree on that many
letters may come in any order, and nothing else is affected.
"""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """True for S suffixes; the last letter must be the one smallest."""
    n = len(t)
    s = np.ones(n, bool)
    if n > 1:
        differs = t[:-1] != t[1:]
        at = np.where(differs, np.arange(n - 1), n - 1)
        at = np.minimum.accumulate(at[::-1])[::-1]
        s[:-1] = np.append(t[:-1] < t[1:], True)[at]
    return s


def _name(t: np.ndarray, lms: np.ndarray, letters: int) -> np.ndarray:
    """Place of each LMS substring's class: how many LMS substrings are smaller.

    A substring that ends where another goes on is the larger one (its last letter is
    S, the other's L), hence the filling beyond its end.
    """
    bits = int(letters + 1).bit_length()
    per = 63 // bits
    end = np.append(lms[1:], lms[-1:]) + 1
    padded = np.append(t, np.zeros(per + 1, t.dtype))
    place = np.zeros(len(lms), np.int64)
    todo, at = np.arange(len(lms)), lms.copy()
    while len(todo):
        key = np.zeros(len(todo), np.int64)
        for k in range(per):
            p = at[todo] + k
            key = (key << bits) | np.where(p < end[todo], padded[np.minimum(p, len(t))], letters + 1)
        todo, same = _split(place, todo, key)
        at[todo] += per
        todo = todo[same & (at[todo] < end[todo])]
    return place


def _split(place: np.ndarray, todo: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orders ``todo`` by (place, key) and refines ``place``; also tells which still share theirs."""
    order = np.lexsort((key, place[todo]))
    todo, key = todo[order], key[order]
    old = place[todo]
    at = np.arange(len(todo))
    first_old = np.append(True, old[1:] != old[:-1])
    first_new = first_old | np.append(True, key[1:] != key[:-1])
    start_old = np.maximum.accumulate(np.where(first_old, at, 0))
    start_new = np.maximum.accumulate(np.where(first_new, at, 0))
    place[todo] = old + start_new - start_old
    return todo, ~(first_new & np.append(first_new[1:], True))


def _order_lms(t: np.ndarray, lms: np.ndarray, letters: int, depth: int) -> np.ndarray:
    """LMS positions in the order of their suffixes."""
    place = _name(t, lms, letters)
    n, step = len(lms), 1
    counts = np.bincount(place, minlength=n)
    todo = np.flatnonzero(counts[place] > 1)
    while len(todo) and 2 * step <= depth:  # a name spans two letters at least
        ahead = np.append(place, np.full(step, -1))[todo + step]
        todo, same = _split(place, todo, ahead)
        todo = todo[same]
        step *= 2
    return lms[np.argsort(place, kind="stable")]


def suffix_array(t: np.ndarray, letters: int, depth: int = 1 << 62) -> np.ndarray:
    """Sorted suffixes of ``t``, whose values are under ``letters`` and end with a 0 that is there once."""
    n = len(t)
    if n < 3:
        return np.arange(n)[::-1].copy()
    s = classify(t)
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    order = _order_lms(t, lms, letters, depth)
    counts = np.bincount(t, minlength=letters)
    ends = np.cumsum(counts)
    starts = ends - counts
    sa = np.full(n, -1, np.int64)
    first = t[order]
    n_lms = np.bincount(first, minlength=letters)
    before = np.cumsum(n_lms) - n_lms
    lms_of = [order[before[c] : before[c] + n_lms[c]] for c in range(letters)]
    used = np.flatnonzero(counts)
    narrow = t.astype(np.uint16) if letters <= 1 << 16 else t

    def put(found: np.ndarray, head: np.ndarray, up: bool) -> None:
        c = narrow[found]
        by = np.argsort(c, kind="stable")
        c, found = c[by], found[by]
        many = np.bincount(c, minlength=letters)
        offset = np.arange(len(c)) - (np.cumsum(many) - many)[c]
        if up:
            sa[head[c] + offset] = found
            head += many
        else:
            sa[head[c] - 1 - offset] = found
            head -= many

    def induce(batch: np.ndarray, kind: bool, head: np.ndarray, up: bool) -> None:
        j = batch[batch > 0] - 1
        j = j[s[j] == kind]
        if len(j):
            put(j, head, up)

    head = starts.copy()
    for c in used:
        done = starts[c]
        while done < head[c]:
            upto = head[c]
            induce(sa[done:upto].copy(), False, head, True)
            done = upto
        induce(lms_of[c], False, head, True)
    l_end, tail = head, ends.copy()
    sa[0] = n - 1
    for c in used[::-1]:
        done = ends[c]
        while done > tail[c]:
            downto = tail[c]
            induce(sa[downto:done][::-1].copy(), True, tail, False)
            done = downto
        induce(sa[starts[c] : l_end[c]][::-1].copy(), True, tail, False)
    sa[0] = n - 1
    return sa


def words(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; beyond the end, zeros."""
    p = np.append(t, np.zeros(8, t.dtype)).astype(np.uint64)
    out = np.zeros(len(t), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | p[k : k + len(t)]
    return out


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, among: np.ndarray, upto: int) -> np.ndarray:
    """By place in the text: length of the prefix shared with the suffix before it in ``sa``.

    In steps of eight letters and only as far as ``upto`` (a multiple of eight); only
    between places of ``among``, all others get 0.
    """
    out = np.zeros(len(t), np.int64)
    w = np.append(words(t), np.zeros(upto, np.uint64))
    ok = among[sa[1:]] & among[sa[:-1]]
    a, b = sa[1:][ok], sa[:-1][ok]
    for d in range(0, upto, 8):
        same = w[a + d] == w[b + d]
        a, b = a[same], b[same]
        out[a] = d + 8
    return out
