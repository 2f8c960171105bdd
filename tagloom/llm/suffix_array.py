"""Suffix arrays by induced sorting, and permuted common prefixes.

The text is an integer array that ends with a 0 found nowhere else. Suffixes are classed as smaller
(S) or larger (L) than their successor; the substrings between leftmost S suffixes are sorted and
named, the string of names is solved recursively where names repeat, and an induction from the sorted
leftmost S suffixes gives the whole order. Where the alphabet is small the substrings are sorted by an
induction too, and inductions move whole runs of a bucket at once; the strings of names, at most half
as long at each level, have their substrings sorted place by place and are induced entry by entry.
"""

from __future__ import annotations

import numpy as np

SMALL_ALPHABET = 1024


def smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is of class S."""
    n = len(t)
    differs = np.flatnonzero(t[:-1] != t[1:])
    out = np.ones(n, bool)
    nearest = differs[np.searchsorted(differs, np.arange(n - 1))]
    out[:-1] = t[nearest] < t[nearest + 1]
    return out


def _grouped(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by character, the characters in it, and each one's number among its equals."""
    order = np.argsort(chars, kind="stable")
    chars = chars[order]
    firsts = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
    within = np.arange(len(chars)) - np.repeat(firsts, np.diff(np.append(firsts, len(chars))))
    return order, chars, within


def _induced_runs(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(len(t), -1, np.int64)
    order, chars, within = _grouped(t[lms])
    held = np.bincount(chars, minlength=len(sizes))
    first_lms = ends - held
    sa[first_lms[chars] + within] = lms[order]
    used = np.flatnonzero(sizes).tolist()
    head, tail = starts.copy(), ends.copy()

    def larger(found: np.ndarray) -> None:
        j = found[found > 0] - 1
        j = j[~is_s[j]]
        if len(j):
            order, chars, within = _grouped(t[j])
            sa[head[chars] + within] = j[order]
            np.add.at(head, chars, 1) if len(j) < 32 else np.add(head, np.bincount(chars, minlength=len(head)), out=head)

    for c in used:
        low = starts[c]
        while low < head[c]:
            low, found = head[c], sa[low : head[c]]
            larger(found)
        larger(sa[first_lms[c] : ends[c]])

    def lesser(found: np.ndarray) -> None:
        j = found[found > 0] - 1
        j = j[is_s[j]]
        if len(j):
            order, chars, within = _grouped(t[j])
            sa[tail[chars] - 1 - within] = j[order]
            np.subtract(tail, np.bincount(chars, minlength=len(tail)), out=tail)

    sa[0], tail[0] = len(t) - 1, 0
    for c in reversed(used):
        high = ends[c]
        while tail[c] < high:
            high, found = tail[c], sa[tail[c] : high][::-1]
            lesser(found)
        lesser(sa[starts[c] : head[c]][::-1])
    return sa


def _induced_entries(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    head, last, n = (ends - sizes).tolist(), ends.tolist(), len(t)
    order, chars, within = _grouped(t[lms])
    placed = np.full(n, -1, np.int64)
    placed[(ends - np.bincount(chars, minlength=len(sizes)))[chars] + within] = lms[order]
    # the symbol before each suffix where that is of the class induced, else -1; entry n is for empty places
    larger, lesser = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
    larger[1:n] = np.where(is_s[:-1], -1, t[:-1])
    lesser[1:n] = np.where(is_s[:-1], t[:-1], -1)
    sa, before = placed.tolist(), larger.tolist()
    for j in sa:  # sees what it places ahead of itself
        c = before[j]
        if c >= 0:
            sa[head[c]] = j - 1
            head[c] += 1
    sa[0], before = n - 1, lesser.tolist()
    for j in reversed(sa):
        c = before[j]
        if c >= 0:
            at = last[c] = last[c] - 1
            sa[at] = j - 1
    return np.array(sa, np.int64)


def _refined(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The leftmost-S substrings' starts in order, by sorting their symbols and classes one place at a time.

    No such substring is a proper prefix of another, so equal ones end together.
    """
    code = 2 * t + is_s
    length = np.append(lms[1:], len(t) - 1) - lms
    order = np.argsort(code[lms], kind="stable")
    ordered = code[lms[order]]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    step = 1
    while True:
        begins = np.flatnonzero(new)
        sizes = np.diff(np.append(begins, len(new)))
        group = np.repeat(np.arange(len(begins)), sizes)
        open_ = np.flatnonzero(np.repeat(sizes > 1, sizes) & (length[order] >= step))
        if not len(open_):
            return lms[order]
        symbols = code[lms[order[open_]] + step]
        sub = np.lexsort((symbols, group[open_]))
        order[open_] = order[open_][sub]
        symbols, owner = symbols[sub], group[open_]
        new[open_[1:]] |= (symbols[1:] != symbols[:-1]) | (owner[1:] != owner[:-1])
        step += 1


def _names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """The rank of each leftmost-S substring, equal ones alike, in the order given."""
    after = np.zeros(len(t), np.int64)
    after[lms] = np.append(lms[1:], len(t) - 1) - lms
    a, b = ordered[:-1], ordered[1:]
    length = after[a]
    same = (length == after[b]) & (t[a] == t[b])
    left = np.flatnonzero(same)
    step = 1
    while len(left):
        left = left[length[left] >= step]
        equal = t[a[left] + step] == t[b[left] + step]
        same[left[~equal]] = False
        left = left[equal]
        step += 1
    # the substring of the closing 0 is alone
    same[0] = False
    return np.concatenate([[0], np.cumsum(~same)])


def suffix_array(t: np.ndarray, sigma: int) -> np.ndarray:
    """The starts of the suffixes of ``t`` in order; ``t`` holds 0 at its end and nowhere else."""
    if len(t) == 1:
        return np.zeros(1, np.int64)
    induced = _induced_runs if sigma <= SMALL_ALPHABET else _induced_entries
    is_s = smaller(t)
    is_lms = np.zeros(len(t), bool)
    is_lms[1:] = is_s[1:] & ~is_s[:-1]
    lms = np.flatnonzero(is_lms)
    sizes = np.bincount(t, minlength=sigma)
    if len(lms) > 1:
        if sigma <= SMALL_ALPHABET:
            first = induced(t, is_s, lms, sizes)
            ordered = first[is_lms[first]]
        else:
            ordered = _refined(t, is_s, lms)
        names = _names(t, lms, ordered)
        if names[-1] + 1 < len(lms):
            by_place = np.empty(len(t), np.int64)
            by_place[ordered] = names
            lms = lms[suffix_array(by_place[lms], int(names[-1]) + 1)]
        else:
            lms = ordered
    return induced(t, is_s, lms, sizes)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place, the common prefix of its suffix with the one before it in order.

    Only irreducible values are compared, four symbols at a time; every other value is one less
    than that of the place before it.
    """
    n = len(t)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    padded = np.concatenate([t, np.zeros(4, t.dtype)]).astype(np.uint64)
    words = padded[:n] | padded[1 : n + 1] << np.uint64(16) | padded[2 : n + 2] << np.uint64(32) | padded[3 : n + 3] << np.uint64(48)
    bound = np.ones(n, bool)
    bound[1:] = (before[1:] <= 0) | (t[:-1] != t[before[1:] - 1])
    places = np.flatnonzero(bound)
    length = np.zeros(n, np.int64)
    a = places[before[places] >= 0]
    i, j = a, before[a]
    while len(a):
        x = np.minimum(i, n - 1), np.minimum(j, n - 1)
        equal = words[x[0]] == words[x[1]]
        done = ~equal
        apart = words[x[0][done]] ^ words[x[1][done]]
        length[a[done]] = i[done] - a[done] + np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)) // 16
        a, i, j = a[equal], i[equal] + 4, j[equal] + 4
    owner = places[np.searchsorted(places, np.arange(n), "right") - 1]
    return length[owner] - (np.arange(n) - owner)
