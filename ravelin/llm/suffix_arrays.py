"""Suffix arrays by induced sorting, and longest common prefixes, vectorised with numpy.

``suffix_array`` follows the induced-sorting scheme: suffixes are classified as
smaller or larger than their right neighbour, leftmost-smaller (LMS) substrings
are sorted by packed keys and named, the string of names is sorted recursively by
the same scheme, and an induction derives all suffixes from the LMS ones.
An induction step takes a run of buckets at once: all up to the first one that
the run itself would still add to. Their predecessors are dealt to their buckets
by one stable sort, so Python runs once for each such run, not for each suffix.
A bucket that adds to itself is taken in waves. Small alphabets have runs of one
bucket; the many names of a recursion have runs of about the root of their number.
"""

from __future__ import annotations

import numpy as np


def smaller_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one. The last symbol is the one smallest."""
    n = len(s)
    out = np.zeros(n, bool)
    turns = np.flatnonzero(s[:-1] != s[1:])
    out[: turns[-1] + 1 if len(turns) else 0] = np.repeat(s[turns] < s[turns + 1], np.diff(np.concatenate(([-1], turns))))
    out[-1] = True
    return out


def _dealt(chars: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by symbol, the symbols, where each begins in that order, and their counts."""
    order = (chars.astype(np.uint16) if small else chars).argsort(kind="stable")
    chars = chars[order]
    new = np.empty(len(chars), bool)
    new[0] = True
    np.not_equal(chars[1:], chars[:-1], out=new[1:])
    cut = new.nonzero()[0]
    counts = np.empty(len(cut), np.int64)
    counts[:-1] = cut[1:] - cut[:-1]
    counts[-1] = len(chars) - cut[-1]
    return order, chars[cut], cut, counts


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Indices of ranges [first, last), one after the other."""
    sizes = last - first
    before = sizes.cumsum() - sizes
    return (first - before).repeat(sizes) + np.arange(sizes.sum())


def _down(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The same, each range from its end."""
    sizes = last - first
    before = sizes.cumsum() - sizes
    return (last - 1 + before).repeat(sizes) - np.arange(sizes.sum())


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(2 * len(a), np.int64)
    out[0::2], out[1::2] = a, b
    return out


def induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, alphabet: int) -> np.ndarray:
    """All suffixes, in the order that the given order of LMS suffixes implies."""
    n, small = len(s), alphabet < 1 << 16  # sixteen bits are sorted by radix
    sizes = np.bincount(s, minlength=alphabet)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    sa = np.full(n, -1, np.int64)
    order, symbols, cut, counts = _dealt(s[lms], small)
    lms_from = ends.copy()
    lms_from[symbols] -= counts
    sa[(lms_from[symbols] - cut).repeat(counts) + np.arange(len(lms))] = lms[order]
    present = np.flatnonzero(sizes)
    place = np.zeros(alphabet, np.int64)  # of a symbol among those present
    place[present] = np.arange(len(present))
    head = starts.copy()

    def forward(wave: np.ndarray) -> None:
        """Deal the predecessors of larger type that suffixes in order induce."""
        order, symbols, cut, counts = _dealt(s[wave], small)
        sa[(head[symbols] - cut).repeat(counts) + np.arange(len(wave))] = wave[order]
        head[symbols] += counts

    def larger(wave: np.ndarray) -> np.ndarray:
        p = wave[wave > 0] - 1
        return p[~smaller[p]]

    at, run = 0, 1
    while at < len(present):
        some = present[at : at + run]
        # Of each bucket: larger suffixes so far, then LMS ones.
        inner, outer = _paired(starts[some], lms_from[some]), _paired(head[some], ends[some])
        found = sa[_ranges(inner, outer)]
        p = larger(found)
        reach = int(place[s[p].min()]) if len(p) else len(present)
        if reach > at:  # buckets before ``reach`` are complete
            upto = min(reach, at + len(some))
            if upto < at + len(some):
                k = 2 * (upto - at)
                p = larger(found[: int((outer[:k] - inner[:k]).sum())])
            if len(p):
                forward(p)
            run = min(2 * run, len(present)) if upto == at + run else max(1, upto - at)
            at = upto
            continue
        c, done = present[at], starts[present[at]]
        while done < head[c]:
            to = head[c]
            p = larger(sa[done:to])
            if len(p):
                forward(p)
            done = to
        p = larger(sa[lms_from[c] : ends[c]])
        if len(p):
            forward(p)
        at += 1
    larger_to = head
    tail = ends.copy()

    def backward(wave: np.ndarray) -> None:
        order, symbols, cut, counts = _dealt(s[wave], small)
        sa[(tail[symbols] - 1 + cut).repeat(counts) - np.arange(len(wave))] = wave[order]
        tail[symbols] -= counts

    def lesser(wave: np.ndarray) -> np.ndarray:
        p = wave[wave > 0] - 1
        return p[smaller[p]]

    tail[s[-1]] -= 1  # the last symbol's own suffix stays first of all
    sa[0] = n - 1
    at, run = len(present) - 1, 1
    while at >= 0:
        some = present[max(0, at - run + 1) : at + 1][::-1]
        # From the end: smaller suffixes so far, then larger ones.
        inner, outer = _paired(tail[some], starts[some]), _paired(ends[some], larger_to[some])
        found = sa[_down(inner, outer)]
        p = lesser(found)
        reach = int(place[s[p].max()]) if len(p) else -1
        if reach < at:
            downto = max(reach, at - len(some))
            if downto > at - len(some):
                k = 2 * (at - downto)
                p = lesser(found[: int((outer[:k] - inner[:k]).sum())])
            if len(p):
                backward(p)
            run = min(2 * run, len(present)) if downto == at - run else max(1, at - downto)
            at = downto
            continue
        c, done = present[at], ends[present[at]]
        while tail[c] < done:
            to = tail[c]
            p = lesser(sa[to:done][::-1])
            if len(p):
                backward(p)
            done = to
        p = lesser(sa[starts[c] : larger_to[c]][::-1])
        if len(p):
            backward(p)
        at -= 1
    return sa


def _named(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray, int]:
    """LMS substrings in order, their names in text order, and how many names there are.

    A substring is its symbols with their types, up to the next LMS place. As many
    as fit are packed into one key; those that tie and go on get the next key.
    """
    typed = 2 * s + smaller + 1  # 0 stands behind a substring's end
    bits = max(1, int(2 * alphabet + 1).bit_length())
    per_key = max(1, 63 // bits)
    size = np.ones(len(lms), np.int64)
    size[:-1] = np.diff(lms) + 1
    typed = np.append(typed, np.zeros(per_key, np.int64))

    def keys(rows: np.ndarray, at: int) -> np.ndarray:
        out = np.zeros(len(rows), np.int64)
        for k in range(at, at + per_key):
            out = (out << bits) | np.where(size[rows] > k, typed[np.minimum(lms[rows] + k, len(typed) - 1)], 0)
        return out

    rows, at = np.arange(len(lms)), 0
    key = keys(rows, 0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    while True:
        at += per_key
        group = np.cumsum(new) - 1
        goes_on = size[order] > at  # equal so far, so all of a group go on or none
        open_rows = np.flatnonzero(goes_on & (np.bincount(group)[group] > 1))
        if not len(open_rows):
            break
        which = order[open_rows]
        key = keys(which, at)
        turn = np.lexsort((key, group[open_rows]))
        order[open_rows] = which[turn]
        key, own = key[turn], group[open_rows]
        changed = np.zeros(len(open_rows), bool)
        changed[1:] = (own[1:] == own[:-1]) & (key[1:] != key[:-1])
        new[open_rows] |= changed
    names = np.empty(len(lms), np.int64)
    names[order] = np.cumsum(new) - 1
    return lms[order], names, int(new.sum())


def suffix_array(s: np.ndarray, alphabet: int) -> np.ndarray:
    """Starts of suffixes in order. ``s`` must end with its one smallest symbol, 0."""
    if len(s) <= 2:
        return np.arange(len(s))[::-1].copy()
    smaller = smaller_types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    in_order, names, n = _named(s, smaller, lms, alphabet)
    if n < len(lms):
        in_order = lms[suffix_array(names, n)]
    return induce(s, smaller, in_order, alphabet)


def common_prefixes(s: np.ndarray, sa: np.ndarray, limit: int, restart: np.ndarray) -> np.ndarray:
    """For each suffix array row, the prefix shared with the row before, up to ``limit``.

    Permuted: computed in text order. A position whose left neighbour extends
    the match is *reducible*: its value is its neighbour's less one. The others,
    and those in ``restart``, are compared directly.
    """
    n = len(s)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    at = np.arange(n)
    direct = np.ones(n, bool)
    inner = at[1:][(before[1:] > 0) & (before[:-1] >= 0)]
    direct[inner] = s[inner - 1] != s[before[inner] - 1]
    direct[restart] = True
    rows = np.flatnonzero(direct & (before >= 0))
    padded = np.concatenate((s.astype(np.int32), np.full(limit + 1, -1, np.int32)))
    length = np.zeros(n, np.int64)
    a, b, left, shared = rows, before[rows], np.arange(len(rows)), 0
    values = np.zeros(len(rows), np.int64)
    while len(left) and shared < limit:
        same = padded[a[left] + shared] == padded[b[left] + shared]
        values[left[~same]] = shared
        left = left[same]
        shared += 1
    values[left] = limit
    length[rows] = values
    origin = np.maximum.accumulate(np.where(direct, at, 0))
    plcp = np.maximum(length[origin] - (at - origin), 0)
    plcp[before < 0] = 0
    return plcp[sa]
