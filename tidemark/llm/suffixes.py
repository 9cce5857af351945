"""Suffix arrays by induced sorting and permuted common prefixes, vectorised with numpy.

Suffixes are classed as smaller or larger than their right neighbour. Leftmost-smaller substrings are sorted and named, the
string of names is sorted by the same method, and all suffixes are induced from that order. Over a small alphabet (bytes)
induction scans buckets: everything in a bucket whose place is known is handled at once, in order, so the number of numpy
calls depends on the alphabet and on runs of one symbol, not on the length. Over the large alphabet of names each run of
larger (then smaller) suffixes is induced by doubling along the run.
"""

from __future__ import annotations

import numpy as np

SMALL_ALPHABET = 300


def _smaller(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour; the last symbol must be the unique smallest."""
    n = len(text)
    out = np.ones(n, bool)
    if n < 2:
        return out
    differs = np.flatnonzero(text[1:] != text[:-1])
    rises = text[differs + 1] > text[differs]
    out[:-1] = np.repeat(rises, np.diff(np.concatenate([[-1], differs])))
    return out


def _dense(key: np.ndarray) -> np.ndarray:
    """Rank of each key, equal for equal keys."""
    order = np.argsort(key)
    ranks = np.empty(len(key), np.int64)
    if len(key):
        sorted_keys = key[order]
        ranks[order] = np.concatenate([[0], np.cumsum(sorted_keys[1:] != sorted_keys[:-1])])
    return ranks


def _places(key: np.ndarray) -> np.ndarray:
    """Number of smaller keys, for each key."""
    order = np.argsort(key)
    places = np.empty(len(key), np.int64)
    if len(key):
        sorted_keys = key[order]
        new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
        places[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    return places


def _induce_buckets(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, alphabet: int) -> np.ndarray:
    """Suffix order induced from ``lms`` (ordered within each first symbol), bucket by bucket."""
    n = len(text)
    ends = np.cumsum(np.bincount(text, minlength=alphabet))
    heads = np.concatenate([[0], ends[:-1]])
    order = np.empty(n, np.int64)
    first = text[lms]
    by = np.argsort(first, kind="stable")
    lms_at = np.searchsorted(first[by], np.arange(alphabet + 1))
    seeds = lms[by]
    fill = heads.copy()

    def push(found: np.ndarray, larger: bool) -> None:
        before = found[found > 0] - 1
        before = before[smaller[before] != larger]
        if not before.size:
            return
        symbol = text[before]
        place = np.argsort(symbol, kind="stable")
        before, symbol = before[place], symbol[place]
        count = np.bincount(symbol, minlength=alphabet)
        nth = np.arange(len(before)) - np.repeat(np.cumsum(count) - count, count)
        if larger:
            order[fill[symbol] + nth] = before
            fill[:] += count
        else:
            order[fill[symbol] - 1 - nth] = before
            fill[:] -= count

    for c in range(alphabet):
        lo = heads[c]
        while lo < fill[c]:
            lo, hi = fill[c], lo
            push(order[hi:lo], True)
        if lms_at[c] < lms_at[c + 1]:
            push(seeds[lms_at[c]:lms_at[c + 1]], True)
    larger_ends = fill
    fill = ends.copy()
    order[0] = n - 1
    for c in range(alphabet - 1, 0, -1):
        hi = ends[c]
        while fill[c] < hi:
            hi, top = fill[c], hi
            push(order[hi:top][::-1], False)
        if heads[c] < larger_ends[c]:
            push(order[heads[c]:larger_ends[c]][::-1], False)
    return order


def _induce_runs(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, lms_rank: np.ndarray) -> np.ndarray:
    """Rank of every suffix, equal where ``lms_rank`` leaves suffixes equal."""
    n = len(text)
    rank = np.zeros(n, np.int64)
    rank[lms] = lms_rank
    for kind in (False, True):  # larger suffixes from leftmost-smaller ones, then smaller ones from larger ones
        inside = np.flatnonzero(smaller) if kind else np.flatnonzero(~smaller)
        known = np.flatnonzero(~smaller) if kind else lms
        if kind:
            known = np.concatenate([known, [n - 1]])
            inside = inside[:-1]
        members = np.concatenate([inside, known])
        slot = np.full(n + 1, -1, np.int64)
        slot[members] = np.arange(len(members))
        later = kind == np.concatenate([np.ones(len(inside), bool), np.zeros(len(known), bool)])
        within = np.concatenate([np.zeros(len(inside), np.int64), rank[known]])
        current = _places((text[members].astype(np.int64) * 2 + later) * (n + 1) + within)
        step = np.arange(len(members))
        step[:len(inside)] = slot[inside + 1]
        while True:
            tied = np.flatnonzero(np.bincount(current, minlength=len(current))[current] > 1)
            if tied.size:
                group = current[tied]
                place = _places(group * (len(members) + 1) + current[step[tied]])
                current[tied] = group + place - _places(group)
            after = step[step]
            if not tied.size or (after == step).all():
                break
            step = after
        if kind:
            rank = np.empty(n, np.int64)
        rank[members] = current
    return rank


def _name_substrings(text: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Names of the leftmost-smaller substrings listed in ``order``: equal for equal substrings, ascending."""
    end = np.full(len(text), len(text) - 1)
    end[lms[:-1]] = lms[1:]
    a, b = order[:-1], order[1:]
    length = end[a] - a
    new = length != end[b] - b
    active = np.flatnonzero(~new)
    k = 0
    while active.size:
        x, y = a[active], b[active]
        differs = text[x + k] != text[y + k]
        new[active[differs]] = True
        active = active[~differs & (length[active] > k)]
        k += 1
    return np.concatenate([[0], np.cumsum(new)])


def suffix_ranks_of_names(names: np.ndarray) -> np.ndarray:
    """Rank of every suffix of a string over a large alphabet that ends with its unique smallest symbol."""
    n = len(names)
    if names.max(initial=0) + 1 == n:
        return names.astype(np.int64)
    smaller = _smaller(names)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if not lms.size:
        return _dense(names.astype(np.int64) * (n + 1) + np.where(smaller, np.arange(n), n - np.arange(n)))
    rough = _dense(_induce_runs(names, smaller, lms, np.zeros(len(lms), np.int64))[lms])
    if rough.max() + 1 < len(lms):
        rough = suffix_ranks_of_names(rough)
    return _induce_runs(names, smaller, lms, rough)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of small non-negative integers; a suffix that is a prefix of another is the smaller one."""
    if not len(text):
        return np.zeros(0, np.int64)
    alphabet = int(text.max()) + 2
    text = np.concatenate([text.astype(np.int64) + 1, [0]])
    if alphabet > SMALL_ALPHABET:
        order = np.empty(len(text), np.int64)
        order[suffix_ranks_of_names(_dense(text))] = np.arange(len(text))
        return order[1:]
    text = text.astype(np.uint8 if alphabet <= 256 else np.uint16)
    smaller = _smaller(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    order = _induce_buckets(text, smaller, lms, alphabet)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    rough = order[is_lms[order]]
    names = np.empty(len(text), np.int64)
    names[rough] = _name_substrings(text, lms, rough)
    ranks = suffix_ranks_of_names(names[lms])
    sorted_lms = np.empty(len(lms), np.int64)
    sorted_lms[ranks] = lms
    return _induce_buckets(text, smaller, sorted_lms, alphabet)[1:]


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position, the symbols its suffix shares with the suffix before it in ``order``.

    Suffixes are compared only where the symbols left of both differ; elsewhere the common prefix is the left neighbour's
    less one (Karkkainen, Manzini and Puglisi 2009).
    """
    n, at = len(text), np.arange(len(text))
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    reducible = (at > 0) & (before > 0)
    reducible[1:] &= text[before[1:] - 1] == text[:-1]
    active = np.flatnonzero(~reducible & (before >= 0))
    shared, k = np.zeros(n, np.int64), 0
    while active.size:
        other = before[active]
        inside = np.maximum(active, other) + k < n
        active, other = active[inside], other[inside]
        active = active[text[active + k] == text[other + k]]
        shared[active] += 1
        k += 1
    return np.maximum.accumulate(np.where(reducible, 0, shared + at)) - at
