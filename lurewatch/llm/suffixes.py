"""Suffix arrays by induced sorting, and common prefixes in text order, on numpy arrays."""

from __future__ import annotations

import numpy as np

# Reduced strings have about as many symbols as positions; inducing them bucket by bucket would take
# a step per symbol. From this alphabet on they are ordered by doubling ranks instead.
INDUCED_SYMBOLS = 4096


def classified(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the next one. ``text`` ends with its smallest symbol, 0."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])
    smaller = np.zeros(n, dtype=bool)
    if len(differs):
        rises = text[differs] < text[differs + 1]
        upto = np.diff(np.concatenate([[-1], differs]))
        smaller[:differs[-1] + 1] = np.repeat(rises, upto)
    smaller[n - 1] = True  # the end counts as smallest of all
    if n > 1 and not len(differs):
        smaller[:-1] = False
    elif len(differs):
        smaller[differs[-1] + 1:n - 1] = False
    return smaller


def _ranges(symbols: np.ndarray, at: np.ndarray, forward: bool) -> np.ndarray:
    """Places for items that are appended to their symbol's bucket one after the other; moves ``at``."""
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_symbols[1:] != sorted_symbols[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(symbols)]]))
    within = np.arange(len(symbols)) - np.repeat(first, sizes)
    present = sorted_symbols[first]
    places = np.empty(len(symbols), dtype=np.int64)
    if forward:
        places[order] = np.repeat(at[present], sizes) + within
        at[present] += sizes
    else:
        places[order] = np.repeat(at[present], sizes) - within
        at[present] -= sizes
    return places


def induced(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array that follows from the order of ``seeds``, the leftmost-smaller positions.

    Buckets are passed from the smallest symbol up, appending larger-type suffixes, then from the
    largest down, prepending smaller-type ones. All suffixes of a bucket that are known at once are
    taken at once; runs of one symbol take a step per repetition."""
    n = len(text)
    sizes = np.bincount(text, minlength=symbols)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    array = np.full(n, -1, dtype=np.int64)
    tails = ends - 1
    array[_ranges(text[seeds[::-1]], tails, False)] = seeds[::-1]
    seeded_from = tails + 1
    heads = starts.copy()

    def spread(found: np.ndarray, at: np.ndarray, wanted: bool, forward: bool) -> None:
        before = found[found > 0] - 1
        before = before[smaller[before] == wanted]
        if len(before):
            array[_ranges(text[before], at, forward)] = before

    for c in np.flatnonzero(sizes):
        done = starts[c]
        while done < heads[c]:
            upto = heads[c]
            spread(array[done:upto], heads, False, True)
            done = upto
        spread(array[seeded_from[c]:ends[c]], heads, False, True)
    tails = ends - 1
    for c in np.flatnonzero(sizes)[::-1]:
        done = ends[c] - 1
        while done > tails[c]:
            upto = tails[c]
            spread(array[upto + 1:done + 1][::-1], tails, True, False)
            done = upto
        spread(array[starts[c]:heads[c]][::-1], tails, True, False)
    return array


def _equal_substrings(text: np.ndarray, one: np.ndarray, other: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether text[one:one+length] and text[other:other+length] agree, for every pair."""
    same = np.ones(len(one), dtype=bool)
    alive, k = np.arange(len(one)), 0
    while len(alive):
        alive = alive[lengths[alive] > k]
        agree = text[one[alive] + k] == text[other[alive] + k]
        same[alive[~agree]] = False
        alive = alive[agree]
        k += 1
    return same


def doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes' first ``depth`` names, by doubling ranks.

    A rank is the place where its group of equal suffixes starts; only groups of several are sorted
    further."""
    n, width = len(names), 1
    order = np.argsort(names, kind="stable")
    sorted_names = names[order]
    fresh = np.concatenate([[True], sorted_names[1:] != sorted_names[:-1], [True]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh[:-1], np.arange(n), 0))
    while width < depth:
        open_ = np.flatnonzero(~(fresh[:-1] & fresh[1:]))
        if not len(open_):
            break
        items = order[open_]
        onward = items + width
        following = np.where(onward < n, rank[np.minimum(onward, n - 1)] + 1, 0)
        key = rank[items] * (n + 1) + following
        within = np.argsort(key, kind="stable")
        items, key = items[within], key[within]
        order[open_] = items
        start = np.concatenate([[True], key[1:] != key[:-1]])
        fresh[open_] = start
        rank[items] = open_[np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))]
        width *= 2
    return order


def suffix_array(text: np.ndarray, symbols: int, depth: int | None = None) -> np.ndarray:
    """Suffix positions in order. ``text`` ends with 0; suffixes that agree in ``depth`` symbols may
    be in any order (default: none)."""
    n = len(text)
    depth = depth or n
    if symbols < 1 << 15:
        text = text.astype(np.int16)  # short numbers are sorted by counting
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    smaller = classified(text)
    least = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1  # leftmost-smaller positions
    is_least = np.zeros(n, dtype=bool)
    is_least[least] = True
    rough = induced(text, smaller, least, symbols)
    placed = rough[is_least[rough]]
    lengths = np.empty(n, dtype=np.int64)
    lengths[least] = np.diff(np.concatenate([least, [n - 1]])) + 1
    size = lengths[placed]
    same = np.zeros(len(placed), dtype=bool)
    same[1:] = (size[1:] == size[:-1])
    pairs = np.flatnonzero(same)
    same[pairs] = _equal_substrings(text, placed[pairs - 1], placed[pairs], size[pairs])
    name = np.empty(n, dtype=np.int64)
    name[placed] = np.cumsum(~same) - 1
    names = name[least]
    count = int(names.max()) + 1
    if count == len(names):
        order = least[np.argsort(names)]
    elif count < INDUCED_SYMBOLS:
        inner = suffix_array(np.concatenate([names + 1, [0]]), count + 1, depth)
        order = least[inner[1:]]
    else:
        order = least[doubled(names, depth)]
    return induced(text, smaller, order, symbols)


def common_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each suffix, in text order, the symbols it shares with the one before it in the array.

    Where both are preceded by the same symbol, the length is one less than at the position before;
    all other lengths are counted, many at once. Symbols are below 2 ** 15; 0, a separator with which
    ``text`` ends, never counts as shared."""
    n = len(text)
    previous = np.full(n, -1, dtype=np.int64)
    previous[array[1:]] = array[:-1]
    at = np.arange(n)
    counted = np.ones(n, dtype=bool)
    both = np.flatnonzero((previous > 0) & (at > 0))
    counted[both] = (text[both - 1] != text[previous[both] - 1]) | (text[both - 1] == 0)
    # A length can only be carried on from a position that has a neighbour.
    counted[1:] |= previous[:-1] < 0
    start = np.flatnonzero(counted)
    length = np.zeros(len(start), dtype=np.int64)
    # Four symbols at a time as one number; those with a separator in them agree with no other.
    padded = np.concatenate([text, np.zeros(4, dtype=text.dtype)]).astype(np.int64)
    words = padded[:n] | padded[1:n + 1] << 16 | padded[2:n + 2] << 32 | padded[3:n + 3] << 48
    cut = (padded[:n] == 0) | (padded[1:n + 1] == 0) | (padded[2:n + 2] == 0) | (padded[3:n + 3] == 0)
    words[cut] = -1 - np.flatnonzero(cut)
    compared = np.flatnonzero(previous[start] >= 0)
    alive, one, other = compared, start[compared], previous[start[compared]]
    while len(alive):
        agree = words[one] == words[other]
        alive, one, other = alive[agree], one[agree] + 4, other[agree] + 4
        length[alive] += 4
    alive, one, other = compared, start[compared] + length[compared], previous[start[compared]] + length[compared]
    for _ in range(3):
        agree = (text[one] == text[other]) & (text[one] != 0)
        alive, one, other = alive[agree], one[agree] + 1, other[agree] + 1
        length[alive] += 1
    run = np.cumsum(counted) - 1
    return np.maximum(length[run] - (at - start[run]), 0)
