"""Suffix arrays of one shard by induced sorting, in whole-array steps.

Suffixes are classified as smaller (S) or larger (L) than the next one. The S suffixes that follow an L suffix are the leftmost ones;
the substrings between them are sorted and named, the names form a shorter text whose suffix order is found by the same means,
or by doubling once its names are so many that buckets hold few suffixes. From the sorted leftmost suffixes all others are induced,
bucket by bucket: L suffixes upwards, S suffixes downwards. Each step of a bucket handles all its suffixes at once.
"""
from __future__ import annotations

import numpy as np

LEAST_BUCKET = 64           # mean suffixes of a bucket below which the shorter text is sorted by doubling


def types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one. The last symbol must be the only smallest."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int64)))
    place = np.where(step != 0, np.arange(n - 1), n)
    after = np.minimum.accumulate(place[::-1])[::-1]                # next place where neighbours differ
    out = np.empty(n, bool)
    out[:-1] = step[after] > 0
    out[-1] = True
    return out


def named(text: np.ndarray, small: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the substrings from each leftmost suffix to the next, symbols compared before types; number of ranks."""
    symbols = text.astype(np.uint64) * np.uint64(2) + small
    bits = max(1, int(symbols.max()).bit_length())
    per = 63 // bits
    symbols = np.concatenate([symbols + np.uint64(1) if bits * per < 63 else symbols, np.zeros(per, np.uint64)])
    length = np.diff(np.append(left, left[-1])) + 1                # the last one is the end mark alone
    rank, open_, done = np.zeros(len(left), np.int64), np.arange(len(left)), 0
    while len(open_):
        key = np.zeros(len(open_), np.uint64)
        for k in range(per):
            inside = length[open_] > done + k
            key = (key << np.uint64(bits)) | np.where(inside, symbols[np.minimum(left[open_] + done + k, len(symbols) - 1)], np.uint64(0))
        order = np.lexsort((key, rank[open_]))
        open_, key = open_[order], key[order]
        old = rank[open_]
        group = np.ones(len(open_), bool)
        group[1:] = old[1:] != old[:-1]
        new = group.copy()
        new[1:] |= key[1:] != key[:-1]
        at = np.arange(len(open_))
        begin = np.maximum.accumulate(np.where(new, at, 0))
        rank[open_] = old + begin - np.maximum.accumulate(np.where(group, at, 0))
        alone = new & np.append(new[1:], True)
        done += per
        open_ = np.sort(open_[~alone & (length[open_] > done)])
    values, dense = np.unique(rank, return_inverse=True)
    return dense, len(values)


def doubled(names: np.ndarray) -> np.ndarray:
    """Suffix order of a text of ranks, by ranks of doubling length; ranks that are alone are settled."""
    n = len(names)
    size = np.bincount(names)
    rank = (np.cumsum(size) - size)[names]
    open_, reach = np.flatnonzero(size[names] > 1), 1
    while len(open_):
        ahead = open_ + reach
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        order = np.lexsort((second, rank[open_]))
        open_, second = open_[order], second[order]
        old = rank[open_]
        group = np.ones(len(open_), bool)
        group[1:] = old[1:] != old[:-1]
        new = group.copy()
        new[1:] |= second[1:] != second[:-1]
        at = np.arange(len(open_))
        begin = np.maximum.accumulate(np.where(new, at, 0))
        rank[open_] = old + begin - np.maximum.accumulate(np.where(group, at, 0))
        alone = new & np.append(new[1:], True)
        open_ = np.sort(open_[~alone])
        reach *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def induced(text: np.ndarray, small: np.ndarray, left: np.ndarray) -> np.ndarray:
    """All suffixes in order, from the leftmost ones in order."""
    n, top = len(text), int(text.max()) + 1
    large = np.bincount(text[~small], minlength=top)
    total = np.bincount(text, minlength=top)
    first = np.cumsum(total) - total                                 # bucket: L suffixes, then S suffixes
    end = first + total
    out = np.full(n, -1, np.int64)
    fill = first.copy()
    left_of = np.searchsorted(text[left], np.arange(top + 1))       # leftmost suffixes by first symbol; they come sorted

    def put(found: np.ndarray, back: bool) -> None:
        symbol = text[found]
        order = np.argsort(symbol, kind="stable")
        found, symbol = found[order], symbol[order]
        begin = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        count = np.diff(np.append(begin, len(symbol)))
        nth = np.arange(len(symbol)) - np.repeat(begin, count)
        if back:
            out[fill[symbol] - 1 - nth] = found
            fill[symbol[begin]] -= count
        else:
            out[fill[symbol] + nth] = found
            fill[symbol[begin]] += count

    def before(source: np.ndarray, kind: bool) -> np.ndarray:
        found = source[source > 0] - 1
        return found[small[found] == kind]

    used = np.flatnonzero(total)
    for c in used:
        at = first[c]
        while at < fill[c]:                                           # its own L suffixes, and those they add to this bucket
            stop = fill[c]
            found = before(out[at:stop], False)
            at = stop
            if len(found):
                put(found, False)
        if left_of[c] < left_of[c + 1]:
            found = before(left[left_of[c]:left_of[c + 1]], False)
            if len(found):
                put(found, False)
    fill = end.copy()
    fill[text[n - 1]] = end[text[n - 1]] - 1
    out[fill[text[n - 1]]] = n - 1                                     # the end mark
    for c in used[::-1]:
        at = end[c]
        while at > fill[c]:
            stop = fill[c]
            found = before(out[stop:at][::-1], True)
            at = stop
            if len(found):
                put(found, True)
        found = before(out[first[c]:first[c] + large[c]][::-1], True)
        if len(found):
            put(found, True)
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order of an integer text whose last symbol is its only smallest."""
    if len(text) < 2:
        return np.arange(len(text))
    small = types(text)
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    names, count = named(text, small, left)
    if count == len(left):
        order = np.empty(count, np.int64)
        order[names] = np.arange(count)
    elif count * LEAST_BUCKET <= len(left):
        order = suffix_array(names)
    else:
        order = doubled(names)
    return induced(text, small, left[order])


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Permuted longest common prefixes: for each place, with the suffix before it in the order.

    Where the symbols before a place and before its predecessor agree, the prefix is one shorter than that of the place before; only the
    other places are compared, four symbols at a time.
    """
    n = len(text)
    previous = np.full(n, -1, np.int64)
    previous[order[1:]] = order[:-1]
    place = np.arange(n)
    follows = (place > 0) & (previous > 0)
    follows[follows] = text[place[follows] - 1] == text[previous[follows] - 1]
    told = np.flatnonzero(~follows & (previous >= 0))
    wide = np.concatenate([text.astype(np.uint16), np.zeros(4, np.uint16)])
    four = np.ndarray(n + 1, "<u8", wide, strides=(2,))
    length, live = np.zeros(len(told), np.int64), np.arange(len(told))
    while len(live):
        a, b = told[live] + length[live], previous[told[live]] + length[live]
        same = four[a] == four[b]
        length[live[same]] += 4
        rest = live[~same]
        for _ in range(3):
            rest = rest[wide[told[rest] + length[rest]] == wide[previous[told[rest]] + length[rest]]]
            length[rest] += 1
        live = live[same]
    base = np.full(n, -1, np.int64)
    base[told] = told
    base[previous < 0] = np.flatnonzero(previous < 0)
    base = np.maximum.accumulate(base)
    value = np.zeros(n, np.int64)
    value[told] = length
    return np.maximum(value[base] - (place - base), 0)
