"""Repeated substrings of a block of strings from its Burrows-Wheeler transform.

Common prefixes of neighbouring suffixes are derived in increasing order (Beller, Gog, Ohlebusch and Schnattinger, 2013):
a breadth-first search extends the intervals of all strings of one length to the left, level by level. An interval
whose right edge has no value yet gives that edge the level as its common prefix, and is extended further. Edges that
are still open when the search has reached the wanted length separate suffixes that share at least so many bytes.
"""

from __future__ import annotations

import numpy as np

#: Symbols of a byte and of the end of a string: 9 bits each.
_PACKED = 7


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Of a sequence of symbols below 512, by prefix doubling from _PACKED symbols on."""
    n = len(symbols)
    padded = np.zeros(n + _PACKED, np.uint64)
    padded[:n] = symbols
    key = np.zeros(n, np.uint64)
    for i in range(_PACKED):
        key = (key << np.uint64(9)) | padded[i : n + i]
    length = _PACKED
    while True:
        order = np.argsort(key, kind="quicksort")
        got = key[order]
        rank = np.empty(n, np.int32)
        steps = np.cumsum(np.concatenate([[False], got[1:] != got[:-1]]), dtype=np.int32)
        rank[order] = steps + 1
        if steps[-1] == n - 1 if n else True:
            return order.astype(np.int32)
        key = rank.astype(np.uint64)
        key *= np.uint64(n + 2)
        key[: max(0, n - length)] += rank[length:].astype(np.uint64)
        length *= 2


def groups(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, group) of every place where length bytes of one string begin; equal bytes have equal groups."""
    sizes = np.array([len(s) for s in strings], np.int64)
    n = int(sizes.sum()) + len(strings)
    symbols = np.zeros(n, np.int16)
    begin = np.cumsum(sizes + 1) - sizes - 1
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8) if strings else np.zeros(0, np.uint8)
    inside = np.ones(n, bool)
    inside[begin + sizes] = False
    symbols[inside] = data[inside].astype(np.int16) + 1
    order = suffix_array(symbols)
    bwt = symbols[order - 1]
    count = np.bincount(symbols, minlength=257)
    first = np.cumsum(count) - count
    # LF: where the suffix that is one symbol longer stands
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    lf = place[order - 1]
    del place

    edge = np.full(n + 1, -1, np.int32)
    edge[0] = edge[n] = 0
    seen = np.flatnonzero(count)
    left, right = first[seen], first[seen] + count[seen]
    edge[right[edge[right] < 0]] = 0
    keep = seen > 0
    left, right = left[keep], right[keep]
    for level in range(1, length):
        if not len(left):
            break
        size = right - left
        one = left[size == 1]
        one = one[bwt[one] > 0]
        new_left, new_right = lf[one], lf[one] + 1
        if (size > 1).any():
            a, s = left[size > 1], size[size > 1]
            which = np.repeat(np.arange(len(a)), s)
            at = np.repeat(a - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))
            symbol = bwt[at]
            ok = symbol > 0
            which, at, symbol = which[ok], at[ok], symbol[ok]
            # equal symbols of an interval stand side by side after a stable sort, the first with the least LF
            by = np.argsort(which * 512 + symbol, kind="stable")
            tag = (which * 512 + symbol)[by]
            starts = np.flatnonzero(np.concatenate([[True], tag[1:] != tag[:-1]])) if len(tag) else np.zeros(0, np.int64)
            low = lf[at[by][starts]]
            many = np.diff(np.concatenate([starts, [len(tag)]]))
            new_left, new_right = np.concatenate([new_left, low]), np.concatenate([new_right, low + many])
        open_ = edge[new_right] < 0
        left, right = new_left[open_], new_right[open_]
        edge[right] = level
    group = np.cumsum(edge[:n] >= 0)
    owner = np.repeat(np.arange(len(strings)), sizes + 1)[order]
    start = order - begin[owner]
    fits = start + length <= sizes[owner]
    return owner[fits], start[fits], group[fits]
