"""The exact set similarity join by prefix filtering, in plain NumPy: the measure of the near-dedup operator's recall."""

import numpy as np
import pyarrow as pa

from pairloom.llm._text import columns, shingles, split_batch, words


def sets(texts, size):
    """The sorted shingle hashes of each text."""
    out = []
    for part in split_batch(pa.record_batch([pa.array(texts, pa.string())], ["t"]), 0):
        row, _, _, value = words(*columns(part, 0))
        at, got = shingles(row, value, part.num_rows, size)
        out += np.split(got, np.searchsorted(at, np.arange(1, part.num_rows)))
    return out


def links(texts, size, percent=80):
    """All pairs (i, j), i < j, whose sets reach the threshold; equal sets are linked in a chain only."""
    all_sets = sets(texts, size)
    first, chain = {}, []
    for i, s in enumerate(all_sets):
        if len(s):
            key = s.tobytes()
            if key in first:
                chain.append((first[key], i))
            first.setdefault(key, i)
    ids = np.array(sorted(set(first.values())))
    flat = np.concatenate([all_sets[i] for i in ids])
    sizes = np.array([len(all_sets[i]) for i in ids])
    owner = np.repeat(np.arange(len(ids)), sizes)
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((token, count[token], owner))
    owner, token = owner[order], token[order]
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    prefix = sizes - -(-sizes * percent // 100) + 1
    keep = nth < prefix[owner]
    owner, token = owner[keep], token[keep]
    order = np.lexsort((owner, token))
    owner, token = owner[order], token[order]
    found = set()
    for d in range(1, len(owner)):
        same = np.flatnonzero(token[d:] == token[:-d])
        if not len(same):
            break
        a, b = owner[same], owner[same + d]
        ok = np.minimum(sizes[a], sizes[b]) * 100 >= np.maximum(sizes[a], sizes[b]) * percent
        found.update(zip(a[ok].tolist(), b[ok].tolist(), strict=True))
    out = []
    for a, b in found:
        x, y = all_sets[ids[a]], all_sets[ids[b]]
        both = len(np.intersect1d(x, y, assume_unique=True))
        if both * 100 >= (len(x) + len(y) - both) * percent:
            out.append((int(ids[a]), int(ids[b])))
    return out + chain


def components(ids, pairs):
    """id to the smallest id reachable; pairs are of places in ids."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        x, y = find(ids[i]), find(ids[j])
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
