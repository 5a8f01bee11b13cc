"""Texts of Arrow batches as NumPy buffers: bytes, words and shingles without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once. Most arrays hold eight bytes for each, and two workers share an executor.
PART_BYTES = 512 << 10


def columns(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts of column i end to end, and the end of each; null is empty."""
    texts = batch.column(i)
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    n = len(texts)
    _, offsets, data = texts.buffers()
    if not n or data is None:
        return np.zeros(0, np.uint8), np.zeros(n, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at[1:] - at[0]


def split_batch(batch: pa.RecordBatch, i: int, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with no more than limit bytes in column i, or one row; see words on a row that is longer."""
    _, ends = columns(batch, i)
    row, done = 0, 0
    while row < batch.num_rows:
        stop = max(row + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(row, stop - row)
        row, done = stop, int(ends[stop - 1])


_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_RNG = np.random.default_rng(20240917)
#: A random 64-bit value for each byte; the hash of a string is a polynomial in an odd number with these coefficients.
BYTE_VALUES = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    key = int(base)
    got = _powers.get(key)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        _powers[key] = got = np.multiply.accumulate(got)
    return got[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """P with P[b] - P[a], times BASE ** (n - a), a hash of data[a:b]; see span_hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(_INVERSE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span that depends on its bytes alone."""
    return mix64((prefix[end] - prefix[start]) * powers(_BASE, len(prefix))[start] + (end - start).astype(np.uint64))


def _long_word(data: np.ndarray) -> np.uint64:
    """The hash of one word, as span_hash has it, by pieces."""
    total = 0
    for a in range(0, len(data), PART_BYTES):
        part = data[a : a + PART_BYTES]
        sum_ = int((BYTE_VALUES[part] * powers(_INVERSE, len(part))).sum(dtype=np.uint64))
        total += sum_ * pow(int(_INVERSE), a, 1 << 64)
    return mix64(np.array([(total + len(data)) % (1 << 64)], np.uint64))[0]


def cut_places(data: np.ndarray, size: int = PART_BYTES) -> list[int]:
    """Ends of pieces of a text of about size bytes each: behind a separator, so that no word is cut."""
    out, a = [], 0
    while len(data) - a > size:
        blank = np.flatnonzero(_SEPARATOR[data[a : a + size]])
        stop = a + int(blank[-1]) + 1 if len(blank) else a + size
        while not len(blank) and stop < len(data):  # one word is longer than a piece
            blank = np.flatnonzero(_SEPARATOR[data[stop : stop + size]])
            stop = stop + int(blank[0]) + 1 if len(blank) else min(len(data), stop + size)
        out.append(stop)
        a = stop
    return out if out and out[-1] == len(data) else [*out, len(data)]


def words(data: np.ndarray, ends: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash) of each word; words are cut at 0x20, 0x09 to 0x0D and the end of a text.

    A single long text is read piece by piece: besides the words, no array is larger than a piece."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    if len(ends) == 1 and len(data) > PART_BYTES:
        parts, a = [], 0
        for b in cut_places(data):
            piece = data[a:b]
            if len(piece) <= PART_BYTES:
                row, start, end, value = words(piece, np.array([len(piece)]), fold)
            else:
                at = np.flatnonzero(~_SEPARATOR[piece])
                start, end = at[:1], at[-1:] + 1
                row = np.zeros(1, np.int64)
                word = piece[int(start[0]) : int(end[0])]
                value = np.array([_long_word(_FOLD[word] if fold else word)])
            parts.append((row, start + a, end + a, value))
            a = b
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    solid = ~_SEPARATOR[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    breaks = ends[:-1]
    breaks = breaks[(breaks > 0) & (breaks < len(data))]
    first[breaks] |= solid[breaks]
    start = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[breaks - 1] |= solid[breaks - 1]
    end = np.flatnonzero(last) + 1
    prefix = prefix_hash(_FOLD[data] if fold else data)
    return np.searchsorted(ends, start, side="right"), start, end, span_hash(prefix, start, end)


def shingles(row: np.ndarray, word_hash: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row: (row, hash), sorted by row. A row with fewer words has one of them all."""
    count = np.bincount(row, minlength=n_rows)
    if not len(row):
        return row, word_hash
    value = word_hash.copy()
    for k in range(1, size):
        value[:-k] = mix64(value[:-k] * np.uint64(0x9E3779B97F4A7C15) + word_hash[k:])
    whole = np.zeros(len(row), dtype=bool)
    if len(row) >= size:
        whole[: len(row) - size + 1] = row[: len(row) - size + 1] == row[size - 1 :]
    at, got = row[whole], value[whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(count)])
        extra = []
        for r in short.tolist():
            h = np.array([count[r]], np.uint64)
            for x in word_hash[begin[r] : begin[r + 1]]:
                h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + x)
            extra.append(h[0])
        at, got = np.concatenate([at, short]), np.concatenate([got, np.array(extra, np.uint64)])
    order = np.lexsort((got, at))
    at, got = at[order], got[order]
    keep = np.ones(len(at), dtype=bool)
    keep[1:] = (at[1:] != at[:-1]) | (got[1:] != got[:-1])
    return at[keep], got[keep]
