"""Removes long byte strings that a corpus holds more than once.

A string of min_length bytes is repeated if it starts at another place too, in the same text or another. Every byte
that a repeated string covers is removed.

The corpus is cut so that no two equal strings are parted. Of the hashes of the anchor_length-grams within a string, the
smallest, leftmost first, is its anchor (winnowing, Schleimer et al., 2003): equal strings have equal anchors at equal
places. Consecutive strings with one anchor form a context, a stretch of less than 2 * min_length bytes.

1. One pass over the texts gives the contexts: place, hash of the anchor, hash of the context. No text moves.
2. An anchor that occurs once has no repeated string. Where all contexts of an anchor are equal, or one context
   occurs twice, its strings are all repeated.
3. What is left are contexts that differ while their anchors agree. Their bytes are fetched and grouped by anchor;
   for blocks of whole groups the Burrows-Wheeler transform and a threshold-bounded breadth-first search give the
   strings that are equal (_bwt.py). Equal contexts are there once only, so a passage that a large share of the corpus
   repeats costs one row. A group too large for a block is solved by hashes of its strings, counted by the cluster.
4. The stretches to remove are gathered by text, and the texts cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom._ship import ship
from pairloom.llm import _bwt
from pairloom.llm._common import materialise, table
from pairloom.llm._text import columns, mix64, powers, prefix_hash, span_hash, split_batch

MIN_LENGTH = 400
#: Bytes of contexts in one block of the Burrows-Wheeler transform, and in the largest group that makes one.
BLOCK_BYTES = 1 << 20
GROUP_BYTES = 4 << 20
#: Ids of texts that are sent to every executor; beyond, texts meet their contexts by a shuffle alone.
SENT_IDS = 4_000_000

_PLACE = np.uint64((1 << 24) - 1)
#: Bytes of one text that are worked on at once; places have 24 bits.
_PIECE = 512 << 10
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each window of width values, by running minima of blocks from both sides."""
    n = len(x)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def contexts(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first string, number of strings, anchor hash, context hash) of each context; places count from data[0]."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none
    prefix = prefix_hash(data)
    m = n - gram + 1
    h = mix64((prefix[gram:] - prefix[:m]) * powers(_BASE, n + 1)[:m])
    place = (_least((h & ~_PLACE) | np.arange(m, dtype=np.uint64), length - gram + 1) & _PLACE).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    long = ends - starts >= length
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts[long], 1)
    np.add.at(change, ends[long] - length + 1, -1)
    valid = np.cumsum(change)[: len(place)] > 0
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (place[1:] != place[:-1])
    lo, hi = np.flatnonzero(first), np.flatnonzero(last)
    at = place[lo]
    context = mix64(span_hash(prefix, lo, hi + length) + (at - lo).astype(np.uint64) * _BASE)
    return np.searchsorted(ends, lo, side="right"), lo, hi - lo + 1, h[at].view(np.int64), context.view(np.int64)


def _pieces(data: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The part as it is, or a long text in pieces that share length - 1 bytes: (place of the first byte, data, ends)."""
    if len(ends) != 1 or len(data) <= _PIECE:
        yield 0, data, ends
        return
    for a in range(0, len(data) - length + 1, _PIECE):
        piece = data[a : a + _PIECE + length - 1]
        yield a, piece, np.array([len(piece)])


def _scan(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, 2):
                data, ends = columns(part, 2)
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                for shift, piece, edge in _pieces(data, ends, length):
                    row, lo, n, key, context = contexts(piece, edge, length, gram)
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(at), part.column(1).take(at), pa.array(lo + shift - starts[row]), pa.array(n.astype(np.int32)), pa.array(key), pa.array(context)],
                        names=["id", "th", "lo", "n", "key", "ctx"],
                    )

    return texts.mapInArrow(run, "id long, th long, lo long, n int, key long, ctx long")


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers in x, which is sorted."""
    cut = np.flatnonzero(np.diff(x) != 1)
    return x[np.concatenate([[0], cut + 1])], x[np.concatenate([cut, [len(x) - 1]])]


def _stretches(hit: list[tuple[int, int, int, np.ndarray]], length: int) -> pa.RecordBatch:
    """Rows of (id, th, place of the context, starts of repeated strings in it) as stretches of bytes."""
    ids, ths, a, b = [], [], [], []
    for i, th, lo, starts in hit:
        first, last = _runs(np.unique(starts))
        ids += [i] * len(first)
        ths += [th] * len(first)
        a += (first + lo).tolist()
        b += (last + lo + length).tolist()
    kinds = (pa.int64(),) * 4
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((ids, ths, a, b), kinds, strict=True)], names=["id", "th", "a", "b"])


def _compare(fetched: DataFrame, length: int) -> DataFrame:
    """Stretches of the contexts with many = false that are repeated; fetched holds whole groups, sorted by key."""

    def solve(block: list[tuple]) -> Iterator[pa.RecordBatch]:
        # a group of one can't match; neither can others', whose anchors differ
        owner, start, group = _bwt.groups([r[5] for r in block], length)
        twice = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        owner, start = owner[twice], start[twice]
        by = np.argsort(owner, kind="stable")
        owner, start = owner[by], start[by]
        cuts = np.flatnonzero(np.diff(owner)) + 1
        hit = [(*block[int(o[0])][1:4], s) for o, s in zip(np.split(owner, cuts), np.split(start, cuts), strict=True) if len(o) and not block[int(o[0])][4]]
        if hit:
            yield _stretches(hit, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held > BLOCK_BYTES and block[-1][0] != row[0]:
                    yield from solve(block)
                    block, held = [], 0
                block.append(row)
                held += len(row[5])
        if block:
            yield from solve(block)

    return fetched.select("key", "id", "th", "lo", "many", "bytes").mapInArrow(run, "id long, th long, a long, b long")


def _count(fetched: DataFrame, length: int) -> DataFrame:
    """The same for groups of any size: two 64-bit hashes of every string are counted over the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                data, ends = columns(part, 4)
                sizes = np.diff(np.concatenate([[0], ends]))
                n = sizes - length + 1
                row = np.repeat(np.arange(len(n)), n)
                start = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                at = start + np.repeat(ends - sizes, n)
                first = span_hash(prefix_hash(data), at, at + length)
                second = span_hash(prefix_hash(data ^ np.uint8(0x5A)), at, at + length)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(j).take(pa.array(row)) for j in range(4)), pa.array(start), pa.array(first.view(np.int64)), pa.array(second.view(np.int64))],
                    names=["id", "th", "lo", "many", "start", "h1", "h2"],
                )

    strings = fetched.select("id", "th", "lo", "many", "bytes").mapInArrow(
        run, "id long, th long, lo long, many boolean, start long, h1 long, h2 long"
    )
    strings = materialise(strings)
    twice = strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h1", "h2")
    hit = strings.where("not many").join(twice, ["h1", "h2"], "left_semi")
    return hit.select("id", "th", (F.col("lo") + F.col("start")).alias("a"), (F.col("lo") + F.col("start") + length).alias("b"))


def repeated_stretches(texts: DataFrame, min_length: int, gram: int, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """texts(id, th, text) to stretches (id, th, a, b) of bytes to remove; they may overlap."""
    found = materialise(_scan(texts, min_length, gram))
    anchors = found.groupBy("key").agg(F.count(F.lit(1)).alias("c"), (F.min("ctx") == F.max("ctx")).alias("same")).where("c > 1")
    shared = materialise(found.join(anchors.select("key", "same"), "key"))
    end = (F.col("lo") + F.col("n") + (min_length - 1)).alias("b")
    out = shared.where("same").select("id", "th", F.col("lo").alias("a"), end)

    mixed = shared.where(~F.col("same"))
    distinct = materialise(
        # any row will do; one aggregate takes all its columns from the same row
        mixed.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("c"), *[F.first(x).alias(x) for x in ("id", "th", "lo", "n")])
    )
    copies = distinct.where("c > 1").select("key", "ctx")
    out = out.unionByName(mixed.join(copies, ["key", "ctx"], "left_semi").select("id", "th", F.col("lo").alias("a"), end))

    # a context that occurs once needs a look at the others of its anchor
    groups = distinct.groupBy("key").agg(F.sum(F.col("n") + (min_length - 1)).alias("size"), F.min("c").alias("least")).where("least = 1")
    ask = distinct.join(groups, "key").select(
        "key", (F.col("size") > group_bytes).alias("large"), (F.col("c") > 1).alias("many"), "id", "th", "lo", "n"
    )
    ask = materialise(ask)
    ids = materialise(ask.select("id", "th").distinct())
    few = ids.limit(SENT_IDS + 1).count() <= SENT_IDS
    wanted = texts.join(F.broadcast(ids), ["id", "th"], "left_semi") if few else texts
    fetched = ask.join(wanted, ["id", "th"]).select(
        "key", "id", "th", "lo", "many", "large",
        F.substring(F.col("text").cast("binary"), (F.col("lo") + 1).cast("int"), F.col("n") + (min_length - 1)).alias("bytes"),
    )
    fetched = materialise(fetched)
    small = fetched.where(~F.col("large")).repartition("key").sortWithinPartitions("key")
    out = out.unionByName(_compare(small, min_length))
    if not ask.where("large").isEmpty():
        out = out.unionByName(_count(fetched.where("large"), min_length))
    return out


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = MIN_LENGTH,
    anchor_length: int | None = None,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """One row per input row: the id, n_bytes, kept (binary: the bytes that stay) and removed, an array of (a, b).

    A null text is empty. Texts shorter than min_length lose nothing. Rows that repeat an id and a text are copies of
    each other like any others. A cut may fall inside a character, so kept is binary. An empty table gives an empty
    result; other columns are ignored.
    """
    gram = anchor_length or max(1, 2 * min_length // 5)
    if not 0 < gram <= min_length:
        raise ValueError("anchor_length must be within min_length")
    ship(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # a null id and a text hash tell rows apart as well as an id does
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), text.alias("text"))
    texts = texts.select(F.coalesce("__id", F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("th"), "text")
    stretches = repeated_stretches(texts, min_length, gram, group_bytes)
    by_text = stretches.groupBy("id", "th").agg(F.collect_set(F.struct("a", "b")).alias("s"))
    by_text = by_text.select("id", "th", F.transform("s", lambda x: x["a"]).alias("a"), F.transform("s", lambda x: x["b"]).alias("b"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for batch in batches:
            for part in split_batch(batch, 1):
                kept, removed = [], []
                data, ends = columns(part, 1)
                starts = np.concatenate([[0], ends[:-1]])
                froms, tos = part.column(2).to_pylist(), part.column(3).to_pylist()
                for k in range(part.num_rows):
                    raw = data[int(starts[k]) : int(ends[k])].tobytes()
                    runs: list[list[int]] = []
                    for a, b in sorted(zip(froms[k] or (), tos[k] or (), strict=True)):
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(b, runs[-1][1])
                        else:
                            runs.append([a, b])
                    edges = [0, *(x for r in runs for x in r), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    removed.append([{"a": a, "b": b} for a, b in runs])
                size = pa.array(np.diff(np.concatenate([[0], ends])))
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(kept, pa.binary()), pa.array(removed, pairs)], names=["id", "n_bytes", "kept", "removed"])

    joined = texts.join(by_text, ["id", "th"], "left").select("id", "text", "a", "b")
    out = joined.mapInArrow(cut, "id long, n_bytes long, kept binary, removed array<struct<a:long,b:long>>")
    return out.select(F.when(F.col("id") != -(2**63), F.col("id")).alias(id_col), "n_bytes", "kept", "removed")


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["b"] - r["a"])
    return out.select(
        "doc_id",
        "n_bytes",
        n.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
