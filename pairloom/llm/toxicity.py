"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios (Wang and Manning, 2012).

A feature is the presence in a text of an n-gram of characters of a lower-cased word with its edges marked, hashed to
a bucket. Each feature counts with its log-count ratio: how much likelier texts labelled 1 hold it than texts labelled
0. Features whose ratio is near 0 are left out, and a logistic fit weighs the rest.

Learning uses at most max_rows labelled rows. Their texts stay on the executors: counts come back summed by bucket, at
most BUCKETS of them, and then the few kept features of each row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom._ship import ship
from pairloom.llm import _learn
from pairloom.llm._common import materialise, table
from pairloom.llm._text import columns, mix64, powers, split_batch, words

BUCKETS = 1 << 20
ORDERS = (3, 4, 5, 6)
#: Labelled rows that are learnt from, at most.
MAX_ROWS = 40_000
MIN_ROWS = 3
#: Bytes of text whose n-grams are held at once: each byte of running text has about fifty in its distinct words, of
#: eight bytes in several arrays.
PART_BYTES = 128 << 10
#: Features whose log-count ratio is nearer to 0 tell the classes apart too little to be fitted.
MIN_RATIO = 1.0
_SEED = np.uint64(0x2545F4914F6CDD1D)


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The spans one after the other, each between line feeds."""
    size = end - start + 1
    edge = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(edge[-1]) + 1, 10, np.uint8)
    at = np.arange(int(edge[-1])) - np.repeat(edge[:-1], size)
    inside = at < np.repeat(size - 1, size)
    out[1:][inside] = data[(np.repeat(start, size) + at)[inside]]
    return out.tobytes()


def _grams(data: np.ndarray, start: np.ndarray, end: np.ndarray, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each n-gram of the words; the line feed marks an edge."""
    text = _gather(data, start, end).decode("utf-8", "replace").lower()
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    mark = codes == 10
    n = len(codes)
    word = np.cumsum(mark) - 1
    value = mix64(codes * _SEED)
    marks = np.concatenate([[0], np.cumsum(mark)])
    found_word, found = [], []
    for k in orders:
        if n < k:
            continue
        h = np.zeros(n - k + 1, np.uint64)
        for i, p in enumerate(powers(_SEED, k)):
            h += value[i : n - k + 1 + i] * p
        # no edge within the n-gram but at its ends
        ok = marks[k - 1 : n] - marks[1 : n - k + 2] == 0
        at = np.flatnonzero(ok)
        found.append((mix64(h[at] + np.uint64(k)) & np.uint64(BUCKETS - 1)).astype(np.int64))
        found_word.append(word[at])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_word), np.concatenate(found)


def features(data: np.ndarray, ends: np.ndarray, active: np.ndarray | None, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket), each pair once and sorted by row: the n-grams that a row holds, of those that are active."""
    row, start, end, value = words(data, ends)
    if not len(row):
        return row, row
    _, first, which = np.unique(value, return_index=True, return_inverse=True)
    word, bucket = _grams(data, start[first], end[first], orders)
    if active is not None:
        keep = active[bucket]
        word, bucket = word[keep], bucket[keep]
    order = np.argsort(word, kind="stable")
    word, bucket = word[order], bucket[order]
    count = np.bincount(word, minlength=len(first))
    begin = np.cumsum(count) - count
    used = count[which] > 0
    pair = np.unique(row[used] * len(first) + which[used])
    row, which = pair // len(first), pair % len(first)
    size = count[which]
    at = np.repeat(begin[which] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    pair = np.unique(np.repeat(row, size) * BUCKETS + bucket[at])
    return pair // BUCKETS, pair % BUCKETS


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32 by bucket, with the log-count ratio multiplied in; 0: not used
    intercept: float
    orders: tuple[int, ...] = ORDERS


def _fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, max_rows: int, orders: tuple[int, ...], min_ratio: float, folds: int) -> tuple[Model, np.ndarray, np.ndarray]:
    """The model of all labelled rows outside the held-out fold; and, where there are several folds, each row's label
    and its score by a model of the other folds.

    N-grams are counted by fold and the kept features of each row are taken once, for all the models: the counts of a
    model are sums over its folds, and its features a part of those that any of them keeps."""
    ship(docs.sparkSession)
    sample = _learn.labelled(
        docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")),
        _learn.sample_labels(labels, label_col, max_rows, id_col), "id",
    )
    kind = F.pmod(F.xxhash64(F.lit(11), F.col("id")), F.lit(folds)) * 2 + (F.col("__label") > 0).cast("int")
    sample = materialise(sample.select(kind.cast("int").alias("kind"), "text"))
    kinds = 2 * folds
    names = [f"n{k}" for k in range(kinds)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((kinds, BUCKETS), np.int32)
        rows = np.zeros(kinds, np.int64)
        for batch in batches:
            for part in split_batch(batch, 1, PART_BYTES):
                kind = part.column(0).to_numpy()
                rows += np.bincount(kind, minlength=kinds)
                row, bucket = features(*columns(part, 1), None, orders)
                np.add.at(seen, (kind[row], bucket), 1)
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(at, -1).astype(np.int32)), *(pa.array(np.append(seen[k][at].astype(np.int64), rows[k])) for k in range(kinds))],
            names=["bucket", *names],
        )

    counts = sample.mapInArrow(count, ", ".join(["bucket int", *(f"{n} long" for n in names)]))
    counts = counts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])
    all_rows = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    got = counts.where(F.col("bucket").isin(-1) | (all_rows >= MIN_ROWS)).toArrow()
    bucket, seen = got.column(0).to_numpy(), np.stack([got.column(k + 1).to_numpy() for k in range(kinds)])
    whole = bucket == -1
    rows = seen[:, whole].sum(axis=1)
    order = np.argsort(bucket)[int(whole.sum()) :]
    bucket, seen = bucket[order], seen[:, order]
    del got

    def ratios(used: list[int]) -> tuple[np.ndarray | None, float]:
        """The log-count ratios of a model of these folds, 0 for features that it leaves out; and the log odds of the labels."""
        (c0, c1), (n0, n1) = ([x[[2 * f + k for f in used]].sum(axis=0) for k in (0, 1)] for x in (seen, rows))
        rate = (n1 + 1) / (n0 + n1 + 2)
        if not n0 or not n1:
            return None, float(np.log(rate / (1 - rate)))
        ratio = np.log((c1 + 1) / (n1 + 2)) - np.log((c0 + 1) / (n0 + 2))
        return np.where((c0 + c1 >= MIN_ROWS) & (np.abs(ratio) >= min_ratio), ratio, 0.0), float(np.log(rate / (1 - rate)))

    used = [list(range(folds)), *([f for f in range(folds) if f != k] for k in range(folds) if folds > 1)]
    models = [ratios(u) for u in used]
    del seen
    some = np.zeros(len(bucket), bool)
    for ratio, _ in models:
        if ratio is not None:
            some |= ratio != 0
    bucket = bucket[some]
    active = np.zeros(BUCKETS, bool)
    active[bucket] = True
    weights = np.zeros(BUCKETS, np.float32)
    if folds == 1 and models[0][0] is None:
        return Model(weights, models[0][1], orders), np.zeros(0), np.zeros(0)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, 1, PART_BYTES):
                row, found = features(*columns(part, 1), active, orders)
                edges = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(found.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["kind", "found"])

    held = sample.mapInArrow(keep, "kind int, found array<int>").toArrow().to_batches()
    number = np.zeros(BUCKETS, np.int32)
    number[bucket] = np.arange(len(bucket), dtype=np.int32)
    col = np.empty(sum(len(part.column(1).flatten()) for part in held), np.int32)
    sizes, y, place, ends = [np.zeros(0, np.int64)], [np.zeros(0)], 0, [0]
    for f in range(folds):
        for part in held:
            kind = part.column(0).to_numpy()
            mine = part.filter(pa.array(kind // 2 == f))
            values = mine.column(1).flatten().to_numpy()
            col[place : place + len(values)] = number[values]
            place += len(values)
            sizes.append(np.diff(mine.column(1).offsets.to_numpy()).astype(np.int64))
            y.append((mine.column(0).to_numpy() % 2).astype(float))
        ends.append(sum(len(x) for x in y))
    del held
    y, edges = np.concatenate(y), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def solve(k: int) -> tuple[np.ndarray, float]:
        ratio, odds = models[k]
        if ratio is None:
            return np.zeros(len(bucket)), odds
        spans = [(ends[f], ends[f + 1]) for f in used[k]]
        w, b = _learn.logistic(_learn.Sparse(col, edges, len(bucket), ratio[some], spans), np.concatenate([y[a:z] for a, z in spans]), l2=1e-4)
        return w * ratio[some], b

    w, b = solve(0)
    weights[bucket] = w.astype(np.float32)
    scores = np.zeros(len(y) if folds > 1 else 0)
    for f in range(folds if folds > 1 else 0):
        w, odds = solve(f + 1)
        x = _learn.Sparse(col, edges, len(bucket), np.ones(len(bucket)), [(ends[f], ends[f + 1])])
        scores[ends[f] : ends[f + 1]] = _learn.sigmoid(x.dot(w) + odds)
    return Model(weights, b, orders), y[: len(scores)], scores


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, orders: tuple[int, ...] = ORDERS, min_ratio: float = MIN_RATIO) -> Model:
    """Learns from labelled rows outside the held-out fold. Without any, or with one class only, every text gets the
    smoothed rate of the labels (a half where there are none)."""
    return _fit(docs, labels, label_col, id_col, text_col, max_rows, orders, min_ratio, 1)[0]


def train_stage(docs: DataFrame, labels: DataFrame, keep: float = 0.99, folds: int = 3, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS, orders: tuple[int, ...] = ORDERS, min_ratio: float = MIN_RATIO) -> tuple[Model, float]:
    """The model of train, and a threshold that leaves the share keep of clean documents, each scored by a model that
    hasn't seen it: cross-validation on labels outside the held-out fold. Of the thresholds that catch as many toxic
    documents as the lowest such one, the one in the middle (of the log odds) is taken, so that where the classes lie
    apart a little difference between the models parts neither. 0.5 at most, and where there are no clean documents.

    No more than max_rows scores are held."""
    model, y, scores = _fit(docs, labels, label_col, id_col, text_col, max_rows, orders, min_ratio, folds)
    return model, _between(scores[y == 0], scores[y > 0], keep)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and score, 0 to 1. Null and empty texts get the score of no feature. Ids may repeat
    or be null; other columns are ignored. No shuffle; the model has a fixed size."""
    ship(docs.sparkSession)
    at = np.flatnonzero(model.weights)
    sent, value, b, orders = at.astype(np.int32), model.weights[at], model.intercept, model.orders

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(BUCKETS)
        weights[sent] = value
        active = weights != 0
        for batch in batches:
            for part in split_batch(batch, 1, PART_BYTES):
                row, found = features(*columns(part, 1), active, orders)
                z = np.bincount(row, weights[found], part.num_rows) + b
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_learn.sigmoid(z))], names=["id", "score"])

    typed = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return typed.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows whose score is below the threshold, unchanged, with all their columns and nothing else."""
    ship(docs.sparkSession)
    at = np.flatnonzero(model.weights)
    sent, value, b, orders = at.astype(np.int32), model.weights[at], model.intercept, model.orders
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(BUCKETS)
        weights[sent] = value
        active = weights != 0
        for batch in batches:
            for part in split_batch(batch, place, PART_BYTES):
                row, found = features(*columns(part, place), active, orders)
                z = np.bincount(row, weights[found], part.num_rows) + b
                yield part.filter(pa.array(_learn.sigmoid(z) < threshold))

    return docs.mapInArrow(run, docs.schema)


def _between(clean: np.ndarray, toxic: np.ndarray, keep: float) -> float:
    if not len(clean):
        return 0.5
    low = float(np.nextafter(np.sort(clean)[int(np.ceil(keep * len(clean))) - 1], 1))
    high = toxic[toxic >= low].min() if (toxic >= low).any() else low
    if low >= 0.5:
        return 0.5
    odds = lambda p: np.log(max(p, 1e-12) / max(1 - p, 1e-12))
    return min(0.5, max(low, float(_learn.sigmoid(np.array((odds(low) + odds(min(high, 0.5))) / 2)))))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id", _learn.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
