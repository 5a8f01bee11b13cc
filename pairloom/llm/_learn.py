"""Labelled samples and logistic fits that the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm._common import hex_crc_bucket


def held_out(id_col: str):
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 5, is 0."""
    return hex_crc_bucket(id_col) == 0


def sample_labels(labels: DataFrame, label_col: str, max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """(__lid, __label) of at most max_rows rows that may be learnt from, by the order of a hash of their ids.

    Rows without id or label are left out. Of several labels of one id the largest counts.
    """
    ok = labels.select(F.col(f"`{id_col}`").alias("__lid"), F.col(f"`{label_col}`").cast("int").alias("__label"))
    ok = ok.where("__lid is not null and __label is not null").where(~held_out("__lid"))
    ok = ok.groupBy("__lid").agg(F.max("__label").alias("__label"))
    return ok.orderBy(F.xxhash64(F.lit(5), "__lid"), "__lid").limit(max_rows)


def labelled(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is in the sample, with __label. The sample's bound makes it small enough to send."""
    return docs.join(F.broadcast(sample), F.col(f"`{id_col}`") == F.col("__lid")).drop("__lid")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


#: Non-zeros of a sparse table that are worked on at once; besides them it holds four bytes for each.
AT_ONCE = 1 << 20


class Sparse:
    """Rows of column numbers with a value for each column: x[i, c] = scale[c] where c is listed.

    col: the column numbers of all rows end to end, int32; edges: where each row begins, and the end; spans: the ranges
    of rows that count, one after the other, all by default. Tables of one col and edges share them."""

    def __init__(self, col: np.ndarray, edges: np.ndarray, n_cols: int, scale: np.ndarray, spans: list[tuple[int, int]] | None = None):
        self.n_cols, self.scale, self.col, self.edges = n_cols, scale, col, edges
        self.n, self.parts = 0, []
        for lo, hi in [(0, len(edges) - 1)] if spans is None else spans:
            # whole rows, so that each part has about AT_ONCE numbers
            wanted = np.arange(int(edges[lo]), int(edges[hi]) + AT_ONCE, AT_ONCE)
            cuts = np.unique(np.concatenate([[lo], lo + np.searchsorted(edges[lo : hi + 1], wanted), [hi]]).clip(lo, hi)).tolist()
            self.parts += [(self.n + a - lo, a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            self.n += hi - lo

    def _parts(self):
        for place, a, b in self.parts:
            at = self.edges[a : b + 1]
            yield place, place + b - a, self.col[at[0] : at[-1]], at[:-1] - at[0], np.diff(at)

    def dot(self, w: np.ndarray) -> np.ndarray:
        v, out = w * self.scale, np.zeros(self.n)
        for a, b, col, start, size in self._parts():
            some = size > 0  # reduceat gives an empty row its neighbour's first value
            if some.any():
                out[a:b][some] = np.add.reduceat(v[col], start[some])
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n_cols)
        for a, b, col, _, size in self._parts():
            out += np.bincount(col, np.repeat(g[a:b], size), self.n_cols)
        return out * self.scale


class Dense:
    def __init__(self, x: np.ndarray):
        self.x, (self.n, self.n_cols) = x, x.shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w

    def back(self, g: np.ndarray) -> np.ndarray:
        return self.x.T @ g


def logistic(x: Sparse | Dense, y: np.ndarray, l1: float = 0.0, l2: float = 0.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic fit with penalties: by limited-memory quasi-Newton steps until the gradient
    is small, or, where l1 makes the loss kinked, by accelerated proximal gradient steps.

    The penalties are on the mean loss; the intercept isn't penalised, and starts at the rate of the labels."""
    rate = (y.sum() + 1) / (len(y) + 2)
    w, b = np.zeros(x.n_cols), float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return w, b
    if not l1:
        return _smooth_fit(x, y, b, l2, steps)
    v = np.random.default_rng(1).normal(size=x.n_cols)
    top = 1.0
    for _ in range(20):
        v = x.back(x.dot(v))
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    rate_w = 1 / (0.25 * 2 * (top / len(y) + 1) + l2)
    zw, zb, t = w.copy(), b, 1.0
    for _ in range(steps):
        g = (sigmoid(x.dot(zw) + zb) - y) / len(y)
        nw = zw - rate_w * (x.back(g) + l2 * zw)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate_w * l1, 0)
        nb = zb - rate_w * float(g.sum())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zw, zb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


#: Steps whose curvature is remembered, and the length of the gradient, against that of the first, at which a fit ends.
_REMEMBERED = 8
_SMALL = 1e-4


def _smooth_fit(x: Sparse | Dense, y: np.ndarray, b: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """The fit without l1, from weights of 0 (Nocedal, 1980). A step is halved until the loss falls enough."""

    def loss(z: np.ndarray, w: np.ndarray) -> float:
        return float(np.mean(np.logaddexp(0, z) - y * z) + l2 / 2 * (w @ w))

    def slope(z: np.ndarray, w: np.ndarray) -> np.ndarray:
        g = (sigmoid(z) - y) / len(y)
        return np.append(x.back(g) + l2 * w, g.sum())

    at = np.append(np.zeros(x.n_cols), b)
    z = np.full(x.n, b)
    value, g = loss(z, at[:-1]), slope(z, at[:-1])
    end, past = _SMALL * float(np.linalg.norm(g)), []
    for _ in range(steps):
        if np.linalg.norm(g) <= end:
            break
        way, used = -g, []
        for s, d, r in reversed(past):
            used.append(r * (s @ way))
            way = way - used[-1] * d
        if past:
            s, d, r = past[-1]
            way = way / (r * (d @ d))
        else:
            way = way / max(1.0, float(np.linalg.norm(g)))
        for (s, d, r), u in zip(past, reversed(used), strict=True):
            way = way + (u - r * (d @ way)) * s
        fall, dz, t = float(g @ way), x.dot(way[:-1]) + way[-1], 1.0
        # the scores are linear in the step, so that a shorter one needs no pass over the rows
        while t > 1e-10 and loss(z + t * dz, at[:-1] + t * way[:-1]) > value + 1e-4 * t * fall:
            t /= 2
        if t <= 1e-10:
            break
        at, z = at + t * way, z + t * dz
        new = slope(z, at[:-1])
        s, d = t * way, new - g
        if (bend := float(s @ d)) > 0:
            past = [*past, (s, d, 1 / bend)][-_REMEMBERED:]
        value, g = loss(z, at[:-1]), new
    return at[:-1], float(at[-1])
