"""Quality classifier: a sparse ensemble of rules (Friedman and Popescu, 2008).

Small boosted trees are grown over statistics of the text; every path from a root to a node is a rule, a conjunction of
thresholds. A logistic fit with a lasso penalty weighs the rules and drops most. The rules that stay are compiled into
one Spark column expression, so scoring runs without Python and without a shuffle.

Learning uses at most max_rows labelled rows, of which the driver gets the statistics, never the texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm import _learn
from pairloom.llm._common import table
from pairloom.llm.quality_rules import STOP_WORDS

MAX_ROWS = 20_000
TREES = 40
DEPTH = 3
BINS = 64
#: Rules that the score may have; the heaviest stay.
MAX_RULES = 64

_PUNCTUATION = "!\"'(),-./:;?[]{}~_@\\^`+="
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
STATISTICS = (
    "log_words", "mean_word", "upper", "digit", "symbol", "punctuation", "bang", "bar", "stop", "distinct_words",
    "distinct_lines", "words_per_line", "word_punctuation",
)


def statistics(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """carry columns and the statistics (double), all 0 for a text without words; a null text is empty."""
    held = [F.col(f"`{c}`") for c in carry]
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__t")
    df = docs.select(*held, t).select(
        *held,
        "__t",
        F.filter(F.split(F.translate("__t", "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "").alias("__w"),
        F.filter(F.split("__t", "\n"), lambda x: x != "").alias("__l"),
    )
    count = lambda chars: (F.length("__t") - F.length(F.translate("__t", chars, ""))).cast("double")
    df = df.select(
        *held,
        F.size("__w").cast("double").alias("__n"),
        F.size("__l").cast("double").alias("__nl"),
        F.length(F.translate("__t", " \t\n\x0b\x0c\r", "")).cast("double").alias("__c"),
        count(_LETTERS).alias("__upper"),
        count("0123456789").alias("__digit"),
        count("#*$%&|<>").alias("__symbol"),
        count(_PUNCTUATION).alias("__punct"),
        count("!").alias("__bang"),
        count("|").alias("__bar"),
        F.size(F.filter("__w", lambda w: w.isin(*STOP_WORDS))).cast("double").alias("__stop"),
        F.size(F.array_distinct("__w")).cast("double").alias("__dw"),
        F.size(F.array_distinct("__l")).cast("double").alias("__dl"),
    )

    def per(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return df.select(
        *held,
        F.log1p("__n").alias("log_words"),
        per("__c", "__n").alias("mean_word"),
        per("__upper", "__c").alias("upper"),
        per("__digit", "__c").alias("digit"),
        per("__symbol", "__c").alias("symbol"),
        per("__punct", "__c").alias("punctuation"),
        per("__bang", "__n").alias("bang"),
        per("__bar", "__n").alias("bar"),
        per("__stop", "__n").alias("stop"),
        per("__dw", "__n").alias("distinct_words"),
        per("__dl", "__nl").alias("distinct_lines"),
        per("__n", "__nl").alias("words_per_line"),
        per("__punct", "__n").alias("word_punctuation"),
    )


#: (statistic, above, threshold): value > threshold if above, else value <= threshold
Test = tuple[int, bool, float]


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[tuple[tuple[Test, ...], float], ...]
    intercept: float

    def score(self) -> Column:
        """Over the columns of STATISTICS."""
        z = F.lit(self.intercept)
        for tests, weight in self.rules:
            hold = None
            for k, above, limit in tests:
                c = F.col(STATISTICS[k])
                one = c > F.lit(limit) if above else c <= F.lit(limit)
                hold = one if hold is None else hold & one
            z = z + F.when(hold, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _grow(code: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, rows: np.ndarray, path: tuple, out: list) -> np.ndarray:
    """Adds the paths below to out; returns the tree's value for each row (by row number, 0 elsewhere)."""
    value = np.zeros(len(g))
    value[rows] = g[rows].sum() / (h[rows].sum() + 1.0)
    if path:
        out.append(path)
    if not depth or len(rows) < 10:
        return value
    best, where = 1e-6, None
    total_g, total_h = g[rows].sum(), h[rows].sum()
    for k in range(code.shape[1]):
        gs = np.bincount(code[rows, k], g[rows], BINS + 1).cumsum()
        hs = np.bincount(code[rows, k], h[rows], BINS + 1).cumsum()
        n = np.bincount(code[rows, k], minlength=BINS + 1).cumsum()
        gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
        gain[(n < 5) | (n > len(rows) - 5)] = 0
        gain = gain[: len(cuts[k])]
        if len(gain) and gain.max() > best:
            best, where = float(gain.max()), (k, int(gain.argmax()))
    if where is None:
        return value
    k, at = where
    limit = float(cuts[k][at])
    low = code[rows, k] <= at
    value[rows] = 0
    value += _grow(code, cuts, g, h, depth - 1, rows[low], (*path, (k, False, limit)), out)
    value += _grow(code, cuts, g, h, depth - 1, rows[~low], (*path, (k, True, limit)), out)
    return value


def _tidy(path: tuple[Test, ...]) -> tuple[Test, ...]:
    """One test per statistic and side: the narrowest."""
    kept: dict[tuple[int, bool], float] = {}
    for k, above, limit in path:
        old = kept.get((k, above))
        kept[k, above] = limit if old is None else max(old, limit) if above else min(old, limit)
    return tuple((k, above, kept[k, above]) for k, above in sorted(kept))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 0, l1: float = 2e-3) -> Ensemble:
    """x: statistics, one row per text; y: 0 or 1."""
    empty = np.zeros((len(y), 0))
    if len(y) < 20 or y.min() == y.max():
        return Ensemble((), _learn.logistic(_learn.Dense(empty), y)[1])
    # Limits lie halfway between neighbouring values, rounded to few digits, so that a rounding error decides nothing.
    cuts = []
    for k in range(x.shape[1]):
        v = np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)))
        cuts.append(np.unique(np.round((v[1:] + v[:-1]) / 2, 6))[:BINS])
    code = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    rng = np.random.default_rng(seed)
    z, paths = np.zeros(len(y)), []
    for _ in range(TREES):
        p = _learn.sigmoid(z)
        rows = np.sort(rng.choice(len(y), max(10, len(y) // 2), replace=False))
        z += 0.3 * _grow(code, cuts, y - p, p * (1 - p), DEPTH, rows, (), paths)
    rules = list(dict.fromkeys(_tidy(p) for p in paths))

    def holds(rule) -> np.ndarray:
        out = np.ones(len(y), bool)
        for k, above, limit in rule:
            out &= x[:, k] > limit if above else x[:, k] <= limit
        return out

    held = np.stack([holds(r) for r in rules], axis=1) if rules else empty
    rate = held.mean(axis=0)
    some = (rate > 0) & (rate < 1)
    rules, held, rate = [r for r, s in zip(rules, some, strict=True) if s], held[:, some], rate[some]
    scale = 1 / np.sqrt(np.maximum(rate * (1 - rate), 0.01))
    w, b = _learn.logistic(_learn.Dense(held * scale), y, l1=l1, steps=600)
    w = w * scale
    top = [k for k in np.argsort(-np.abs(w))[:MAX_RULES] if abs(w[k]) > 1e-3]
    if len(top) < int((np.abs(w) > 1e-3).sum()):
        w2, b = _learn.logistic(_learn.Dense(held[:, top] * scale[top]), y, l1=l1, steps=600)
        return Ensemble(tuple((rules[k], round(float(v * scale[k]), 9)) for k, v in zip(top, w2, strict=True) if abs(v) > 1e-6), round(b, 9))
    return Ensemble(tuple((rules[k], round(float(w[k]), 9)) for k in top), round(b, 9))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Ensemble:
    """Learns from at most max_rows labelled rows outside the held-out fold. With fewer than 20, or one class only,
    every text gets the smoothed rate of the labels (a half where there are none)."""
    sample = _learn.labelled(
        docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("text")),
        _learn.sample_labels(labels, label_col, max_rows, id_col), "__id",
    )
    rows = statistics(sample, carry=("__id", "__label")).toPandas().sort_values(["__id", *STATISTICS], kind="stable")
    return fit(rows[list(STATISTICS)].to_numpy(float).reshape(len(rows), len(STATISTICS)), (rows["__label"].to_numpy() > 0).astype(float))


def score(docs: DataFrame, model: Ensemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, the statistics and score, 0 to 1. Ids may repeat or be null; other columns are
    ignored, so names can't clash."""
    base = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("text"))
    out = statistics(base, carry=("__id",))
    return out.withColumn("score", model.score()).withColumnRenamed("__id", id_col)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id", _learn.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
