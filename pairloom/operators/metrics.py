"""Evaluation: run tables with confidence intervals, readability, n-gram metrics, parametrisation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from pairloom._ship import ship
from pairloom.functions.features import interval_text, t_quantile
from pairloom.functions.text import bound, syllables, truncate, word_array
from pairloom.operators.words import split_words


def last_runs(runs: DataFrame, group: Sequence[str], order: str, keep: int = 5, whole: Sequence[int] = (8, 10)) -> DataFrame:
    """The last runs of each group, or all where there are just so many as whole lists."""
    w = Window.partitionBy(*group)
    out = runs.withColumn("__n", F.count(F.lit(1)).over(w))
    out = out.withColumn("__r", F.row_number().over(w.orderBy(F.col(order).desc())))
    return out.where(F.col("__n").isin(*whole) | (F.col("__r") <= keep)).drop("__n", "__r")


def mean_intervals(runs: DataFrame, group: Sequence[str], value: str, prefix: str = "") -> DataFrame:
    """mean, ci (half width of the 95 % interval, null for one run), n and text of each group. NaN counts in the mean,
    not in the interval."""
    clean = F.when(~F.isnan(value), F.col(value))
    out = runs.groupBy(*group).agg(
        F.avg(value).alias(prefix + "mean"), F.stddev_samp(clean).alias("__s"), F.count(clean).alias("__k"), F.count(F.lit(1)).alias(prefix + "n")
    )
    half = F.col("__s") / F.sqrt("__k") * t_quantile(F.col("__k") - 1)
    out = out.withColumn(prefix + "ci", half)
    text = interval_text(F.col(prefix + "mean"), F.col(prefix + "ci"), F.col(prefix + "n").cast("int"))
    return out.withColumn(prefix + "text", text).drop("__s", "__k")


def fkgl(sentences: DataFrame, text_col: str, group: Sequence[str]) -> DataFrame:
    """Flesch-Kincaid grade of each group of sentences (Kincaid et al., 1975)."""
    n = sentences.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_sentences"),
        F.sum(F.size(word_array(text_col))).cast("long").alias("n_words"),
        F.sum(syllables(text_col)).cast("long").alias("n_syllables"),
    )
    grade = 0.39 * F.col("n_words") / F.col("n_sentences") + 11.8 * F.col("n_syllables") / F.col("n_words") - 15.59
    return n.withColumn("fkgl", F.when(F.col("n_words") > 0, grade))


#: Words whose n-grams are counted at once.
_WORDS_AT_ONCE = 1 << 18


def _by_row(rows: pa.StructArray, stats: Callable[..., list[np.ndarray]], top: int) -> pa.ListArray:
    """For each row stats(counts of each side) summed over the distinct n-grams of the row, for n from 1 to top."""
    sides = rows.flatten()
    sizes = np.stack([pc.list_value_length(s).to_numpy() for s in sides], axis=1).astype(np.int64)
    out, first, ends = [], 0, np.cumsum(sizes.sum(axis=1))
    while first < len(rows):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + _WORDS_AT_ONCE, side="right")))
        some = slice(first, last)
        out.append(_count_rows([s[some].flatten() for s in sides], sizes[some], stats, top))
        first = last
    flat = np.concatenate(out) if out else np.zeros((0, 1), np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def _count_rows(words: list[pa.Array], sizes: np.ndarray, stats: Callable[..., list[np.ndarray]], top: int) -> np.ndarray:
    n, k = sizes.shape
    coded = pa.chunked_array(words, pa.string()).combine_chunks().dictionary_encode()
    word, many = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    row = np.concatenate([np.repeat(np.arange(n), sizes[:, s]) for s in range(k)])
    side = np.repeat(np.arange(k), sizes.sum(axis=0))
    text = row * k + side
    # the number of an n-gram within its row: that of the n-gram one shorter, and the word after it
    at, before, found = np.arange(len(word)), row, []
    for length in range(1, top + 1):
        if length > 1:
            on = at + length - 1 < len(word)
            at, before = at[on], before[on]
            same = text[at] == text[at + length - 1]
            at, before = at[same], before[same]
        _, one, which = np.unique(before * many + word[at + length - 1], return_index=True, return_inverse=True)
        counts = [np.bincount(which[side[at] == s], minlength=len(one)) for s in range(k)]
        found += [np.bincount(row[at[one]], c, n).astype(np.int64) for c in stats(*counts)]
        before = which
    return np.stack(found, axis=1)


def gram_stats(sides: Sequence[Column | str], stats: Callable[..., list[np.ndarray]], top: int = 4) -> Column:
    """array<long>, for n from 1 to top the stats of the lower-cased n-grams of a row: each a sum over the distinct
    n-grams of a function of their counts on the sides. A null side has no words. Everything stays within the row."""
    texts = [F.coalesce(F.lower(F.col(s) if isinstance(s, str) else s), F.lit("")) for s in sides]

    def run(rows: pa.Array) -> pa.Array:
        words = [split_words(x) for x in rows.flatten()]
        return _by_row(pa.StructArray.from_arrays(words, names=[f"s{k}" for k in range(len(words))]), stats, top)

    return F.arrow_udf(run, ArrayType(LongType()))(F.struct(*[x.alias(f"s{k}") for k, x in enumerate(texts)]))


def _bleu_stats(h: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
    return [np.minimum(h, r), h, r]


def _sari_stats(s: np.ndarray, y: np.ndarray, r: np.ndarray) -> list[np.ndarray]:
    keep, drop, new = np.minimum(s, y), np.maximum(s - y, 0), (y > 0) & (s == 0)
    return [
        new, new & (r > 0), (r > 0) & (s == 0), keep, np.minimum(keep, r), np.minimum(s, r),
        drop, np.minimum(drop, np.maximum(s - r, 0)),
    ]


def bleu_counts(pairs: DataFrame, hypothesis: str, reference: str) -> DataFrame:
    """(n, matches, total): clipped n-gram matches of the corpus (Papineni et al., 2002). An n without n-grams on
    either side has no row."""
    ship(pairs.sparkSession)
    each = pairs.select(gram_stats([hypothesis, reference], _bleu_stats).alias("g"))
    sums = each.agg(*[F.sum(F.get("g", F.lit(i))).alias(f"g{i}") for i in range(12)])
    of = lambda n: {"matches": F.col(f"g{3 * n}"), "total": F.col(f"g{3 * n + 1}"), "__r": F.col(f"g{3 * n + 2}")}
    rows = [F.struct(F.lit(n + 1).alias("n"), *[c.alias(k) for k, c in of(n).items()]) for n in range(4)]
    return sums.select(F.inline(F.array(*rows))).where((F.col("total") > 0) | (F.col("__r") > 0)).drop("__r")


def bleu(pairs: DataFrame, hypothesis: str, reference: str) -> DataFrame:
    """One row with bleu, 0 to 100; 0 where an order has no match."""
    c = bleu_counts(pairs, hypothesis, reference)
    n = lambda s: F.sum(F.size(word_array(s))).cast("double")
    lengths = pairs.agg(n(hypothesis).alias("h"), n(reference).alias("r"))
    score = c.agg(F.avg(F.ln(F.nullif(F.col("matches"), F.lit(0)) / F.nullif(F.col("total"), F.lit(0)))).alias("l"), F.min("matches").alias("least"), F.count(F.lit(1)).alias("k"))
    brevity = F.when(F.col("h") >= F.col("r"), F.lit(0.0)).otherwise(1 - F.col("r") / F.col("h"))
    value = F.when((F.col("k") == 4) & (F.col("least") > 0), 100 * F.exp(F.col("l") + brevity)).otherwise(F.lit(0.0))
    return score.crossJoin(F.broadcast(lengths)).select(value.alias("bleu"))


def sari_parts(source: Column | str, system: Column | str, reference: Column | str) -> Column:
    """struct<add, keep, delete>, 0 to 100 each: the F1 of added and of kept n-grams and the precision of deleted ones,
    means over n = 1 to 4 (Xu et al., 2016), for one reference. An undefined part counts as 0."""
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    f1 = lambda p, q: F.coalesce(F.try_divide(2 * p * q, p + q), F.lit(0.0))

    def parts(g: Column) -> Column:
        at = lambda n, i: F.get(g, F.lit(8 * n + i))
        add = [f1(share(at(n, 1), at(n, 0)), share(at(n, 1), at(n, 2))) for n in range(4)]
        keep = [f1(share(at(n, 4), at(n, 3)), share(at(n, 4), at(n, 5))) for n in range(4)]
        drop = [share(at(n, 7), at(n, 6)) for n in range(4)]
        mean = lambda x: (x[0] + x[1] + x[2] + x[3]) / 4 * 100
        return F.struct(mean(add).alias("add"), mean(keep).alias("keep"), mean(drop).alias("delete"))

    return bound(gram_stats([source, system, reference], _sari_stats), parts)


def with_sari_parts(rows: DataFrame, source: str, system: str, reference: str, name: str = "sari_parts") -> DataFrame:
    """The rows with a column of sari_parts."""
    ship(rows.sparkSession)
    return rows.withColumn(name, sari_parts(source, system, reference))


def sari(rows: DataFrame, source: str, system: str, reference: str) -> DataFrame:
    """The rows with sari, 0 to 100: the mean of the three parts. A row without any word gets 0."""
    out = with_sari_parts(rows, source, system, reference, "__p")
    return out.withColumn("sari", (F.col("__p.add") + F.col("__p.keep") + F.col("__p.delete")) / 3).drop("__p")


def baselines(rows: DataFrame) -> DataFrame:
    """rows(row_id, complex, simple array) to (baseline, row_id, complex, prediction, references): the source itself,
    the source without a fifth of its words, and each reference against the others."""
    base = lambda name, p: rows.select(F.lit(name).alias("baseline"), "row_id", "complex", p.alias("prediction"), F.col("simple").alias("references"))
    each = rows.select("row_id", "complex", "simple", F.posexplode("simple").alias("i", "prediction"))
    refs = each.where(F.size("simple") > 1).select(
        F.format_string("Reference %d", "i").alias("baseline"), "row_id", "complex", "prediction",
        F.filter("simple", lambda x, k: k != F.col("i")).alias("references"),
    )
    return base("Identity", F.col("complex")).unionByName(base("Truncate", truncate("complex"))).unionByName(refs)


def mean_features(pairs: DataFrame, features: dict[str, Column]) -> DataFrame:
    """(name, mean): the mean of each feature over all pairs, in one pass."""
    means = pairs.agg(*[F.avg(c).alias(n) for n, c in features.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("mean")) for n in features])
    return means.select(F.inline(rows))


def grid_search(pairs: DataFrame, features: dict[str, Column], low: float = 0.2, high: float = 1.5, step: float = 0.05) -> DataFrame:
    """(name, value): for each feature the value of the grid nearest to the pairs in mean square. One pass of sums."""
    sums = pairs.agg(*[x for n, c in features.items() for x in (F.avg(c).alias(n), F.avg(c * c).alias(n + "__2"))])
    steps = round((high - low) / step)
    grid = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.round(F.lit(low) + i * F.lit(step), 2))
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("m"), F.col(n + "__2").alias("m2")) for n in features])
    flat = sums.select(F.inline(rows)).withColumn("g", F.explode(grid))
    cost = F.col("m2") - 2 * F.col("g") * F.col("m") + F.col("g") * F.col("g")
    return flat.groupBy("name").agg(F.min_by("g", F.struct(F.round(cost, 9), "g")).alias("value"))
