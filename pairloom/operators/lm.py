"""Count-based language models, word ranks and the simplicity score."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from pairloom._ship import ship
from pairloom.functions.features import perplexity
from pairloom.functions.text import bound, word_array
from pairloom.operators.words import split_words

#: Words that the rank table may have; its size is bounded by it, so it may be sent to every executor.
VOCABULARY = 100_000
#: Words whose n-grams are counted at once.
_WORDS_AT_ONCE = 1 << 20


def words(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    return texts.select(*keys, F.explode(word_array(F.lower(F.col(text_col)))).alias("word"))


def word_ranks(texts: DataFrame, text_col: str = "text", vocabulary: int = VOCABULARY) -> DataFrame:
    """(word, rank): the most frequent words, rank from 0; ties by the word."""
    counts = words(texts, [], text_col).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc(), "word").limit(vocabulary)
    # vocabulary rows at most, so one task may number them
    return top.select("word", (F.row_number().over(Window.orderBy(F.col("n").desc(), "word")) - 1).cast("int").alias("rank"))


def rank_quantiles(ranks: DataFrame, q: float) -> Callable[[Column], Column]:
    """The q-quantile of log(1 + rank) over the words of a text that have a rank; null where no word has. The table of
    ranks is bounded, so it goes along with the function and texts stay where they are."""
    ship(ranks.sparkSession)
    table = ranks.select("word", "rank").toArrow().combine_chunks()
    known, rank = table.column("word").combine_chunks(), table.column("rank").to_numpy().astype(np.float64)

    def run(texts: pa.Array) -> pa.Array:
        words = split_words(texts)
        ends, place = words.offsets.to_numpy().astype(np.int64), pc.index_in(words.flatten(), known)
        row = np.repeat(np.arange(len(words)), np.diff(ends))
        has = place.is_valid().to_numpy(zero_copy_only=False)
        row, value = row[has], rank[place.drop_null().to_numpy()]
        value = np.log1p(value[np.lexsort((value, row))])
        n = np.bincount(row, minlength=len(words))
        first, at = np.cumsum(n) - n, (n - 1) * q
        some = n > 0
        low, high = np.floor(at[some]).astype(np.int64), np.ceil(at[some]).astype(np.int64)
        below, above = value[first[some] + low], value[first[some] + high]
        out = np.zeros(len(words))
        out[some] = np.where(below == above, below, (high - at[some]) * below + (at[some] - low) * above)
        return pa.array(out, mask=~some)

    f = F.arrow_udf(run, DoubleType())
    return lambda c: f(F.lower(c))


def rank_quantile(texts: DataFrame, keys: list[str], text_col: str, ranks: DataFrame, q: float, name: str) -> DataFrame:
    """keys and the rank_quantiles of the text."""
    return texts.select(*keys, rank_quantiles(ranks, q)(F.col(text_col)).alias(name))


def lexical_complexity(texts: DataFrame, keys: list[str], text_col: str, ranks: DataFrame, vocabulary: int = VOCABULARY) -> DataFrame:
    out = rank_quantile(texts, keys, text_col, ranks, 0.75, "lexical_complexity")
    return out.withColumn("lexical_complexity", F.coalesce("lexical_complexity", F.log1p(F.lit(float(vocabulary)))))


def rank_quantile_ratio(pairs: DataFrame, keys: list[str], ranks: DataFrame, q: float = 0.9) -> DataFrame:
    """Quantile of the target over that of the source; 1 where either has no known word or the source's is 0."""
    at = rank_quantiles(ranks, q)
    both = pairs.select(*keys, at(F.col("complex")).alias("a"), at(F.col("simple")).alias("b"))
    return both.select(*keys, F.coalesce(F.try_divide("b", "a"), F.lit(1.0)).alias("ratio"))


def ngram_counts(texts: DataFrame, text_col: str, order: int) -> DataFrame:
    """(gram, n) of one order, with marks at a text's start and end. Grams are counted within some texts at a time before
    they are shuffled."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = split_words(b.column(0))
            ends, first = words.offsets.to_numpy().astype(np.int64), 0
            while first < len(words):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + _WORDS_AT_ONCE, side="right")) - 1)
                yield _count_grams(words[first:last].flatten(), np.diff(ends[first : last + 1]), order)
                first = last

    known = texts.select(F.lower(F.col(text_col)).alias("t")).where("t is not null")
    return known.mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _count_grams(flat: pa.Array, sizes: np.ndarray, order: int) -> pa.RecordBatch:
    coded = pa.concat_arrays([pa.array(["<s>", "</s>"]), flat]).dictionary_encode()
    code, many = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    # a text's words between its marks
    text = np.repeat(np.arange(len(sizes)), sizes + 2)
    marked = np.empty(len(text), np.int64)
    begin = np.cumsum(sizes + 2) - (sizes + 2)
    inner = np.ones(len(text), bool)
    inner[begin] = inner[begin + sizes + 1] = False
    marked[inner], marked[begin], marked[begin + sizes + 1] = code[2:], code[0], code[1]
    at = np.arange(max(0, len(text) - order + 1))
    at = at[text[at] == text[at + order - 1]]
    # the number of a gram: that of the gram one shorter, and the word after it
    which, one = marked[at], None
    for k in range(1, order):
        _, one, which = np.unique(which * many + marked[at + k], return_index=True, return_inverse=True)
    if one is None:
        _, one, which = np.unique(which, return_index=True, return_inverse=True)
    parts = [coded.dictionary.take(pa.array(marked[at[one] + k])) for k in range(order)]
    grams = pc.binary_join_element_wise(*parts, " ") if order > 1 else parts[0]
    return pa.RecordBatch.from_arrays([grams, pa.array(np.bincount(which, minlength=len(one)).astype(np.int64))], names=["gram", "n"])


def _row_counts(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, word and k: how often each row's text has the word. Counted within the row, without a shuffle."""
    ship(texts.sparkSession)
    df = texts.select(*keys, F.lower(F.col(text_col)).alias("__t"))
    out = StructType([*[df.schema[k] for k in keys], StructField("word", StringType()), StructField("k", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = split_words(b.column(len(keys)))
            ends, first = words.offsets.to_numpy().astype(np.int64), 0
            while first < len(words):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + _WORDS_AT_ONCE, side="right")) - 1)
                coded = words[first:last].flatten().dictionary_encode()
                many = max(1, len(coded.dictionary))
                row = np.repeat(np.arange(first, last), np.diff(ends[first : last + 1]))
                one, n = np.unique(row * many + coded.indices.to_numpy(), return_counts=True)
                cols = [c.take(pa.array(one // many)) for c in b.columns[: len(keys)]]
                yield pa.RecordBatch.from_arrays([*cols, coded.dictionary.take(pa.array(one % many)), pa.array(n.astype(np.int64))], names=out.fieldNames())
                first = last

    return df.mapInArrow(run, out)


def log_probabilities(texts: DataFrame, keys: list[str], text_col: str, corpus: DataFrame | None = None) -> DataFrame:
    """keys, log10, n_words and perplexity under an add-one unigram model of the corpus, which is texts by default."""
    tokens = _row_counts(texts, keys, text_col)
    train = tokens if corpus is None else _row_counts(corpus, [], text_col)
    counts = train.groupBy("word").agg(F.sum("k").alias("n"))
    total = counts.agg(F.sum("n").alias("__n"), F.count(F.lit(1)).alias("__v"))
    seen = tokens.join(counts, "word", "left").crossJoin(F.broadcast(total))
    p = (F.coalesce("n", F.lit(0)) + 1) / (F.col("__n") + F.col("__v") + 1)
    got = seen.groupBy(*keys).agg(F.sum(F.col("k") * F.log10(p)).alias("log10"), F.sum("k").alias("n_words"))
    return got.withColumn("perplexity", perplexity(F.col("log10"), F.col("n_words") + 1))


#: Least log10 probability per character.
SLOPES = {"en": -0.6, "fr": -0.6, "es": -0.8, "it": -0.8}


def low_probability(log10: Column, length: Column, lang: Column) -> Column:
    """True where a text is to go; a language without a limit keeps all."""
    limit = F.create_map(*[x for k, v in SLOPES.items() for x in (F.lit(k), F.lit(v))])[lang]
    return F.coalesce(F.try_divide(log10, length) < limit, F.lit(False))


def odd_perplexity(value: Column, low: float = 100.0, high: float = 1500.0) -> Column:
    return (value <= low) | (value >= high)


QUANTILES = 100


def fit_simplicity(pairs: DataFrame, features: dict[str, Column]) -> dict[str, list[float]]:
    """For each feature its quantiles over the pairs, negated: QUANTILES + 1 numbers each."""
    at = [i / QUANTILES for i in range(QUANTILES + 1)]
    row = pairs.agg(*[F.percentile_approx(-c, at, 10_000).alias(n) for n, c in features.items()]).first()
    return {n: list(row[n]) for n in features}


def simplicity(features: dict[str, Column], model: dict[str, list[float]]) -> Column:
    """Mean over the features of the place of their negated value among the quantiles, 0 to 1."""

    def place(c: Column, cuts: list[float]) -> Column:
        table, coarse = (F.array(*[F.lit(float(x)) for x in some]) for some in (cuts, cuts[::10]))

        def at(v: Column) -> Column:
            # the cuts rise: every tenth is tried, and then the nine between two of them
            tens = F.size(F.filter(coarse, lambda x: x < v))
            units = F.size(F.filter(F.slice(table, F.greatest(10 * tens - 9, F.lit(1)), 10), lambda x: x < v))
            return bound(F.when(tens > 0, 10 * (tens - 1) + units).otherwise(0), lambda below: among(v, below))

        def among(v: Column, below: Column) -> Column:
            low, high = F.get(table, below - 1), F.get(table, below)
            inside = (below - 1) + F.coalesce(F.try_divide(v - low, high - low), F.lit(0.0))
            return F.when(below == 0, 0.0).when(below > QUANTILES, 1.0).otherwise(inside / QUANTILES)

        return bound(-c, at)

    parts = [place(c, model[n]) for n, c in features.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out / len(parts)
