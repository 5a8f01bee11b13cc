"""Features of sentence pairs, their buckets and control tokens; score arithmetic."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairloom.functions import edit
from pairloom.functions.text import without_control_tokens

#: Two-sided 95 % quantiles of Student's t by degrees of freedom, 1 to 30.
T_975 = (
    12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139, 2.200985,
    2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963, 2.079614, 2.073873,
    2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272,
)
Z_975 = 1.959964


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def bucket(v: Column, width: float = 0.05) -> Column:
    """The nearest multiple of width, halves to even."""
    return F.round(F.rint(v / width) * F.lit(width), 10)


def ratio(simple: Column, complex_: Column, most: float = 2.0) -> Column:
    return F.least(safe_divide(simple, complex_), F.lit(most))


def token(name: str, v: Column, short: bool = False) -> Column:
    return F.concat(F.lit(f"<{name[:4].lower() if short else name.upper()}_"), v.cast("string"), F.lit(">"))


def length_ratio(complex_: Column, simple: Column) -> Column:
    return ratio(F.length(simple), F.length(complex_))


def harmonic_mean(values: Sequence[Column], weights: Sequence[float] | None = None) -> Column:
    """Weighted; 0 as soon as one value is 0."""
    weights = [1.0] * len(values) if weights is None else weights
    parts = [F.lit(float(w)) / F.nullif(v, F.lit(0.0)) for v, w in zip(values, weights, strict=True)]
    return F.coalesce(F.lit(float(sum(weights))) / reduce(lambda a, b: a + b, parts), F.lit(0.0))


def combine_metrics(bleu: Column, sari: Column, fkgl: Column, weights: Sequence[float] = (1, 1, 1)) -> Column:
    """1 minus the harmonic mean of bleu within 0..100, sari within 0..60 and fkgl within 0..20 turned round."""
    clamp = lambda c, top: F.least(F.greatest(c, F.lit(0.0)), F.lit(float(top))) / F.lit(float(top))
    return F.lit(1.0) - harmonic_mean([clamp(bleu, 100), clamp(sari, 60), F.lit(1.0) - clamp(fkgl, 20)], weights)


def t_quantile(df: Column) -> Column:
    """For the 95 % interval; the normal quantile beyond 30 degrees of freedom."""
    table = F.array(*[F.lit(t) for t in T_975])
    return F.when(df < 1, None).when(df <= len(T_975), F.get(table, df.cast("int") - 1)).otherwise(F.lit(Z_975))


def interval_text(mean: Column, half: Column, n: Column) -> Column:
    return F.format_string("%.2f±%.2f (%d)", mean, half, n)


def perplexity(log10: Column, length: Column) -> Column:
    return F.round(F.pow(F.lit(10.0), -log10 / length), 1)


def dataset_language(name: Column) -> Column:
    """The _xx_ or -xx part of a dataset's or model's name; English where none is given."""
    found = F.regexp_extract(name, "[_-](en|fr|es|pt|de|it)(?:[_-]|$)", 1)
    return F.when(found != "", found).otherwise(F.lit("en"))


@dataclass(frozen=True)
class Preprocessor:
    """A control token: its value for a pair, the ratio asked for when there is no target, and where it stands."""

    name: str
    value: Callable[[Column, Column], Column]
    target: float = 0.8
    low: float = 0.2
    high: float = 1.5
    width: float = 0.05

    def encode(self, text: Column) -> Column:
        return F.concat(token(self.name, bucket(F.lit(self.target), self.width)), F.lit(" "), text)

    def encode_pair(self, text: Column, complex_: Column, simple: Column) -> Column:
        return F.concat(token(self.name, bucket(self.value(complex_, simple), self.width)), F.lit(" "), text)


def ratio_of(columns: tuple[str, str]) -> Callable[[Column, Column], Column]:
    """A ratio of two measures that are columns already, such as word ranks or parse depths."""
    return lambda _complex, _simple: ratio(F.col(columns[1]), F.col(columns[0]))


PREPROCESSORS: dict[str, Callable[..., Preprocessor]] = {
    "LengthRatio": lambda **k: Preprocessor("LENGTHRATIO", length_ratio, **k),
    "Levenshtein": lambda **k: Preprocessor("LEVENSHTEIN", edit.indel_similarity, **{"high": 1.0} | k),
    "ReplaceOnlyLevenshtein": lambda **k: Preprocessor("REPLACEONLYLEVENSHTEIN", edit.replace_only_similarity, **{"high": 1.0} | k),
    "WordRankRatio": lambda **k: Preprocessor("WORDRANKRATIO", ratio_of(("complex_rank", "simple_rank")), **k),
    "DependencyTreeDepthRatio": lambda **k: Preprocessor("DEPENDENCYTREEDEPTHRATIO", ratio_of(("complex_depth", "simple_depth")), **k),
}
#: Ratios that are asked for at inference.
DEFAULTS = {"LengthRatio": 0.9, "Levenshtein": 0.8, "WordRankRatio": 0.8, "DependencyTreeDepthRatio": 0.4}


def encode(text: Column, steps: Sequence[Preprocessor]) -> Column:
    """Each step puts its token before the text, so the last one stands first."""
    return reduce(lambda t, p: p.encode(t), steps, text)


def encode_pair(complex_: Column, simple: Column, steps: Sequence[Preprocessor]) -> Column:
    return reduce(lambda t, p: p.encode_pair(t, complex_, simple), steps, complex_)


def decode(text: Column) -> Column:
    return without_control_tokens(text)
