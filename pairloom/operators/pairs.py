"""Predicates and filter chains over pairs of sentences (complex, simple)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions import edit
from pairloom.functions.text import entities, sentence_array


def sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, sentence), pos from 1."""
    s = F.posexplode(sentence_array(F.col(f"`{text_col}`"))).alias("pos", "sentence")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), s).select("doc_id", (F.col("pos") + 1).alias("pos"), "sentence")


def neighbor_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, complex, simple): each sentence with the next one of its document. Pairs without a model."""
    df = docs.select(F.col(f"`{id_col}`").alias("doc_id"), sentence_array(F.col(f"`{text_col}`")).alias("s"))
    two = F.transform(
        F.slice("s", 1, F.greatest(F.size("s") - 1, F.lit(0))),
        lambda x, i: F.struct((i + 1).alias("pos"), x.alias("complex"), F.get("s", i + 1).alias("simple")),
    )
    return df.select("doc_id", F.inline(two))


def contained(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def overlapping(a: Column, b: Column, share: float = 0.25) -> Column:
    """A suffix of one is a prefix of the other, with more than share of the shorter one's characters."""

    def one_way(x: Column, y: Column) -> Column:
        low = F.floor(F.least(F.length(x), F.length(y)) * F.lit(share)).cast("int") + 1
        top = F.least(F.length(x) - 1, F.length(y))
        some = F.exists(F.sequence(low, top), lambda k: F.right(x, k) == F.left(y, k))
        # the least overlap is in both, so that few pairs have their lengths tried
        return F.when(F.length(y) == 0, F.length(x) > 0).when((low > top) | ~F.contains(x, F.left(y, low)), F.lit(False)).otherwise(some)

    return one_way(a, b) | one_way(b, a)


def new_entities(a: Column, b: Column) -> Column:
    """b holds an entity more often than a does."""
    ea, eb = entities(a), entities(b)
    count = lambda xs, e: F.size(F.filter(xs, lambda x: x == e))
    return F.exists(F.array_distinct(eb), lambda e: count(eb, e) > count(ea, e))


#: Cheap tests first; the edit distance runs in Python and is last.
FILTERS: dict[str, object] = {
    "contained": lambda: ~contained(F.col("complex"), F.col("simple")),
    "overlapping": lambda: ~overlapping(F.col("complex"), F.col("simple")),
    "different_enough": lambda: edit.different_enough(F.col("complex"), F.col("simple")),
    "new_entities": lambda: ~new_entities(F.col("complex"), F.col("simple")),
}


def filter_pairs(pairs: DataFrame, names: Sequence[str] = ("duplicates", "contained", "overlapping", "different_enough")) -> DataFrame:
    for name in names:
        pairs = pairs.dropDuplicates(["complex", "simple"]) if name == "duplicates" else pairs.where(FILTERS[name]())
    return pairs


def filter_report(pairs: DataFrame, names: Sequence[str] = ("contained", "overlapping", "different_enough")) -> DataFrame:
    """(stage, name, n_in, n_out, ratio) of filters applied in order, in one pass over the pairs."""
    marks = pairs.select(*[FILTERS[n]().alias(f"f{i}") for i, n in enumerate(names)])
    passed = F.lit(True)
    sums = [F.count(F.lit(1)).alias("n0")]
    for i in range(len(names)):
        passed = passed & F.col(f"f{i}")
        sums.append(F.coalesce(F.sum(passed.cast("long")), F.lit(0)).alias(f"n{i + 1}"))
    rows = F.array(
        *[
            F.struct(F.lit(i + 1).alias("stage"), F.lit(n).alias("name"), F.col(f"n{i}").alias("n_in"), F.col(f"n{i + 1}").alias("n_out"))
            for i, n in enumerate(names)
        ]
    )
    out = marks.agg(*sums).select(F.inline(rows))
    return out.withColumn("ratio", F.coalesce(F.try_divide(F.col("n_out").cast("double"), F.col("n_in")), F.lit(0.0)))


def look_up(candidates: DataFrame, texts: DataFrame, id_col: str = "sent_id", text_col: str = "sentence") -> DataFrame:
    """candidates(query_id, neighbor_id, ...) with the sentences of both as complex and simple."""
    side = lambda key, name: texts.select(F.col(id_col).alias(key), F.col(text_col).alias(name))
    return candidates.join(side("query_id", "complex"), "query_id").join(side("neighbor_id", "simple"), "neighbor_id")
