"""Datasets as tables: ids, splits, mixes, leak checks, lineage, line scans."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.text import unit


def id_offsets(df: DataFrame, part_col: str) -> DataFrame:
    """(part, n, offset): rows of each part, and of all parts before it."""
    before = Window.orderBy(part_col).rowsBetween(Window.unboundedPreceding, -1)
    n = df.groupBy(part_col).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))


def number_rows(df: DataFrame, order: Sequence[str], name: str = "row_id", parts: int = 256) -> DataFrame:
    """Gapless ids from 0 in the given order: a range shuffle, counts of its ranges and numbers within each, so no task
    holds all rows. Rows that tie in the order get ids in any order among themselves."""
    ranged = df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    ranged = ranged.sortWithinPartitions(*order).withColumn("__in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    ranged = ranged.persist()
    offsets = id_offsets(ranged, "__part").select("__part", "offset")
    return ranged.join(F.broadcast(offsets), "__part").withColumn(name, F.col("offset") + F.col("__in")).drop("__part", "__in", "offset")


def positional_join(left: DataFrame, right: DataFrame, on: str = "row_id", strict: bool = False) -> DataFrame:
    """Rows of two tables with one id; without strict a missing side is null, with it a row of one side alone fails."""
    joined = left.withColumn("__l", F.lit(True)).join(right.withColumn("__r", F.lit(True)), on, "full_outer")
    if strict:
        fine = F.col("__l").isNotNull() & F.col("__r").isNotNull()
        joined = joined.where(F.when(fine, True).otherwise(F.raise_error(F.lit("the tables differ in length")).cast("boolean")))
    return joined.drop("__l", "__r")


def hash_order(*key: str, seed: int = 0) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]).cast("binary"))


def split_dataset(df: DataFrame, key: str, test: int = 10_000, valid: int = 10_000, seed: int = 0) -> DataFrame:
    """phase by the order of a hash of the key: the first rows are test, the next valid, the rest train.

    The limits are found by a top-k sort of keys, and each row is then compared with them: no task sorts all rows.
    """
    keyed = df.withColumn("__h", hash_order(key, seed=seed))
    at = keyed.select("__h").orderBy("__h").limit(test + valid)
    rank = at.select("__h", F.row_number().over(Window.orderBy("__h")).alias("r"))
    cuts = rank.agg(F.max(F.when(F.col("r") <= test, F.col("__h"))).alias("t"), F.max("__h").alias("v"))
    phase = F.when(F.col("__h") <= F.col("t"), "test").when(F.col("__h") <= F.col("v"), "valid").otherwise("train")
    return keyed.crossJoin(F.broadcast(cuts)).withColumn("phase", phase).drop("__h", "t", "v")


def smaller_dataset(df: DataFrame, n_lines: int, row_col: str = "row_id", phase_col: str = "phase") -> DataFrame:
    """The first n_lines rows of the training phase, and all of the others."""
    return df.where((F.col(phase_col) != "train") | (F.col(row_col) < n_lines))


def round_robin(df: DataFrame, n: int, row_col: str) -> DataFrame:
    return df.withColumn("part", F.pmod(F.col(row_col), F.lit(n)).cast("int"))


def merge_round_robin(frames: Sequence[DataFrame], row_col: str = "row_id") -> DataFrame:
    """Rows of several tables with their order in a round-robin merge as (row, part); no row is lost."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("part", F.lit(i))
        out = f if out is None else out.unionByName(f)
    return out.orderBy(row_col, "part")


def mix_datasets(df: DataFrame, dataset_col: str, row_col: str, weights: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """A weighted interleave of datasets: order grows by 1 / weight for each row of a dataset in the order of a hash, so
    a prefix holds the datasets in the proportion of their weights. Datasets without a weight are left out; the weights
    are normalised; by default they are equal."""
    shuffled = df.withColumn("__h", hash_order(dataset_col, row_col, seed=seed))
    if weights is None:
        weight = F.lit(1.0)
    else:
        total = sum(weights.values())
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(v / total))]
        weight = F.create_map(*pairs)[F.col(dataset_col)]
        shuffled = shuffled.where(F.col(dataset_col).isin(*weights))
    rank = F.row_number().over(Window.partitionBy(dataset_col).orderBy("__h", row_col))
    return shuffled.withColumn("mix_order", F.round((rank - unit(seed, dataset_col)) / weight, 6)).drop("__h")


def lines_in(df: DataFrame, lines: DataFrame, on: str) -> DataFrame:
    """Rows of df whose line is among lines."""
    return df.join(lines.select(on).distinct(), on, "left_semi")


def lines_not_in(df: DataFrame, lines: DataFrame, on: str) -> DataFrame:
    return df.join(lines.select(on).distinct(), on, "left_anti")


def has_lines_in_common(a: DataFrame, b: DataFrame, on: str) -> bool:
    return not lines_in(a, b, on).limit(1).isEmpty()


def check_leaks(dataset: DataFrame, line: str = "complex") -> DataFrame:
    """(phase, n_leaked): rows of the valid and test phases whose line is in the training phase."""
    train = dataset.where("phase = 'train'").select(line)
    held = dataset.where("phase <> 'train'")
    leaked = lines_in(held, train, line).groupBy("phase").agg(F.count(F.lit(1)).alias("n_leaked"))
    return held.select("phase").distinct().join(leaked, "phase", "left").na.fill(0, ["n_leaked"])


def containing(docs: DataFrame, needles: DataFrame, text_col: str, needle_col: str, words: int = 5) -> DataFrame:
    """Rows of docs that hold a needle whole, with the needle. A run of `words` words of the needle's is looked for
    first, by an equi-join on its hash; needles with fewer words are compared with every text."""
    split = lambda c: F.filter(F.split(F.translate(c, "\n\t\r", "   "), " "), lambda w: w != "")
    gram = lambda ws, i: F.xxhash64(F.array_join(F.slice(ws, i, words), " "))
    grams = lambda ws: F.when(F.size(ws) >= words, F.transform(F.sequence(F.lit(1), F.size(ws) - (words - 1)), lambda i: gram(ws, i)))
    docs = docs.withColumn("__w", split(F.col(text_col)))
    # the first word of a needle may be the end of a word of the text, and its last the start of one
    inner = F.slice(split(F.col(needle_col)), 2, F.greatest(F.size(split(F.col(needle_col))) - 2, F.lit(0)))
    sought = needles.withColumn("__n", inner)
    sought = sought.withColumn("__key", F.when(F.size("__n") >= words, gram(F.col("__n"), F.lit(1))))
    long = docs.withColumn("__key", F.explode(F.array_distinct(grams(F.col("__w"))))).join(sought.where("__key is not null"), "__key")
    short = docs.withColumn("__key", F.lit(None).cast("long")).join(sought.where("__key is null").drop("__key"), F.contains(F.col(text_col), F.col(needle_col)))
    out = long.where(F.contains(F.col(text_col), F.col(needle_col))).unionByName(short, allowMissingColumns=True)
    return out.drop("__w", "__n", "__key")


def descendants(edges: DataFrame, root: str, limit: int = 100) -> DataFrame:
    """(dataset, depth) below root; edges(dataset, original). Ends when a level adds nothing, so cycles are harmless."""
    level = edges.where(F.col("original") == root).select("dataset").distinct().withColumn("depth", F.lit(1))
    out = level
    for depth in range(2, limit):
        nxt = edges.join(level.select(F.col("dataset").alias("original")), "original").select("dataset").distinct()
        nxt = nxt.join(out.select("dataset"), "dataset", "left_anti").withColumn("depth", F.lit(depth))
        if nxt.isEmpty():
            break
        out, level = out.unionByName(nxt), nxt
    return out


def ancestors(edges: DataFrame, name: str, limit: int = 100) -> DataFrame:
    turned = edges.select(F.col("original").alias("dataset"), F.col("dataset").alias("original"))
    return descendants(turned, name, limit)


def config_name(dataset: str, config: dict) -> str:
    """A derived dataset's name: an underscore and the md5 of its base and configuration."""
    return "_" + hashlib.md5((dataset + json.dumps(config, sort_keys=True)).encode()).hexdigest()


def parse_hypotheses(lines: DataFrame) -> DataFrame:
    """lines(line_no, value) of a generator's log to (sample_id, hypotheses), hypotheses in the order of the log."""
    pattern = r"^H-(\d+)\t(-?\d+\.\d+)\t(.*)$"
    hit = lines.where(F.col("value").rlike(pattern)).select(
        F.regexp_extract("value", pattern, 1).cast("int").alias("sample_id"),
        F.struct("line_no", F.regexp_extract("value", pattern, 2).cast("double").alias("score"), F.regexp_extract("value", pattern, 3).alias("hypothesis")).alias("h"),
    )
    return hit.groupBy("sample_id").agg(F.sort_array(F.collect_list("h")).alias("hypotheses"))


def files_hash(hashes: Column) -> Column:
    """Aggregate: the md5 of the sorted hashes joined."""
    return F.md5(F.array_join(F.sort_array(F.collect_list(hashes)), "").cast("binary"))
