"""Jump consistent hashing of rows to shards (Lamping and Veach, 2014), as DataFrame expressions.

A row's key decides its shard together with the number of shards alone; there is no ring table. With one more shard,
the rows that move all move into it, about one in n + 1. Slots are gapless within a shard: counts of (shard, sub-range
of the key's hash) give offsets, and rows are numbered within a sub-range, so that no task holds a whole shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm._common import materialise, table

_MULTIPLIER = "2862933555777941757"
_TWO_64 = "18446744073709551616"


def key_hash(key: Column) -> Column:
    """An unsigned 64-bit key as decimal(20,0): the first half of the md5 of the key as text; null as empty."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def jumps(key: Column, upto: int) -> Column:
    """The shard numbers below upto that the key jumps to, in order; the last below n is its shard among n.

    A key jumps about ln(upto) times. So many steps and some more are made for all keys; a key that isn't at the end
    then, which hardly ever happens, makes upto steps, which are enough as each is at least one shard further. Steps
    past the end change nothing.
    """

    def step(s: Column, _i: Column) -> Column:
        nxt = ((s["k"] * F.lit(_MULTIPLIER).cast("decimal(19,0)") + F.lit(1)) % F.lit(_TWO_64).cast("decimal(20,0)"))
        nxt = nxt.cast("decimal(20,0)")
        high = F.floor(nxt / F.lit(2**33).cast("decimal(10,0)")).cast("double")
        to = F.floor((s["j"] + 1).cast("double") * (F.lit(float(2**31)) / (high + 1.0)))
        moved = F.struct(nxt.alias("k"), to.cast("long").alias("j"), F.array_append(s["at"], s["j"]).alias("at"))
        return F.when(s["j"] < upto, moved).otherwise(s)

    start = F.struct(
        key.alias("k"), F.lit(0).cast("long").alias("j"), F.array().cast("array<bigint>").alias("at")
    )
    few = min(upto, int(3 * math.log(upto)) + 12)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(few)), start, step)
    if few == upto:
        return walked["at"]

    def finish(s: Column) -> Column:
        rest = F.aggregate(F.sequence(F.lit(1), F.lit(upto)), s, step)
        return F.when(s["j"] < upto, rest["at"]).otherwise(s["at"])

    # the lambda's argument is computed once
    return F.transform(F.array(walked), finish)[0]


def assign_shards(
    docs: DataFrame,
    n_shards: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    sub_ranges: int = 256,
) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 length of the text plus 16 (a null text: 16, checksum 0). A null id has the key of the empty
    text, so its rows share a shard. Rows with one id get one shard and different slots; their order among themselves
    follows sub-range, size and checksum. Other columns are ignored. sub_ranges bounds the rows that one task numbers: a shard is
    cut into so many hash ranges.
    """
    if n_shards < 1 or sub_ranges < 1:
        raise ValueError("n_shards and sub_ranges must be at least 1")
    text = F.col(f"`{text_col}`")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("__id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(16)).cast("long").alias("__size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("__crc"),
    )
    rows = rows.withColumn("__at", jumps(key_hash(F.col("__id")), n_shards + 1))
    # texts are read once; what is written is a few numbers a row
    rows = materialise(
        rows.select(
            "__id",
            "__size",
            "__crc",
            F.element_at(F.filter("__at", lambda j: j < n_shards), -1).cast("int").alias("__shard"),
            F.element_at("__at", -1).cast("int").alias("__grown"),
            # by size and checksum too, so that many rows with one id don't meet in one range
            F.pmod(F.xxhash64("__id", "__size", "__crc"), F.lit(sub_ranges)).cast("int").alias("__sub"),
        )
    )
    counts = rows.groupBy("__shard", "__sub").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__shard").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "__shard", "__sub", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    )
    within = Window.partitionBy("__shard", "__sub").orderBy(F.col("__id"), "__size", "__crc")
    numbered = rows.withColumn("__rank", F.row_number().over(within))
    # n_shards * sub_ranges rows at most, whatever the input: small enough to send to every executor
    small = F.broadcast(offsets) if n_shards * sub_ranges <= 1_000_000 else offsets
    return numbered.join(small, ["__shard", "__sub"]).select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("__shard").alias("shard"),
        (F.col("__offset") + F.col("__rank") - 1).cast("long").alias("slot"),
        F.col("__grown").alias("grown_shard"),
    )


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), 40)
