"""Temperature mixing of sources.

A source with token share p gets the weight p^a / sum(p^a). The exponent a is bisected: to the largest entropy target
that still holds, or to the largest repetition that is allowed. The weights are realised against a budget of tokens:
a source whose quota is q times its own tokens is read floor(q) times in full, and once more in part. Each reading
(epoch) visits the source in its own pseudo-random order of blocks and of rows within a block; the partial one takes
whole blocks up to the quota, and of the block that crosses it the first rows.

All steps are DataFrame expressions. One row per source is gathered into a single row for the bisection; its number
of sources is checked. No task reads a whole source: rows are ordered only within one block of one source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm._common import WORD, materialise, table

STEPS = 60
#: Sources whose totals may be gathered into one row; more are an error.
MAX_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def weights(
    totals: DataFrame,
    target_entropy: float | None = None,
    max_repeats: float | None = None,
    budget: float | None = None,
) -> DataFrame:
    """totals(source, tokens) to (source, tokens, exponent, weight, quota).

    target_entropy: a share of the largest possible entropy, ln(number of sources); the exponent in 0..1 is the largest
    whose weights reach it. max_repeats: the smallest exponent in 0..1 at which no source is repeated more often, where
    the source that is repeated least is read once in full. Exactly one of the two is given. budget: tokens to hand
    out; by default the tokens there are, and with max_repeats as many as read every source once at least. Sources
    without tokens get the weight 0.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give target_entropy or max_repeats")
    if totals.limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: their totals don't fit in one row")
    total = F.aggregate("ts", F.lit(0.0), lambda a, t: a + t)
    row = totals.where("tokens > 0").agg(F.collect_list(F.col("tokens").cast("double")).alias("ts"))
    row = row.withColumn("ts", F.array_sort("ts")).withColumn("total", total)
    row = row.withColumns(
        {
            "ps": F.transform("ts", lambda t: t / F.col("total")),
            "n": F.size("ts"),
            "rare": F.array_min("ts") / F.col("total"),
            "most": F.array_max("ts") / F.col("total"),
        }
    )

    def holds(a: Column) -> Column:
        """True where the exponent has to fall (entropy) or may fall (repeats) no further."""
        if target_entropy is not None:
            z = F.aggregate("ps", F.lit(0.0), lambda s, p: s + F.pow(p, a))
            plogp = F.aggregate("ps", F.lit(0.0), lambda s, p: s + F.pow(p, a) * a * F.ln(p))
            return F.ln(z) - plogp / z >= F.lit(target_entropy) * F.ln(F.col("n"))
        return F.pow(F.col("most") / F.col("rare"), F.lit(1.0) - a) > F.lit(float(max_repeats))

    def halve(s: Column, _i: Column) -> Column:
        mid = (s["lo"] + s["hi"]) / 2
        up = holds(mid)
        return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    bisected = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve)
    # lo keeps the entropy, hi keeps the repeats; at 1 the natural shares already do
    if target_entropy is not None:
        exponent = F.when(holds(F.lit(1.0)), F.lit(1.0)).otherwise(bisected["lo"])
    else:
        exponent = F.when(~holds(F.lit(0.0)), F.lit(0.0)).otherwise(bisected["hi"])
    row = row.select(exponent.alias("exponent"), "ps", "total", "most")
    row = row.withColumn(
        "z", F.aggregate("ps", F.lit(0.0), lambda s, p: s + F.pow(p, F.col("exponent")))
    ).drop("ps")
    # one row on the right
    out = totals.join(F.broadcast(row), F.lit(True), "left")
    share = F.col("tokens") / F.col("total")
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.col("exponent")) / F.col("z")).otherwise(F.lit(0.0))
    if budget is not None:
        tokens = F.lit(float(budget))
    elif max_repeats is not None:
        tokens = F.pow(F.col("most"), F.lit(1.0) - F.col("exponent")) * F.col("z") * F.col("total")
    else:
        tokens = F.col("total")
    out = out.withColumn("weight", weight).withColumn("quota", F.col("weight") * tokens)
    return out.select("source", "tokens", "exponent", "weight", "quota")


def mix(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_repeats: float | None = None,
    budget: float | None = None,
    seed: int = 0,
    blocks: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The input rows once per epoch that takes them, with all their columns, and mix_tokens, mix_epoch, mix_block,
    mix_order, mix_weight, mix_quota after them.

    Tokens are words; a null text has none. A null source is a source of its own. A row without tokens costs nothing
    and goes with its block; a source without any tokens is read once, as there is nothing to weigh. The order by
    (mix_epoch, mix_block, mix_order) is the order to read in; rows with one id and one text tie and stay together.
    A source's last, partial epoch stops before the row that would go past its quota, or before all rows that tie with
    it. More than MAX_SOURCES sources raise ValueError. Columns whose names clash with
    the added ones are replaced; an empty table gives an empty result.
    """
    added = ["mix_tokens", "mix_epoch", "mix_block", "mix_order", "mix_weight", "mix_quota"]
    held = [c for c in docs.columns if c not in added]
    row = F.struct(*[F.col(f"`{c}`") for c in held]).alias("__row")
    base = docs.select(
        row,
        F.col(f"`{source_col}`").cast("string").alias("__src"),
        F.col(f"`{id_col}`").alias("__id"),
        word_count(F.col(f"`{text_col}`")).alias("__n"),
    )

    def spot(epoch: Column) -> Column:
        return F.xxhash64(F.lit(seed), epoch, F.col("__src"), F.col("__id"))

    # texts are read twice: for this, and for the rows that come out
    light = materialise(base.select("__src", "__id", "__n"))
    totals = materialise(light.groupBy("__src").agg(F.sum("__n").alias("tokens")).withColumnRenamed("__src", "source"))
    plan = weights(totals, target_entropy, max_repeats, budget).withColumns(
        {
            # a quota that is a whole number of readings up to rounding is that number
            "__epochs": F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens") + F.lit(1e-9))).otherwise(1),
        }
    )
    plan = materialise(
        plan.withColumn(
            "__left", F.greatest(F.lit(0.0), F.col("quota") - F.col("__epochs") * F.col("tokens"))
        ).withColumnRenamed("source", "__src")
    )
    # MAX_SOURCES rows at most
    sent = F.broadcast

    def block(epoch: Column) -> Column:
        return F.pmod(F.shiftright(spot(epoch), 40), F.lit(blocks)).cast("int")

    # The partial epoch of each source: which block crosses its quota, and what that block may still take.
    keyed = plan.select(F.col("__src").alias("__key"), "__epochs", "__left", "weight", "quota")

    def with_plan(df: DataFrame) -> DataFrame:
        return df.join(sent(keyed), F.col("__src").eqNullSafe(F.col("__key")), "inner").drop("__key")

    sums = (
        with_plan(light)
        .groupBy("__src", block(F.col("__epochs")).alias("__b"), "__left")
        .agg(F.sum("__n").alias("__bn"))
    )
    upto = Window.partitionBy("__src").orderBy("__b")
    sums = sums.withColumn("__end", F.sum("__bn").over(upto))
    cuts = sums.where(F.col("__end") > F.col("__left")).groupBy("__src").agg(
        F.min_by(F.struct("__b", (F.col("__left") - (F.col("__end") - F.col("__bn"))).alias("__room")), "__b").alias("__cut")
    )
    cuts = materialise(cuts.select(F.col("__src").alias("__ckey"), "__cut"))

    placed = with_plan(base).join(sent(cuts), F.col("__src").eqNullSafe(F.col("__ckey")), "left").drop("__ckey")
    last = F.col("__epochs")
    placed = placed.withColumns({"__b": block(last), "__o": spot(last)})
    # Only rows of a crossing block are summed up in order; a block holds one part in `blocks` of its source.
    crossing = F.coalesce(F.col("__b") == F.col("__cut.__b"), F.lit(False))
    in_order = (
        Window.partitionBy("__src", "__b").orderBy("__o", "__id").rangeBetween(Window.unboundedPreceding, 0)
    )
    edge = (
        with_plan(light)
        .join(sent(cuts), F.col("__src").eqNullSafe(F.col("__ckey")), "inner")
        .withColumns({"__b": block(last), "__o": spot(last)})
        .where(F.col("__b") == F.col("__cut.__b"))
        .withColumn("__run", F.sum("__n").over(in_order))
        .where(F.col("__run") <= F.col("__cut.__room"))
        .groupBy("__src")
        .agg(F.max(F.struct("__o", "__id")).alias("__upto"))
    )
    edge = materialise(edge.select(F.col("__src").alias("__ekey"), "__upto"))
    placed = placed.join(sent(edge), F.col("__src").eqNullSafe(F.col("__ekey")), "left").drop("__ekey")
    taken = (
        F.when(F.col("__left") <= 0, False)
        .when(F.col("__cut").isNull(), True)
        .when(F.col("__b") < F.col("__cut.__b"), True)
        .when(crossing, F.coalesce(F.struct("__o", "__id") <= F.col("__upto"), F.lit(False)))
        .otherwise(False)
    )
    copies = F.col("__epochs").cast("int") + F.when(taken, 1).otherwise(0)
    out = placed.withColumn("__copies", copies).where("__copies > 0")
    out = out.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    epoch = F.col("mix_epoch").cast("bigint")
    return out.select(
        *[F.col("__row").getField(c).alias(c) for c in held],
        F.col("__n").alias("mix_tokens"),
        "mix_epoch",
        block(epoch).alias("mix_block"),
        spot(epoch).alias("mix_order"),
        F.col("weight").alias("mix_weight"),
        F.col("quota").alias("mix_quota"),
    )


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """Weights whose entropy is at least 95 % of the largest, under a budget of all tokens there are."""
    docs = table(spark, sf_dir, "documents")
    out = mix(docs, target_entropy=0.95)
    return out.select(
        "doc_id",
        "source",
        F.col("mix_tokens").alias("n_tokens"),
        F.col("mix_epoch").alias("epoch"),
        F.col("mix_block").alias("block"),
        F.col("mix_order").alias("position_key"),
        F.round("mix_weight", 9).alias("weight"),
        F.round("mix_quota", 3).alias("quota"),
    )
