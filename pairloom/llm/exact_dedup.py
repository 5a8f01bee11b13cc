"""Exact duplicates by a distributed content sort.

Sampled splitters range-partition the normalised text: Spark samples a bounded splitter key (the first bytes of the
text, a 64-bit hash that tells long common prefixes apart, and a piece number), never whole texts. Within a range the
external sort places equal texts side by side, and the window's group boundary is a comparison of the full text with
its neighbour: of a text with up to HOT_ROWS rows all meet there, and nothing else decides.

A text that more rows may share, by a count of its hash, is dealt to pieces of about HOT_ROWS rows, which may lie in
several ranges. Of these texts, and of these alone, the first row of each piece meets those of the others, again by a
comparison of the full text.

Everything is a DataFrame operation. The text crosses the network once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm._common import materialise, table

#: Characters of the text in the splitter key.
SPLITTER_CHARS = 32
#: Rows of one text that are sorted as one piece.
HOT_ROWS = 256
#: Hashes of hot texts that are sent to every executor (12 bytes each); beyond, rows meet them by a shuffle.
SENT_HASHES = 4_000_000


def _runs(docs: DataFrame, id_col: str, text: Column, keep: str, carry: list[Column]) -> DataFrame:
    """carry columns, __id, __t, __x (hash), __hot, and of each run of equal texts: __rn, __top (id), __n."""
    base = docs.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(text, F.lit("")).alias("__t"), *carry)
    base = base.withColumn("__x", F.xxhash64("__t"))
    counts = base.groupBy("__x").agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") > HOT_ROWS)
    hot = materialise(counts.select(F.col("__x").alias("__hx"), F.ceil(F.col("__c") / HOT_ROWS).cast("int").alias("__pieces")))
    few = hot.limit(SENT_HASHES + 1).count() <= SENT_HASHES
    base = base.join(F.broadcast(hot) if few else hot, F.col("__x") == F.col("__hx"), "left")
    base = base.withColumns(
        {
            "__hot": F.col("__pieces").isNotNull(),
            "__p": F.substring("__t", 1, SPLITTER_CHARS),
            "__s": F.coalesce(F.pmod(F.xxhash64(F.lit("piece"), "__id"), F.col("__pieces")), F.lit(0)).cast("int"),
        }
    ).drop("__hx", "__pieces")
    key = ["__p", "__x", "__s"]
    best = F.col("__id").desc_nulls_last() if keep == "largest" else F.col("__id").asc_nulls_last()
    piece = Window.partitionBy(*key, "__t")
    top = F.max if keep == "largest" else F.min
    return base.repartitionByRange(*key).withColumns(
        {
            "__rn": F.row_number().over(piece.orderBy(best)),
            "__top": top("__id").over(piece),
            "__n": F.count(F.lit(1)).over(piece),
        }
    ).drop("__p")


def _groups(hot: DataFrame, keep: str) -> DataFrame:
    """Of the first rows of the pieces of hot texts: (__t, __keep, __size)."""
    top = F.max if keep == "largest" else F.min
    return hot.groupBy("__t").agg(top("__top").alias("__keep"), F.sum("__n").alias("__size"))


def mark_exact(
    docs: DataFrame, id_col: str = "doc_id", text: Column | None = None, keep: str = "smallest"
) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    text: the normalised text to compare; by default the column text, unchanged. Null counts as empty. keep: the row
    with the smallest or the largest id stays; a null id loses against any other. Of repeated rows with one id, one
    is kept. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    text = F.col("text") if text is None else text
    runs = _runs(docs, id_col, text, keep, [])
    # the digest is what is returned; the texts of hot pieces' first rows are kept for the comparison
    runs = runs.withColumns(
        {
            "__h": F.sha2(F.col("__t").cast("binary"), 256),
            "__first": F.when(F.col("__hot") & (F.col("__rn") == 1), F.col("__t")),
        }
    )
    runs = materialise(runs.drop("__t"))
    firsts = runs.where("__first is not null").select("__x", "__s", F.col("__first").alias("__t"), "__h", "__top", "__n")
    pieces = firsts.join(_groups(firsts, keep), "__t").select("__x", "__s", "__h", "__keep", "__size")
    hot = runs.where("__hot").join(materialise(pieces), ["__x", "__s", "__h"])
    held = ["__id", "__keep", "__size", "__rn", "__h"]
    rest = runs.where("not __hot").select("__id", F.col("__top").alias("__keep"), F.col("__n").alias("__size"), "__rn", "__h")
    return rest.unionByName(hot.select(*held)).select(
        F.col("__id").alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.col("__size").cast("long").alias("group_size"),
        ((F.col("__rn") == 1) & F.col("__id").eqNullSafe(F.col("__keep"))).alias("kept"),
        F.col("__h").alias("text_sha256"),
    )


def drop_exact(
    docs: DataFrame, id_col: str = "doc_id", text: Column | None = None, keep: str = "smallest"
) -> DataFrame:
    """The rows that stay, with all their columns; equal texts and ties as in mark_exact."""
    # a text that is compared as it is isn't carried a second time
    plain = text is None
    text = F.col("text") if plain else text
    held = [c for c in docs.columns if not (plain and c == "text")]
    row = F.struct(F.col("text").isNull().alias("__null") if plain else F.lit(False).alias("__null"), *[F.col(f"`{c}`") for c in held])
    runs = materialise(_runs(docs, id_col, text, keep, [row.alias("__row")]).where("__rn = 1").drop("__x"))
    hot = runs.where("__hot")
    groups = _groups(hot, keep).select("__t", "__keep")
    # of pieces whose best rows have one id, as repeated rows have, the first stays
    again = F.row_number().over(Window.partitionBy("__t").orderBy("__s"))
    stay = hot.join(groups, "__t").where(F.col("__id").eqNullSafe(F.col("__keep"))).withColumn("__again", again).where("__again = 1")
    whole = F.when(~F.col("__row.__null"), F.col("__t"))
    out = [whole.alias("text") if plain and c == "text" else F.col("__row").getField(c).alias(c) for c in docs.columns]
    return runs.where("not __hot").select(*out).unionByName(stay.select(*out))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return mark_exact(table(spark, sf_dir, "documents"), keep="largest")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
