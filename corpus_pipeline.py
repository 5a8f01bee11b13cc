"""From raw documents to token ids: each stage takes what the one before kept.

toxicity       drops documents that the classifier, trained on the labels, calls toxic
exact_dedup    keeps one of equal texts, the one with the largest id
near_dedup     keeps one of each group of near duplicates (five words, similarity 0.8), the one with the smallest id
mixing         flattens the shares of the sources until one is read MAX_REPEATS times; reads every document at least once
sentencepiece  encodes each document that is read, once for each time
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import exact_dedup, mixing, near_dedup, pieces, toxicity
from pairloom.llm._common import materialise, table

#: How often the rarest source may be read for each time that the largest is.
MAX_REPEATS = 1.5

#: No SQL can express the trained classifier or the tokenizer.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return toxicity.drop_toxic(docs, *toxicity.train_stage(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, max_repeats=MAX_REPEATS).select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = pieces.encode(docs, pieces.read_model(pieces.tokenizer_path()))
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
