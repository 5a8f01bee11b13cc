"""The pipeline's toxicity stage on held-out labels of a larger table."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from pairloom.llm import _learn, toxicity

LARGER = "/root/testdata/sf0.1"


def shares(spark, d):
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, d).select("doc_id").withColumn("k", F.lit(1))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    r = labels.where(fold).join(kept, "doc_id", "left").groupBy("toxic").agg(F.avg(F.coalesce("k", F.lit(0))).alias("share")).collect()
    return {x.toxic: x.share for x in r}


def test_stage(spark):
    share = shares(spark, LARGER)
    assert share[0] >= 0.95 and share[1] <= 0.15


def test_threshold_in_the_gap():
    """Where the classes lie apart the threshold keeps away from both; else it is the lowest that keeps clean ones."""
    clean = np.linspace(0.001, 0.02, 1000)
    assert 0.02 < toxicity._between(clean, np.array([0.45, 0.9, 0.99]), 0.99) < 0.45
    mixed = toxicity._between(clean, np.linspace(0.001, 0.9, 5000), 0.99)
    for t in (mixed, toxicity._between(clean, np.zeros(0), 0.99)):
        assert (clean < t).mean() >= 0.99 and t <= 0.021
    assert toxicity._between(np.zeros(0), clean, 0.99) == 0.5 == toxicity._between(np.full(9, 0.8), clean, 0.99)


def test_sparse_is_the_dense_product():
    rng = np.random.default_rng(0)
    x = (rng.random((300, 40)) < 0.2) * 1.0
    x[17] = x[0] = x[299] = 0
    scale = rng.normal(size=40)
    row, col = np.nonzero(x)
    edges = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=300))])
    old, _learn.AT_ONCE = _learn.AT_ONCE, 64
    try:
        sparse = _learn.Sparse(col.astype(np.int32), edges, 40, scale)
    finally:
        _learn.AT_ONCE = old
    w, g = rng.normal(size=40), rng.normal(size=300)
    assert np.allclose(sparse.dot(w), (x * scale) @ w) and np.allclose(sparse.back(g), (x * scale).T @ g)
