"""Recall of the near-dedup trees at every depth that nodes may reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import near_dedup

from . import exact


@pytest.mark.parametrize("depth", [*range(1, 20), near_dedup.DEPTH])
def test_missed(depth):
    assert (1 - near_dedup.together(depth, 80)) ** near_dedup.trees_for(depth, 80) <= near_dedup.MISSED


def test_pairs_stay_together_at_depth(spark):
    """Pairs that agree in each minwise token with a probability of 0.8, sent down eight levels by the code itself."""
    rng, depth, n = np.random.default_rng(1), 8, 400
    one = rng.integers(-(2**31), 2**31, (n, near_dedup.T))
    two = np.where(rng.random(one.shape) < 0.8, one, rng.integers(-(2**31), 2**31, one.shape))
    rows = [(i, side, x[i].tolist()) for side, x in enumerate((one, two)) for i in range(n)]
    df = spark.createDataFrame(rows, "pair int, side int, mh array<int>")
    root = F.flatten(F.array(*[near_dedup._children(0, F.xxhash64(F.lit(-1 - t)), F.col("mh"), 80) for t in range(near_dedup.trees_for(depth, 80))]))
    now = df.select("pair", "side", "mh", F.explode(root).alias("key"))
    for level in range(1, depth):
        now = now.select("pair", "side", "mh", F.explode(near_dedup._children(level, F.col("key"), F.col("mh"), 80)).alias("key"))
    met = now.where("side = 0").select("pair", "key").join(now.where("side = 1").select("pair", "key"), ["pair", "key"])
    assert met.select("pair").distinct().count() >= 0.99 * n


def test_recall(spark):
    """No link of the exact join is lost on a larger table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, shingle=2).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    ids = [i for i, _ in rows]
    links = exact.links([t for _, t in rows], 2)
    assert len(links) > 50
    assert got == exact.components(ids, links)


def test_large_nodes_are_cut(spark, monkeypatch):
    """Blocks hold every pair of different labels that a node has, also if the node is cut into chunks."""
    rng = np.random.default_rng(5)
    label = [1 if i < 60 else 100 + i for i in range(90)]
    bits = [int(x) for x in rng.integers(-(2**62), 2**62, 4)]
    rows = [(7, 90, 1, 60, i, 10, *bits, label[i]) for i in range(90)]
    small = spark.createDataFrame(rows, "key long, m long, major long, mc long, id long, n long, b0 long, b1 long, b2 long, b3 long, label long")
    want = {(a, b) for a in range(90) for b in range(a + 1, 90) if label[a] != label[b]}
    for chunk in (4096, 8):
        monkeypatch.setattr(near_dedup, "CHUNK", chunk)
        blocks = near_dedup._blocks(small)
        assert blocks.groupBy("blk").count().agg(F.max("count")).first()[0] <= max(90 if chunk > 90 else 0, 6 * chunk)
        got = near_dedup._meetings(small, 80, False).collect()
        assert {(r.a, r.b) for r in got} == want


def test_low_bound_keeps_similar_sets():
    """Sets beyond the threshold pass the bound by their smallest hashes; unlike ones don't."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(-(2**31), 2**31, 2000))
    lists, n = [np.sort(base)[: near_dedup.LOWEST]], [len(base)]
    for share in (0.95, 0.9, 0.3, 0.0):
        kept = base[rng.random(len(base)) < share]
        got = np.unique(np.concatenate([kept, rng.integers(-(2**31), 2**31, len(base) - len(kept))]))
        lists.append(np.sort(got)[: near_dedup.LOWEST])
        n.append(len(got))
    ranks = near_dedup._ranks(pa.chunked_array([pa.array([x.tolist() for x in lists], pa.list_(pa.int32()))]))
    i, j = np.zeros(4, np.int64), np.arange(1, 5)
    assert near_dedup._low_similar(i, j, np.array(n), *ranks, 80).tolist() == [0, 1]
