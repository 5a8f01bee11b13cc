"""Words of whole columns, and what is counted from them, against one row at a time."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.operators import lm, words

TEXTS = ["a b  a", None, "", "   ", "É\tö\x00É\r\nb ", "b\x0bc\x0c", "\x85x y\xa0z", "a b a b a b c", "\U0001f600 a"]


def table(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def split(spark):
    return {r.doc_id: r.w for r in table(spark).select("doc_id", text.word_array(F.lower("text")).alias("w")).collect()}


def test_split(spark):
    want = [r.w or [] for r in table(spark).select("doc_id", text.word_array("text").alias("w")).orderBy("doc_id").collect()]
    x = pa.array(TEXTS, pa.string())
    assert words.split_words(x).to_pylist() == want
    assert words.split_words(x[3:7]).to_pylist() == want[3:7]
    assert words.split_words(x[:0]).to_pylist() == []


def test_counts_and_quantiles(spark, monkeypatch):
    docs, by = table(spark), split(spark)
    for at_once in (1 << 20, 2):
        monkeypatch.setattr(lm, "_WORDS_AT_ONCE", at_once)
        for order in (1, 2, 3, 5):
            want = Counter()
            for w in by.values():
                if w is not None:
                    m = ["<s>", *w, "</s>"]
                    want.update(" ".join(m[i : i + order]) for i in range(len(m) - order + 1))
            assert {r.gram: r.n for r in lm.ngram_counts(docs, "text", order).collect()} == want
    want = Counter((i, x) for i, w in by.items() for x in w or [])
    assert {(r.doc_id, r.word): r.k for r in lm._row_counts(docs, ["doc_id"], "text").collect()} == want
    ranks = {r.word: r["rank"] for r in lm.word_ranks(docs, vocabulary=4).collect()}
    got = {r.doc_id: r.q for r in lm.rank_quantile(docs, ["doc_id"], "text", lm.word_ranks(docs, vocabulary=4), 0.75, "q").collect()}
    for i, w in by.items():
        known = [np.log1p(ranks[x]) for x in w or [] if x in ranks]
        assert got[i] is None if not known else abs(got[i] - np.quantile(known, 0.75)) < 1e-12


def test_noise_by_digits(spark):
    df = spark.range(2000)
    for share in (0.0, 0.1, 0.5, 1.0):
        assert df.where(text.below(share, 1, "id") != (text.unit(1, "id") < share)).count() == 0


def test_no_shuffle_of_words(spark):
    pairs = table(spark).selectExpr("doc_id", "text as complex", "text as simple")
    plan = lm.rank_quantile_ratio(pairs, ["doc_id"], lm.word_ranks(table(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
