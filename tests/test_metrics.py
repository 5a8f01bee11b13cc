"""N-gram metrics within a row against counts in plain Python."""

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from pairloom.operators import metrics

ROWS = [
    ("About 95 species are currently accepted .", "about 95 you now get in .", "About 95 species are currently known ."),
    ("a a a b", "a a b b b c", "a b a c a b"),
    ("a b c d e", "a b c d e", "a b c d e"),
    ("a b c d e", "a b c d e", "a b c d e"),
    ("", "x", "y z"),
    ("   ", "", ""),
    (None, "a b", None),
    (None, None, None),
    ("É ö É", "é Ö", "é"),
    ("w " * 5000 + "x y z", "x y z " * 3000, "y z " * 4000 + "w"),
]


def counts(text, n):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def parts(a, b, c):
    share = lambda x, y: x / y if y else 0.0
    f1 = lambda p, q: 2 * p * q / (p + q) if p + q else 0.0
    add = keep = drop = 0.0
    for n in range(1, 5):
        s, y, r = counts(a, n), counts(b, n), counts(c, n)
        new, wanted = y.keys() - s.keys(), r.keys() - s.keys()
        add += f1(share(len(new & wanted), len(new)), share(len(new & wanted), len(wanted)))
        kept = s & y
        keep += f1(share((kept & r).total(), kept.total()), share((kept & r).total(), (s & r).total()))
        gone = s - y
        drop += share((gone & (s - r)).total(), gone.total())
    return add * 25, keep * 25, drop * 25


def table(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "i int, source string, system string, reference string")


def test_sari(spark):
    got = metrics.with_sari_parts(metrics.sari(table(spark), "source", "system", "reference"), "source", "system", "reference", "p").collect()
    assert len(got) == len(ROWS)
    for r in got:
        want = parts(*ROWS[r.i])
        assert all(abs(x - y) < 1e-9 for x, y in zip(r.p, want, strict=True)), (r.i, r.p, want)
        assert abs(r.sari - sum(want) / 3) < 1e-9


def test_rows_counted_a_few_at_a_time(monkeypatch):
    words = [pa.array([(x[k] or "").lower().split() for x in ROWS[1:9]], pa.list_(pa.string())) for k in range(3)]
    rows = pa.StructArray.from_arrays(words, names=["a", "b", "c"])
    whole = metrics._by_row(rows, metrics._sari_stats, 4).to_pylist()
    assert len(whole) == 8 and all(len(x) == 32 for x in whole)
    monkeypatch.setattr(metrics, "_WORDS_AT_ONCE", 3)
    assert metrics._by_row(rows, metrics._sari_stats, 4).to_pylist() == whole
    assert metrics._by_row(rows[2:5], metrics._sari_stats, 4).to_pylist() == whole[2:5]


def test_bleu_counts(spark):
    want = {}
    for n in range(1, 5):
        h, r = ([counts(x[k], n) for x in ROWS] for k in (1, 2))
        want[n] = (sum((x & y).total() for x, y in zip(h, r, strict=True)), sum(x.total() for x in h))
    assert {x.n: (x.matches, x.total) for x in metrics.bleu_counts(table(spark), "system", "reference").collect()} == want
    empty = table(spark).where(F.lit(False))
    assert metrics.bleu_counts(empty, "system", "reference").count() == 0
    assert metrics.bleu(empty, "system", "reference").first().bleu == 0.0
    assert metrics.sari(empty, "source", "system", "reference").count() == 0
