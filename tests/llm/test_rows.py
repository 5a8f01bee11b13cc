"""Quality rules, exact dedup, sharding and mixing against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from pairloom.llm import exact_dedup, mixing, quality_rules, sharding
from pairloom.llm._common import materialise, release

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    ws, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    grams = defaultdict(list)
    for i in range(len(ws) - 2):
        grams[tuple(ws[i : i + 3])].append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    extra = [(100, "a b c a b c"), (101, "x x x x"), (102, "a\n\na\n \nb # $\na"), (103, "a b"), (104, "é é é é 😀 |")]
    rows = [(i if i is not None else -1, t) for i, t, *_ in cases.ODD] + extra
    want = dict(rows)
    for r in quality_rules.apply_rules(cases.texts(spark, rows)).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(want[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rules_keep_labelled_good_texts(spark, sf_dir):
    out = quality_rules.op3_quality_rules(spark, sf_dir)
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    r = out.join(good, "doc_id").where("not base_failed").agg(F.avg(F.col("kept").cast("int")).alias("k")).first()
    assert r.k >= 0.95


def test_odd_rows(spark):
    odd, none = cases.odd(spark), cases.none(spark)
    assert quality_rules.apply_rules(odd).count() == len(cases.ODD)
    assert sharding.assign_shards(odd, 7).count() == len(cases.ODD)
    for df in (quality_rules.apply_rules(none), exact_dedup.mark_exact(none), sharding.assign_shards(none, 7), mixing.mix(none, target_entropy=0.9, source_col="label")):
        assert df.collect() == []


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact(spark, keep):
    out = exact_dedup.mark_exact(cases.odd(spark), keep=keep).collect()
    groups = defaultdict(list)
    for i, t, *_ in cases.ODD:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    assert len(out) == len(cases.ODD)
    kept = Counter(r.text_sha256 for r in out if r.kept)
    assert kept == Counter(groups.keys())
    for r in out:
        ids = [i for i in groups[r.text_sha256] if i is not None]
        assert r.group_size == len(groups[r.text_sha256])
        assert r.keep_id == ((min if keep == "smallest" else max)(ids) if ids else None)
    left = exact_dedup.drop_exact(cases.odd(spark), keep=keep)
    assert left.columns == cases.odd(spark).columns and left.count() == len(groups)


def test_exact_hot_group(spark):
    """One text makes up most rows: its run is cut, and its pieces are joined again."""
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "same").otherwise(F.col("id").cast("string")).alias("text"))
    out = exact_dedup.mark_exact(df, keep="largest")
    assert out.where("kept").count() == 1501
    assert {(r.keep_id, r.group_size) for r in out.where("group_size > 1").select("keep_id", "group_size").distinct().collect()} == {(4996, 3500)}


def jump(key, n):
    """The published algorithm."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_sharding(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = sharding.op9_sharding(spark, sf_dir).collect()
    assert len(out) == len(docs)
    slots = defaultdict(list)
    for r in out:
        key = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:16], 16)
        raw = (docs[r.doc_id] or "").encode()
        assert (r.shard, r.grown_shard) == (jump(key, 40), jump(key, 41))
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def sourced(spark, sizes):
    rows = [(k * 100_000 + i, s, "w " * 10) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def entropy(ws):
    return -sum(w * math.log(w) for w in ws if w > 0)


def test_entropy_target(spark):
    docs = sourced(spark, {"a": 4000, "b": 300, "c": 60, None: 20})
    out = mixing.mix(docs, target_entropy=0.7, blocks=16)
    got = out.groupBy("source").agg(F.sum("mix_tokens").alias("n"), F.max("mix_weight").alias("w"), F.max("mix_quota").alias("q")).collect()
    assert abs(sum(r.w for r in got) - 1) < 1e-9
    assert entropy([r.w for r in got]) == pytest.approx(0.7 * math.log(4), abs=1e-6)
    total = sum(r.n for r in got)
    assert 0.999 * 43_800 - 40 <= total <= 43_800
    assert all(r.q - 10 <= r.n <= r.q + 1e-6 for r in got)
    per = out.groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count").alias("hi"), F.min("count").alias("lo"))
    assert all(r.hi - r.lo <= 1 for r in per.collect())


def test_repetition_limit(spark):
    docs = sourced(spark, {"a": 1000, "b": 500, "c": 100})
    out = mixing.mix(docs, max_repeats=2)
    per = {r.source: r for r in out.groupBy("source").agg(F.count("*").alias("n"), F.max("mix_epoch").alias("e")).collect()}
    assert per["a"].n == 1000 and per["a"].e == 0
    assert 190 <= per["c"].n <= 200 and out.select("doc_id").distinct().count() == 1600


def test_mix_keeps_columns_and_budget(spark):
    odd = cases.odd(spark)
    out = mixing.mix(odd, target_entropy=0.5, source_col="label", budget=1000)
    assert out.columns[: len(odd.columns)] == odd.columns
    assert out.agg(F.sum("mix_tokens").alias("n")).first().n <= 1000
    with pytest.raises(ValueError, match="target_entropy or max_repeats"):
        mixing.mix(odd)


def test_rules_can_be_filtered(spark):
    """A filter on the measures gives the rows that they have, without computing the arrays for every element."""
    out = quality_rules.op3_quality_rules(spark, "/root/testdata/sf0.01")
    rows = out.collect()
    assert out.where("kept and n_repeat_words > 3").count() == sum(r.kept and r.n_repeat_words > 3 for r in rows)
    assert out.where("not base_failed").agg(F.sum("n_words")).first()[0] == sum(r.n_words for r in rows if not r.base_failed)


def test_neighbours_alone_find_copies(spark):
    """Of texts that few rows share the sort leaves one run each."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    runs = exact_dedup._runs(docs, "doc_id", F.col("text"), "largest", []).where("__rn = 1")
    assert runs.count() == docs.select("text").distinct().count()


def test_drop_exact_of_hot_text(spark):
    """Pieces of a hot text, null texts that equal an empty one, repeated rows: one row of each text stays."""
    rows = [(i, "hot") for i in range(1000)] + [(999, "hot")] * 600 + [(5000, None), (4999, ""), (6000, "one")]
    out = exact_dedup.drop_exact(cases.texts(spark, rows), keep="largest").collect()
    assert sorted((r.doc_id, r.text) for r in out if r.text) == [(999, "hot"), (6000, "one")]
    assert [(r.doc_id, r.text) for r in out if not r.text] == [(5000, None)]


def test_one_id_is_dealt_to_ranges(spark):
    rows = [(1, f"text {i}") for i in range(500)]
    out = sharding.assign_shards(cases.texts(spark, rows), 7, sub_ranges=16)
    got = out.collect()
    assert len({r.shard for r in got}) == 1 and sorted(r.slot for r in got) == list(range(500))


def test_jumps_beyond_the_usual_number_of_steps(spark):
    """The walk that is cut short and finished is the whole walk."""
    keys = spark.range(200).select(sharding.key_hash(F.col("id")).alias("k"))
    for n in (1, 2, 3, 15, 300):
        def walk(k):
            k, j, at = int(k), 0, []
            while j < n:
                at.append(j)
                k = (k * 2862933555777941757 + 1) % 2**64
                j = int((j + 1) * (2**31 / ((k >> 33) + 1)))
            return at

        for r in keys.select("k", sharding.jumps(F.col("k"), n).alias("at")).collect():
            assert r["at"] == walk(r.k)


def test_ties_stay_within_the_quota(spark):
    """Rows that tie go together, and not past the quota."""
    rows = [(1, "a b c d", "x")] * 40 + [(i, "a b", "y") for i in range(10, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, target_entropy=0.99, blocks=4).groupBy("source").agg(
        F.sum("mix_tokens").alias("n"), F.first("mix_quota").alias("q")
    )
    for r in out.collect():
        assert r.n <= r.q + 1e-6


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 3)
    docs = spark.createDataFrame([(i, "a", str(i)) for i in range(5)], "doc_id long, text string, source string")
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(docs, target_entropy=0.9)


def test_release_deletes(spark):
    one = materialise(spark.range(3))
    two = materialise(one, one)
    assert two.count() == 3
    with pytest.raises(AnalysisException):
        spark.read.parquet(one._written)
    release(two)
