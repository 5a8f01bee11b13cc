"""Scalars and small operators against values worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from pairloom import sources
from pairloom.functions import edit, features, text
from pairloom.operators import datasets, knn, lm, metrics, pairs
from pairloom.streaming import ingest_sentences


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "want"),
    [(0.0, 0.0), (0.025, 0.0), (0.075, 0.05), (0.125, 0.1), (0.12, 0.1), (2.0, 2.0), (0.99, 1.0)],
)
def test_bucket(spark, given, want):
    assert one(spark, features.bucket(F.col("v")), v=given) == want


@pytest.mark.parametrize(
    ("a", "b", "contained", "overlapping"),
    [
        ("abc", "abc", True, False), ("abcdef", "abc", True, False), ("abcdefgh", "fghijklm", False, True), ("abcdefgh", "hijklmno", False, False),
        ("abcd", "", True, True), ("", "", True, False), ("xyz", "abc", False, False),
    ],
)
def test_pair_predicates(spark, a, b, contained, overlapping):
    assert one(spark, pairs.contained(F.col("a"), F.col("b")), a=a, b=b) == contained
    assert one(spark, pairs.overlapping(F.col("a"), F.col("b")), a=a, b=b) == overlapping
    assert one(spark, pairs.overlapping(F.col("b"), F.col("a")), a=a, b=b) == overlapping


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def fewest(a, b):
    """(cost, replacements) by the table as it is defined."""
    row = [(j, 0) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], (i, 0)
        for j, y in enumerate(b, 1):
            best = old if x == y else (old[0] + 1, old[1] + 1)
            old = row[j]
            row[j] = min(best, (old[0] + 1, old[1]), (row[j - 1][0] + 1, row[j - 1][1]))
    return row[-1][1]


def test_edit_distances(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(0, 14)))
    some = [(word(), word()) for _ in range(400)] + [("", ""), ("kitten", "sitting"), ("é", "e")]
    assert [edit.lcs_length(a, b) for a, b in some] == [lcs(a, b) for a, b in some]
    assert edit.replacements(*map(list, zip(*some, strict=True))).tolist() == [fewest(a, b) for a, b in some]
    df = spark.createDataFrame([*some, (None, "a")], "a string, b string")
    out = df.select("a", "b", edit.indel_distance(F.col("a"), F.col("b")).alias("d"), edit.replace_only(F.col("a"), F.col("b")).alias("r")).collect()
    for x in out:
        if x.a is None:
            assert x.d is None and x.r is None
        else:
            assert 0 <= x.d <= 1 and (x.d == 0) == (x.a == x.b)
    assert one(spark, edit.different_enough(F.col("a"), F.col("b")), a="A B C", b="abc") is False


def test_control_tokens(spark):
    t = "<A_0.5> <B_1> rest < of it"
    assert one(spark, text.control_tokens(F.col("t")), t=t) == "<A_0.5> <B_1>"
    assert one(spark, text.without_control_tokens(F.col("t")), t=t) == "rest < of it"
    assert one(spark, text.without_control_tokens(F.col("t")), t="plain") == "plain"
    steps = [features.PREPROCESSORS["LengthRatio"](), features.PREPROCESSORS["Levenshtein"]()]
    assert one(spark, features.encode(F.col("t"), steps), t="a b") == "<LEVENSHTEIN_0.8> <LENGTHRATIO_0.8> a b"


@pytest.mark.parametrize(("t", "want"), [("a.", "a."), ("a b.", "a b."), ("a b c d e.", "a b c d."), ("a b c", "a b.")])
def test_truncate(spark, t, want):
    assert one(spark, text.truncate(F.col("t")), t=t) == want


def test_text_edges(spark):
    assert one(spark, text.punctuation_ratio(F.col("t")), t="   ") == 0.0
    assert one(spark, text.too_much_punctuation(F.col("t")), t="abcdefghi.") is False
    assert one(spark, text.unescape_brackets(F.col("t")), t="-LRB- x -rSb-") == "( x ]"
    assert one(spark, text.nfkc(F.col("t")), t="ﬁ ½") == "fi 1⁄2"
    assert one(spark, text.lm_normalize(F.col("t")), t=" Aé 12１…\x01 ") == "Aé 000..."
    assert one(spark, text.lm_normalize(F.col("t")), t="\t\u00a0x\u0663\x1c\n") == "x0"
    assert one(spark, text.lm_normalize(F.col("t")), t="a，b。c、d∶e：f") == "a,b.c,d:e:f"
    assert one(spark, text.lm_normalize(F.col("t")), t="„a” “b” «c» 「d」 《e》 ´f’") == '"a" "b" "c" "d" "e" \'f\''
    assert one(spark, text.lm_normalize(F.col("t")), t="？！（a）；～〈b〉【c】％") == "?!(a);~<b>[c]%"
    assert one(spark, text.lm_normalize(F.col("t")), t="a–b—c━d►e．f…") == "a-b - c-d-e. f..."
    assert one(spark, text.lm_normalize(F.col("t"), numbers=False), t="１2") == '"2'
    assert one(spark, text.lm_normalize(F.col("t"), punctuation="remove"), t="a—b…c，１") == "abc0"
    assert one(spark, text.sentence_array(F.col("t")), t="") == []
    assert one(spark, text.window_array(text.sentence_array(F.col("t"))), t="") == []


def test_windows(spark):
    t = "Aaaa bbb. Cccc. Dddd eeee ffff. " + "g" * 301
    got = one(spark, text.window_array(text.sentence_array(F.col("t"))), t=t)
    s = ["Aaaa bbb.", "Cccc.", "Dddd eeee ffff.", "g" * 301]
    want = [(i + 1, j, " ".join(s[i:j])) for i in range(4) for j in range(i + 1, 5) if 10 <= len(" ".join(s[i:j])) <= 300]
    assert [tuple(x) for x in got] == want


def test_density_filter(spark):
    rows = [(1, 1, 0.0), (1, 20, 0.01), (1, 30, 0.06), (1, 8, 0.02), (2, 50, 0.05), (2, 60, 0.05)]
    near = spark.createDataFrame(rows, "query_id long, neighbor_id long, distance double")
    out = knn.candidate_pairs(near, distance=0.05, density=0.6, id_gap=10)
    assert [(r.query_id, r.neighbor_id) for r in out.collect()] == [(1, 20)]


def test_ivf_recall(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    exact = {(r.query_id, r.neighbor_id) for r in knn.knn(e, e).collect()}
    index = knn.Index.train(e, dims=64)
    found = {(r.query_id, r.neighbor_id) for r in knn.ivf_knn(e, e, index, probes=16).collect()}
    assert len(exact & found) >= 0.9 * len(exact)


def test_intervals(spark):
    runs = spark.createDataFrame([("a", i, float(i)) for i in range(8)] + [("b", i, float(i)) for i in range(7)] + [("c", 0, 1.0)], "g string, run int, v double")
    out = {r.g: r for r in metrics.mean_intervals(metrics.last_runs(runs, ["g"], "run"), ["g"], "v").collect()}
    assert (out["a"].n, out["b"].n, out["c"].n) == (8, 5, 1)
    assert out["b"].mean == 4.0 and abs(out["b"].ci - 2.776445 * 2.5**0.5 / 5**0.5) < 1e-9
    assert out["c"].ci is None


def test_scores(spark):
    same = spark.createDataFrame([(1, "a b c d e", "a b c d e")], "i int, h string, r string")
    assert abs(metrics.bleu(same, "h", "r").first().bleu - 100) < 1e-9
    assert one(spark, features.harmonic_mean([F.col("a"), F.col("b")]), a=0.0, b=1.0) == 0.0
    assert one(spark, features.safe_divide(F.col("a"), F.col("b")), a=1.0, b=0.0) == 0.0
    d = spark.createDataFrame([(1, "a a b")], "i int, text string")
    grams = {r.gram: r.n for r in lm.ngram_counts(d, "text", 3).collect()}
    assert grams == {"<s> a a": 1, "a a b": 1, "a b </s>": 1}


def test_positional_join(spark):
    a = spark.createDataFrame([(0, "a"), (1, "b")], "row_id long, l string")
    b = spark.createDataFrame([(0, "x")], "row_id long, r string")
    assert {(r.row_id, r.l, r.r) for r in datasets.positional_join(a, b).collect()} == {(0, "a", "x"), (1, "b", None)}
    with pytest.raises(Exception, match="differ in length"):
        datasets.positional_join(a, b, strict=True).collect()


def test_split_is_whole(spark):
    out = datasets.split_dataset(spark.range(500).withColumnRenamed("id", "k"), "k", 50, 70).groupBy("phase").count().collect()
    assert {r.phase: r["count"] for r in out} == {"test": 50, "valid": 70, "train": 380}


def test_cyclic_lineage(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c")], "dataset string, original string")
    assert {r.dataset for r in datasets.descendants(edges, "a").collect()} == {"a", "b", "c"}
    assert {r.dataset for r in datasets.ancestors(edges, "c").collect()} >= {"a", "b"}


def test_sources(spark, tmp_path):
    d = str(tmp_path)
    lines = spark.createDataFrame([("one",), ("two",)], "value string").coalesce(1)
    sources.write_lines(lines, f"{d}/lines", compression="gzip")
    assert [r.value for r in sources.read_lines(spark, f"{d}/lines").collect()] == ["one", "two"]
    assert [(r.row_id, r.value) for r in sources.read_numbered_lines(spark, f"{d}/lines").orderBy("row_id").collect()] == [(0, "one"), (1, "two")]
    p = spark.createDataFrame([('say "x"', "tab\there")], "complex string, simple string")
    sources.write_pairs(p, f"{d}/pairs")
    assert [tuple(r) for r in sources.read_pairs(spark, f"{d}/pairs").collect()] == [('say "x"', "tab here")]
    (tmp_path / "docs.json").write_text('{"raw_content": "a\\nb", "url": 1}\n{"url": 2}\n')
    assert [r.raw_content for r in sources.read_documents(spark, f"{d}/docs.json").collect()] == ["a\nb", None]


def test_ingest_takes_each_file_once(spark, tmp_path):
    d = str(tmp_path)
    docs = lambda i: spark.createDataFrame([(i, f"This is a sentence of document number {i}.", "en")], "doc_id long, text string, lang string")
    docs(1).write.parquet(f"{d}/in/a")
    run = lambda: ingest_sentences(spark, f"{d}/in/*", f"{d}/out", f"{d}/checkpoint").awaitTermination()
    run()
    docs(2).write.parquet(f"{d}/in/b")
    run()
    run()
    assert sorted(r.doc_id for r in spark.read.parquet(f"{d}/out").collect()) == [1, 2]
