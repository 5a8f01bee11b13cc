import random
import re

import pytest

from pairloom.llm import near_dedup
from pairloom.llm._components import components

from . import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, size):
    ws = WORD.findall(fold(text or ""))
    if not ws:
        return set()
    return {tuple(ws)} if len(ws) < size else {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)}


def brute(rows, size):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(near_dedup.op1_near_dedup(spark, sf_dir)) == brute(rows, 2)


@pytest.mark.parametrize("size", [2, 5])
def test_planted(spark, size):
    """Groups of near copies around the threshold, chains, strangers that share many words."""
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((n, " ".join(copy) if rng.random() < 0.5 else "\t".join(copy).upper()))
            n += 1
    assert got(near_dedup.near_duplicates(cases.texts(spark, rows), shingle=size)) == brute(rows, size)


def test_large_group_and_strangers(spark):
    """A third of the rows are near copies; others share all but a few of their frequent words."""
    rng = random.Random(3)
    base = [f"c{i}" for i in range(200)]
    rows = []
    for i in range(300):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, " ".join(["the"] * 40 + [f"s{i}_{k}" for k in range(rng.randint(1, 30))])) for i in range(300)]
    assert got(near_dedup.near_duplicates(cases.texts(spark, rows), shingle=2)) == brute(rows, 2)


def test_odd_rows(spark):
    out = near_dedup.near_duplicates(cases.odd(spark)).collect()
    assert len(out) == len(cases.ODD)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].n_shingles == 0 and by[2][0].component_id == 2 and by[2][0].kept
    assert by[4][0].n_shingles == 0 and by[4][0].component_id == 4
    assert [r.component_id for r in by[5]] == [1, 1] and not any(r.kept for r in by[5])
    assert by[6][0].n_shingles == 1
    assert len(by[None]) == 1 and by[None][0].kept
    assert near_dedup.near_duplicates(cases.none(spark)).collect() == []


def test_drop_keeps_columns(spark):
    out = near_dedup.drop_near_duplicates(cases.odd(spark))
    assert out.columns == cases.odd(spark).columns
    ids = [r.doc_id for r in out.collect()]
    assert 5 not in ids and {1, 2, 3, 4, 6, 7, 8, 9, None} == set(ids)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    out = {r.a: r.b for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {i: 0 for i in range(1, 41)} | {100: 90, 95: 90}
