import random

import pytest

from pairloom.llm import _bwt, substring_dedup

from . import cases


def brute(texts, length):
    """For each text the removed runs, as (first, end)."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for k, r in enumerate(raw):
        for i in range(len(r) - length + 1):
            seen.setdefault(r[i : i + length], []).append((k, i))
    cover = [bytearray(len(r)) for r in raw]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                cover[k][i : i + length] = b"\1" * length
    out = []
    for c in cover:
        runs, i = [], 0
        while i < len(c):
            if c[i]:
                j = i
                while j < len(c) and c[j]:
                    j += 1
                runs.append((i, j))
                i = j
            else:
                i += 1
        out.append(runs)
    return out


def check(spark, texts, length, **more):
    out = substring_dedup.remove_repeats(cases.texts(spark, list(enumerate(texts))), min_length=length, **more).collect()
    want = brute(texts, length)
    assert len(out) == len(texts)
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        assert [(x.a, x.b) for x in r.removed] == want[r.doc_id]
        edges = [0, *(e for run in want[r.doc_id] for e in run), len(raw)]
        assert bytes(r.kept) == b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
        assert r.n_bytes == len(raw)


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 90))) for _ in range(40)]
    passage = "".join(rng.choice("abcdé") for _ in range(60))
    texts += ["x" * rng.randint(0, 9) + passage[rng.randint(0, 20) :] + "y" * rng.randint(0, 50) for _ in range(20)]
    check(spark, texts, 20)


@pytest.mark.parametrize("group_bytes", [1, 1 << 20])
def test_periodic_and_large_groups(spark, group_bytes):
    """Texts that repeat themselves; groups beyond a block are solved by counted hashes, with the same result."""
    texts = ["ab" * 50, "ab" * 10, "a" * 77, "abc" * 30 + "z", None, "", "q" * 20, "q" * 19, "Q" + "q" * 20]
    check(spark, texts, 20, group_bytes=group_bytes)


def test_production_length(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    check(spark, texts, 400)


def test_boundaries(spark):
    s = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(399))
    check(spark, [s + "A", "B" + s + "A", s + "C"], 400)


def test_odd_rows(spark):
    out = substring_dedup.remove_repeats(cases.odd(spark)).collect()
    assert len(out) == len(cases.ODD)
    assert sum(r.doc_id is None for r in out) == 1
    long = next(r for r in out if r.doc_id == 9)
    assert len(long.kept) == 0 and long.n_bytes == 18 * 20_000
    assert substring_dedup.remove_repeats(cases.none(spark)).collect() == []


def test_groups_by_transform():
    rng = random.Random(5)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60))) for _ in range(30)]
    owner, start, group = _bwt.groups(strings, 7)
    by = {}
    for o, s, g in zip(owner.tolist(), start.tolist(), group.tolist(), strict=True):
        by.setdefault(g, set()).add(strings[o][s : s + 7])
    assert all(len(x) == 1 for x in by.values())
    assert len(by) == len({x for y in by.values() for x in y})
    assert len(owner) == sum(max(0, len(s) - 6) for s in strings)
