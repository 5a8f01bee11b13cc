"""Near duplicates by a chosen-path set similarity join (Christiani, Pagh and Sivertsen, 2018).

A text is its set of distinct word shingles. Texts with one set are taken together first. Each set gets T minwise
tokens: the smallest shingle under each of T hash functions; two sets agree in one of them with a probability that is
their similarity.

Trees: the root holds all sets. A node selects some of the T hash functions, by a hash of its own path, and each set in
it goes to the child of its minwise token there. A node that is small is compared exhaustively, a larger one branches
again, into one child or two by a hash of the node, so that a pair at the threshold shares a little more than one child
on average at every level. The probability that it stays together falls slowly with the depth at which nodes become
small; when the depth is known, independent trees are added until MISSED is reached for a pair at the threshold.

Hot groups: of the sets that agree in a path of PATH tokens each is first compared with two of them alone, and the
confirmed links are contracted to labels. In the trees only pairs of different labels count. A node with one label is
done, however large; a node counts as small by its number of pairs of different labels, so that a large group of
copies with a few strangers costs its size times the strangers. No pair within a group has to be listed.

Candidates are filtered by sizes and by two bits of each minwise token (a bound five standard deviations below the
threshold), and confirmed on their full sets of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom._ship import ship
from pairloom.llm._common import materialise, table
from pairloom.llm._components import components
from pairloom.llm._text import columns, mix64, shingles, split_batch, words

T = 128
#: Trees that are grown first; more follow if the depth they reach asks for them.
TREES = 4
#: Levels whose nodes select two children at least.
BINARY = 2
#: Children that a pair at the threshold shares at a deeper node, on average.
SHARED = 1.04
#: The probability that all trees miss a pair at the threshold, at most.
MISSED = 1e-3
#: A node is small if its pairs of different labels are no more than so many times its members: CHUNK members of as
#: many labels, which make one block, have just so many.
PAIRS_PER_MEMBER = 2048
#: The smallest hashes of a set that are kept to compare sets of crowded nodes by; smaller sets are kept whole.
LOWEST = 256
#: Pairs of different labels from which on a node is crowded.
CROWD = 1000
#: Members of a node that meet in one block, and pairs that are compared at once.
CHUNK = 4096
PAIRS_AT_ONCE = 200_000
#: A guard: nodes of sets that agree in every minwise token never fall apart. What is left then is compared in blocks.
DEPTH = 64
PATH, PATHS = 4, 8
#: Pieces of a path's sets that get a hub of their own.
SALTS = 16
#: Candidate ids that are sent to every executor (8 bytes each); beyond, texts are joined with them by a shuffle.
SENT_IDS = 4_000_000

_MULTIPLIERS = np.random.default_rng(77).integers(0, 1 << 63, T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sketch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in split_batch(batch, 1):
            n = part.num_rows
            row, _, _, value = words(*columns(part, 1))
            at, got = shingles(row, value, n, size)
            count = np.bincount(at, minlength=n)
            some = np.flatnonzero(count)
            begin = (np.cumsum(count) - count)[some]
            tokens = np.zeros((n, T), np.uint32)
            digest = np.zeros((n, 2), np.int64)
            if len(some):
                for k, m in enumerate(_MULTIPLIERS):
                    tokens[some, k] = np.minimum.reduceat((got * m) >> np.uint64(32), begin)
                for k, salt in enumerate((0x1B873593, 0x5BD1E995)):
                    digest[some, k] = np.add.reduceat(mix64(got ^ np.uint64(salt)), begin).view(np.int64)
            two = (mix64(tokens.astype(np.uint64)) & np.uint64(3)).reshape(n, 4, 32)
            bits = (two << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64).view(np.int64)
            flat = pa.array(tokens.view(np.int32).reshape(-1))
            edges = pa.array((np.arange(n + 1) * T).astype(np.int32))
            # hashes are sorted within a row: its first ones are its smallest
            low = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) < LOWEST
            small = pa.array(((got[low] >> np.uint64(32)) ^ np.uint64(0x80000000)).astype(np.uint32).view(np.int32))
            until = pa.array(np.concatenate([[0], np.cumsum(np.minimum(count, LOWEST))]).astype(np.int32))
            cols = [part.column(0), pa.array(count), *(pa.array(digest[:, k].copy()) for k in (0, 1))]
            cols += [*(pa.array(bits[:, k].copy()) for k in range(4)), pa.ListArray.from_arrays(edges, flat), pa.ListArray.from_arrays(until, small)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n", "s0", "s1", "b0", "b1", "b2", "b3", "mh", "low"])


_BITS = ("b0", "b1", "b2", "b3")
_SKETCH = "id long, n long, s0 long, s1 long, b0 long, b1 long, b2 long, b3 long, mh array<int>, low array<int>"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(id, set): the sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in split_batch(batch, 1):
                row, _, _, value = words(*columns(part, 1))
                at, got = shingles(row, value, part.num_rows, size)
                edges = np.searchsorted(at, np.arange(part.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(got.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["id", "set"])

    return texts.mapInArrow(run, "id long, set array<long>")


def _most(percent: int) -> int:
    """How many of the T pairs of bits may differ: five standard deviations above what a pair at the threshold has."""
    p = percent / 100
    match = p + (1 - p) / 4
    return int(T * (1 - match) + 5 * (T * match * (1 - match)) ** 0.5) + 1


def _alike(a: str, b: str, percent: int) -> Column:
    """True unless sizes or sketches say that a pair can't reach the threshold."""
    col = lambda side, name: F.col(f"{side}.{name}")
    differ = None
    for name in _BITS:
        x = col(a, name).bitwiseXOR(col(b, name))
        one = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        differ = one if differ is None else differ + one
    low, high = F.least(col(a, "n"), col(b, "n")), F.greatest(col(a, "n"), col(b, "n"))
    return (low * 100 >= high * percent) & (differ <= _most(percent))


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs(a, b) those whose full sets reach the threshold."""
    pairs = materialise(pairs.select("a", "b").distinct())
    ids = materialise(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    few = ids.limit(SENT_IDS + 1).count() <= SENT_IDS
    # one row for an id, also where rows of documents repeat it with other texts: see near_duplicates
    chosen = texts.join(F.broadcast(ids) if few else ids, "id", "left_semi")
    sets = materialise(_sets(chosen, size))
    one = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    two = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return materialise(
        pairs.join(one, "a").join(two, "b").where(common * 100 >= union * percent).select("a", "b"), pairs, ids, sets
    )


def _stars(reps: DataFrame, percent: int) -> DataFrame:
    """Candidates: each set with two hubs of its path of PATH minwise tokens, for PATHS paths.

    The sets of a path are dealt to SALTS pieces by a hash of their id. The smallest id of each piece is a hub; a set
    meets the smallest hub of all and that of the next piece there is, so that one odd hub doesn't part a group.
    """
    path = lambda p: F.xxhash64(F.lit(p), *[F.element_at("mh", p * PATH + i + 1) for i in range(PATH)])
    keyed = reps.select("id", "n", *_BITS, F.explode(F.array(*[path(p) for p in range(PATHS)])).alias("key"))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("id", "key"), F.lit(SALTS)).cast("int"))
    hub = F.min(F.struct("id", "n", *_BITS)).alias("h")
    pieces = keyed.groupBy("key", "salt").agg(hub, F.count(F.lit(1)).alias("c"))
    hubs = pieces.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("salt", "h"))).alias("hs"), F.sum("c").alias("c")).where("c > 1")
    size = F.size("hs")
    least = F.array_min(F.transform("hs", lambda x: x["h"]))
    for_piece = F.transform(
        "hs", lambda x, i: F.struct(x["salt"].alias("salt"), F.array_distinct(F.array(least, F.get("hs", (i + 1) % size)["h"])).alias("to"))
    )
    hubs = hubs.select("key", F.inline(for_piece)).select("key", "salt", F.explode("to").alias("h"))
    hubs = hubs.select("key", "salt", *[F.col(f"h.{c}").alias(c) for c in ("id", "n", *_BITS)])
    on = (F.col("x.key") == F.col("h.key")) & (F.col("x.salt") == F.col("h.salt")) & (F.col("h.id") != F.col("x.id"))
    met = keyed.alias("x").join(hubs.alias("h"), on & _alike("x", "h", percent))
    return met.select(F.least("h.id", "x.id").alias("a"), F.greatest("h.id", "x.id").alias("b"))


def _branches(level: int, percent: int) -> float:
    """The children that a node of a level selects, on average; the fraction is the share of nodes that select one more."""
    mean = SHARED * 100 / percent
    return max(2.0, mean) if level < BINARY else mean


def together(depth: int, percent: int) -> float:
    """The probability that a pair at the threshold shares a node at a depth of one tree, minwise tokens taken as independent."""
    p = 1.0
    for level in reversed(range(depth)):
        mean = _branches(level, percent)
        apart = 1 - percent / 100 * p
        p = 1 - apart ** int(mean) * (1 - (mean - int(mean)) * (1 - apart))
    return p


def trees_for(depth: int, percent: int) -> int:
    apart = 1 - together(depth, percent)
    return max(TREES, int(np.ceil(np.log(MISSED) / np.log(apart)))) if apart > 0 else TREES


def _children(level: int, key: Column, mh: Column, percent: int) -> Column:
    """The keys of the children that a set with the minwise tokens mh goes to."""
    mean = _branches(level, percent)
    share = round((mean - int(mean)) * 10_000)
    out = []
    for j in range(int(mean) + (share > 0)):
        place = F.pmod(F.xxhash64(key, F.lit(1000 + j)), F.lit(T)).cast("int")
        child = F.xxhash64(key, place, F.get(mh, place))
        out.append(child if j < int(mean) else F.when(F.pmod(F.xxhash64(key, F.lit(999)), F.lit(10_000)) < share, child))
    return F.array_distinct(F.array_compact(F.array(*out)))


def _of(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of table with one of the ids."""
    ids = materialise(ids.select("id").distinct())
    few = ids.limit(SENT_IDS + 1).count() <= SENT_IDS
    return table.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def _blocks(small: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(blk, right, id, n, bits, label, extra): the members of small nodes, dealt to blocks of bounded size.

    In a node the strangers, whose label isn't the largest one, meet all others; pairs within the largest label are
    linked already. A node of more than CHUNK members is cut: strangers and the rest are dealt to chunks by a hash, and
    each chunk of strangers meets each chunk in a block of its own. Small nodes have few strangers, so that the members
    of the largest label go to one or two blocks each, however many they are.
    """
    held = ["id", "n", *_BITS, "label", *extra]
    stranger = F.col("label") != F.col("major")
    plain = small.where(F.col("m") <= CHUNK).select(F.col("key").alias("blk"), (~stranger).alias("right"), *held)
    cut = lambda c: F.greatest(F.lit(1), F.ceil(c / F.lit(CHUNK))).cast("int")
    wide = small.where(F.col("m") > CHUNK).withColumns({"s": cut(F.col("m") - F.col("mc")), "t": cut(F.col("mc")), "st": stranger})
    chunk = F.pmod(F.xxhash64("id", "key"), F.when(F.col("st"), F.col("s")).otherwise(F.col("t"))).cast("int")
    wide = wide.withColumn("c", chunk)
    spot = lambda i, j, right: F.struct(i.alias("i"), j.alias("j"), right.alias("right"))
    of_stranger = F.transform(
        F.sequence(F.lit(0), F.col("s") + F.col("t") - 1),
        lambda j: F.when(j < F.col("s"), spot(F.least("c", j), F.greatest("c", j), j < F.col("c"))).otherwise(spot(F.col("c"), j, F.lit(False))),
    )
    of_rest = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda i: spot(i, F.col("s") + F.col("c"), F.lit(True)))
    wide = wide.withColumn("e", F.explode(F.when(F.col("st"), of_stranger).otherwise(of_rest)))
    return plain.unionByName(wide.select(F.xxhash64("key", "e.i", "e.j").alias("blk"), F.col("e.right").alias("right"), *held))


def _similar(i: np.ndarray, j: np.ndarray, n: np.ndarray, bits: list[np.ndarray], percent: int, most: int) -> np.ndarray:
    """Which of the pairs (i, j) sizes and sketches leave possible."""
    x, y = n[i], n[j]
    at = np.flatnonzero(np.minimum(x, y) * 100 >= np.maximum(x, y) * percent)
    differ = np.zeros(len(at), np.int64)
    for b in bits:
        v = b[i[at]] ^ b[j[at]]
        differ += np.bitwise_count((v | (v >> np.uint64(1))) & np.uint64(0x5555555555555555))
        ok = differ <= most
        at, differ = at[ok], differ[ok]
    return at


def _ranks(low: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    """The lists as a matrix of the ranks of their values among all there are, filled up with the first number that is
    no rank; and that number."""
    lists = low.combine_chunks()
    values, rank = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    size = np.diff(lists.offsets.to_numpy())
    out = np.full((len(size), LOWEST), len(values), np.int32)
    out[np.arange(LOWEST) < size[:, None]] = rank
    return out, len(values)


def _low_similar(i: np.ndarray, j: np.ndarray, n: np.ndarray, ranks: np.ndarray, none: int, percent: int) -> np.ndarray:
    """Which of the pairs (i, j), sorted by i, the smallest hashes of both sets leave possible.

    What the lists hold up to the smaller of their ends is a sample of both sets; of two sets that are kept whole it is
    all. The bound is four standard deviations of a sample without replacement below the threshold, and 0.01 for
    hashes of 32 bits that agree by chance."""
    p = percent / 100
    end = np.where(n > LOWEST, ranks[:, -1], none - 1)
    mark = np.zeros(none + 1, bool)
    out = np.zeros(len(i), bool)
    cuts = np.flatnonzero(np.diff(i, prepend=-1, append=-1))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        row, others = int(i[a]), j[a:b]
        mine = ranks[row]
        mark[mine] = True
        mark[none] = False
        theirs = ranks[others]
        common = mark[theirs].sum(axis=1)
        mark[mine] = False
        limit = np.minimum(end[row], end[others])
        seen = np.searchsorted(mine, limit, side="right") + (theirs <= limit[:, None]).sum(axis=1) - common
        union = (n[row] + n[others]) / (1 + p)
        part = np.maximum(0.0, 1 - seen / union)
        exact = (n[row] <= LOWEST) & (n[others] <= LOWEST)
        slack = np.where(exact, 0.01, 0.01 + 4 * np.sqrt(part * p * (1 - p) / np.maximum(seen, 1)))
        out[a:b] = common >= seen * (p - slack)
    return np.flatnonzero(out)


def _compare(batches: Iterator[pa.RecordBatch], percent: int, crowd: bool) -> Iterator[pa.RecordBatch]:
    """Candidates (a, b) of blocks, which come sorted: the rows of a block side by side, its left rows first."""
    most = _most(percent)

    def block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        blk, right, ids, n, *bits, label = (table.column(k).to_numpy() for k in range(5 + len(_BITS)))
        bits = [b.view(np.uint64) for b in bits]
        ranks = _ranks(table.column(5 + len(_BITS))) if crowd else None
        edge = np.flatnonzero(np.concatenate([blk[1:] != blk[:-1], [True]])) + 1
        end = edge[np.searchsorted(edge, np.arange(len(blk)), side="right")]
        left = np.flatnonzero(~right)
        count = end[left] - left - 1
        upto = np.cumsum(count)
        k = 0
        while k < len(left):
            stop = max(k + 1, int(np.searchsorted(upto, upto[k] - count[k] + PAIRS_AT_ONCE, side="right")))
            c = count[k:stop]
            i = np.repeat(left[k:stop], c)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
            k = stop
            strange = label[i] != label[j]
            i, j = i[strange], j[strange]
            at = _similar(i, j, n, bits, percent, most)
            i, j = i[at], j[at]
            if crowd and len(i):
                at = _low_similar(i, j, n, *ranks, percent)
                i, j = i[at], j[at]
            if len(i):
                a, b = ids[i], ids[j]
                pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < CHUNK:
            continue
        # all but the last block, which may go on
        whole = pa.Table.from_batches(held)
        blk = whole.column(0).to_numpy()
        first = int(np.flatnonzero(blk != blk[-1])[-1]) + 1 if blk[0] != blk[-1] else 0
        if first:
            yield from block(whole.slice(0, first))
        held = whole.slice(first).combine_chunks().to_batches()
        rows = whole.num_rows - first
    if rows:
        yield from block(pa.Table.from_batches(held))


def _meetings(small: DataFrame, percent: int, crowd: bool) -> DataFrame:
    """Candidates of small nodes. Those of a crowd come with their smallest hashes, low."""
    dealt = _blocks(small, ("low",) if crowd else ()).repartition("blk").sortWithinPartitions("blk", "right")
    return dealt.mapInArrow(lambda it: _compare(it, percent, crowd), "a long, b long")


def _trees(reps: DataFrame, labels: DataFrame, rows: DataFrame, percent: int, trees: range) -> tuple[DataFrame, int]:
    """Candidates of the trees, and their depth. reps: id, n, bits, mh; labels: id, label, of those that aren't their own;
    rows: id, n, low."""
    held = ["id", "n", *_BITS, "label"]
    root = F.flatten(F.array(*[_children(0, F.xxhash64(F.lit(-1 - t)), F.col("mh"), percent) for t in trees])).alias("keys")
    members = reps.select("id", "n", *_BITS, root).join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    members = members.select(*held, F.explode("keys").alias("key"))
    tokens, smalls = reps.select("id", "mh"), None
    for level in range(1, DEPTH + 1):
        by_label = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
        nodes = by_label.groupBy("key").agg(
            F.sum("c").alias("m"),
            F.sum(F.col("c").cast("double") * F.col("c")).alias("sq"),
            F.count(F.lit(1)).alias("labels"),
            F.max(F.struct("c", "label")).alias("most"),
        ).where("labels > 1")
        pairs = (F.col("m").cast("double") * F.col("m") - F.col("sq")) / 2
        is_small = (pairs <= F.col("m") * PAIRS_PER_MEMBER) | F.lit(level == DEPTH)
        nodes = nodes.select("key", "m", F.col("most.label").alias("major"), F.col("most.c").alias("mc"), is_small.alias("small"), (pairs > CROWD).alias("crowd"))
        members = materialise(members.join(nodes, "key"))
        small = members.where("small")
        smalls = small if smalls is None else smalls.unionByName(small)
        large = members.where("not small").select(*held, "key")
        if level == DEPTH or large.isEmpty():
            break
        # only the tokens of what is left go on to the next level
        tokens = materialise(_of(tokens, large))
        # a set meets its tokens once, however many nodes hold it
        large = large.groupBy("id").agg(F.collect_set(F.struct(*held[1:], "key")).alias("__in"))
        large = large.join(tokens, "id").select("id", "mh", F.inline("__in"))
        large = large.select(*held, F.explode(_children(level, F.col("key"), F.col("mh"), percent)).alias("key"))
        members = materialise(large.distinct())
    crowd = smalls.where("crowd")
    low = _of(rows.select("id", "n", "low"), crowd).groupBy("id").agg(F.max_by("low", "n").alias("low"))
    return _meetings(smalls.where("not crowd"), percent, False).unionByName(_meetings(crowd.join(low, "id"), percent, True)), level


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """One row per input row: the id, n_shingles, component_id, kept.

    Texts are linked if their shingle sets have a similarity of percent / 100 or more; component_id is the smallest id
    reachable over links. A text with fewer words than a shingle has one shingle of them all. A null text, or one
    without words, has none and is linked with nothing. Of rows with one id and one set, one is kept. A null id is
    counted as the smallest possible id. Ids should tell rows apart: of rows with one id but different texts, each text
    is linked by itself, a link of one may count for another, and one row is kept. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    lowest = F.lit(-(2**63))
    texts = _texts(docs, id_col, text_col).withColumn("id", F.coalesce("id", lowest))
    rows = materialise(texts.mapInArrow(lambda it: _sketch(it, shingle), _SKETCH))
    # equal sets: the smallest id stands for them
    one_set = rows.where("n > 0").groupBy("n", "s0", "s1").agg(F.min("id").alias("rep"))
    reps = rows.where("n > 0").groupBy("n", "s0", "s1").agg(
        F.min(F.struct("id", *_BITS, "mh")).alias("r")
    ).select("n", "s0", "s1", *[F.col(f"r.{c}").alias(c) for c in ("id", *_BITS, "mh")])
    reps = materialise(reps)
    links = _confirm(_stars(reps, percent), texts, shingle, percent)
    grown, need = 0, TREES
    while grown < need:
        labels = components(links).select(F.col("a").alias("id"), F.col("b").alias("label"))
        found, depth = _trees(reps, labels, rows, percent, range(grown, need))
        links = links.unionByName(_confirm(found, texts, shingle, percent))
        grown, need = need, max(need, trees_for(depth, percent))
    whole = components(links).select(F.col("a").alias("__a"), F.col("b").alias("__c"))
    sets = one_set.join(whole, F.col("rep") == F.col("__a"), "left").select(
        "n", "s0", "s1", F.coalesce("__c", "rep").alias("component")
    )
    left = rows.select("id", "n", "s0", "s1")
    # a set that a large share of all rows has is dealt by the rows' ids: its one line on the right is repeated
    salts = 32
    salt = F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")
    spread = sets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = left.withColumn("salt", salt).join(spread, ["n", "s0", "s1", "salt"], "left")
    component = F.coalesce("component", "id")
    again = F.row_number().over(Window.partitionBy("id").orderBy(F.col("n").desc()))
    out = out.select("id", "n", component.alias("component"), again.alias("again"))
    real = lambda c: F.when(F.col(c) != lowest, F.col(c)).alias(c)
    return out.select(
        real("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        real("component").alias("component_id"),
        ((F.col("id") == F.col("component")) & (F.col("again") == 1)).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """The rows that stay, with all their columns: of each group the one with the smallest id.

    Ids and ties as in near_duplicates; rows of one id go or stay together."""
    marked = near_duplicates(docs, id_col, text_col, shingle, percent)
    gone = marked.groupBy(F.col(f"`{id_col}`").alias("__gone")).agg(F.max("kept").alias("__any")).where("not __any")
    return docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col("__gone")), "left_anti")


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
