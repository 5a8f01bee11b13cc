"""Secret scan over a trigram inverted index.

A rule is a regular expression over UTF-8 bytes. From its parsed form a Boolean query over trigrams is derived (Cox,
"Regular expression matching with a trigram index", 2012): text that matches holds, for each literal run of the rule,
all of its trigrams; alternatives become OR, sequences AND. Texts are folded to lower case (A-Z) in the index, so the
query of a rule that ignores case is the same. Each block of rows gets its own index: postings of the trigrams that some
query names, from trigram to the rows of the block. The query's postings are intersected and united, and only the
candidate rows are searched by the rule itself. A rule without a mandatory trigram searches every row.

Matches are byte spans while searching and code-point spans in the result. No shuffle: a block's index lives as long as
its block, and a lost executor's blocks are made again from their rows.
"""

from __future__ import annotations

import re
import re._constants as _op
import re._parser as _parser
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom._ship import ship
from pairloom.llm._common import table
from pairloom.llm._text import columns, split_batch

#: None: no constraint. A frozenset of trigrams: all of them. ("or", queries), ("and", queries).
Query = object


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: bytes
    #: group and fewest bytes of it; shorter matches are dropped, but use up their text
    group: int = 0
    least: int = 0
    #: how a rule without trigrams may be searched faster with the same matches: runs of these bytes
    runs_of: bytes = b""


#: The order of the first three breaks ties in a row's list of spans; the others follow.
BASE = (
    Rule("assign", rb"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", rb"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", rb"[0-9a-f]+", 0, 24, b"0123456789abcdef"),
)
MORE = (
    Rule("private_key", rb"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("github", rb"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}"),
    Rule("slack", rb"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("google_key", rb"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", rb"(?:sk|rk)_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", rb"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", rb"(?i)authorization:\x20*bearer\x20+[A-Za-z0-9._~+/-]{16,}=*"),
    Rule("url_login", rb"[a-z][a-z0-9+.-]{1,20}://[A-Za-z0-9._%+-]+:[^\s/@:\"']{3,}@[A-Za-z0-9.-]+"),
)
RULES = BASE + MORE

#: A set of exact strings larger than this is closed, as in Cox's rules: its trigrams are taken and it starts anew.
_EXACT = 64


def _lower(b: int) -> int:
    return b + 32 if 65 <= b <= 90 else b


def _trigrams(words: set[bytes]) -> Query:
    """The query that one of the words occurs."""
    parts = []
    for w in words:
        if len(w) < 3:
            return None
        parts.append(frozenset(w[i : i + 3] for i in range(len(w) - 2)))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _both(a: Query, b: Query) -> Query:
    return b if a is None else a if b is None else ("and", (a, b))


def _close(words: set[bytes], query: Query) -> Query:
    return _both(query, _trigrams(words))


def _walk(items) -> tuple[set[bytes] | None, Query]:
    """Of a parsed sequence: the exact strings it can be, if few, and a query that holds in any text that matches."""
    exact: set[bytes] = {b""}
    query: Query = None
    broken = False
    for op, arg in items:
        one, inner = _item(op, arg)
        query = _both(query, inner)
        if one is not None and len(exact) * len(one) <= _EXACT:
            exact = {a + b for a in exact for b in one}
        else:
            query, broken = _close(exact, query), True
            exact = one if one is not None else {b""}
    return (None, _close(exact, query)) if broken else (exact, query)


def _item(op, arg) -> tuple[set[bytes] | None, Query]:
    if op is _op.LITERAL:
        return {bytes([_lower(arg)])}, None
    if op is _op.IN:
        chars: set[int] = set()
        for kind, x in arg:
            if kind is _op.LITERAL:
                chars.add(_lower(x))
            elif kind is _op.RANGE:
                chars |= {_lower(b) for b in range(x[0], x[1] + 1)}
            else:
                return None, None
        return ({bytes([c]) for c in chars}, None) if len(chars) <= 8 else (None, None)
    if op is _op.SUBPATTERN:
        return _walk(arg[3])
    if op is _op.BRANCH:
        exacts: set[bytes] | None = set()
        queries = []
        for branch in arg[1]:
            exact, query = _walk(branch)
            exacts = None if exacts is None or exact is None else exacts | exact
            queries.append(_close(exact, query) if exact is not None else query)
        if exacts is not None and len(exacts) <= _EXACT:
            return exacts, None
        return None, None if any(q is None for q in queries) else ("or", tuple(queries))
    if op in (_op.MAX_REPEAT, _op.MIN_REPEAT):
        low, high, body = arg
        exact, query = _walk(body)
        if low == 0:
            return (exact | {b""}, None) if high == 1 and exact is not None else (None, None)
        if low == high and exact is not None and len(exact) ** low <= _EXACT:
            return _power(exact, low), query
        return None, _close(exact, query) if exact is not None else query
    if op is _op.AT:
        return {b""}, None
    return None, None


def _power(words: set[bytes], n: int) -> set[bytes]:
    out = {b""}
    for _ in range(n):
        out = {a + b for a in out for b in words}
    return out


def trigram_query(pattern: bytes) -> Query:
    """A query over lower-cased trigrams that every text with a match fulfils; None: no mandatory trigram."""
    exact, query = _walk(_parser.parse(pattern))
    return _close(exact, query) if exact is not None else query


def _named(query: Query) -> set[bytes]:
    if query is None:
        return set()
    if isinstance(query, frozenset):
        return set(query)
    return set().union(*map(_named, query[1]))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD_START = np.ones(256, dtype=bool)
_WORD_START[128:192] = False


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        names = sorted(set().union(*(_named(q) for _, _, q in self.rules)))
        self.codes = {t: int.from_bytes(t, "big") for t in names}
        self.wanted = np.zeros(1 << 24, dtype=bool)
        self.wanted[list(self.codes.values())] = True

    def _postings(self, data: np.ndarray, ends: np.ndarray) -> dict[int, np.ndarray]:
        """Trigram to the sorted rows of this block that hold it. data: the texts end to end."""
        if len(data) < 3:
            return {}
        low = _FOLD[data].astype(np.int32)
        code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        at = np.flatnonzero(self.wanted[code])
        row = np.searchsorted(ends, at, side="right")
        inside = at + 3 <= ends[row]
        key = np.unique(code[at[inside]].astype(np.int64) << 32 | row[inside])
        trigram, row = key >> 32, key & 0xFFFFFFFF
        cuts = np.flatnonzero(np.diff(trigram)) + 1
        return {int(t[0]): r for t, r in zip(np.split(trigram, cuts), np.split(row, cuts), strict=True) if len(t)}

    def _rows(self, query: Query, postings: dict[int, np.ndarray], n: int) -> np.ndarray:
        if query is None:
            return np.arange(n)
        if isinstance(query, frozenset):
            out = None
            for t in sorted(query, key=lambda t: len(postings.get(self.codes[t], ()))):
                got = postings.get(self.codes[t], np.zeros(0, np.int64))
                out = got if out is None else np.intersect1d(out, got, assume_unique=True)
                if not len(out):
                    break
            return out
        parts = [self._rows(q, postings, n) for q in query[1]]
        merge = np.union1d if query[0] == "or" else np.intersect1d
        out = parts[0]
        for p in parts[1:]:
            out = merge(out, p)
        return out

    def scan(self, data: np.ndarray, ends: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each row the (start, end, rule) of its matches, in code points from the row's start."""
        n = len(ends)
        starts = np.concatenate([[0], ends[:-1]]) if n else ends
        postings = self._postings(data, ends)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        blob = data.tobytes()
        for k, (rule, regex, query) in enumerate(self.rules):
            if query is None and rule.runs_of:
                for row, a, b in _runs(data, ends, rule.runs_of, max(1, rule.least)):
                    found[row].append((a - int(starts[row]), b - int(starts[row]), k))
                continue
            for row in self._rows(query, postings, n):
                a, b = int(starts[row]), int(ends[row])
                for m in regex.finditer(blob[a:b]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[row].append((m.start(), m.end(), k))
        for row, spans in enumerate(found):
            if spans:
                a, b = int(starts[row]), int(ends[row])
                chars = np.concatenate([[0], np.cumsum(_WORD_START[data[a:b]])])
                found[row] = sorted((int(chars[x]), int(chars[y]), k) for x, y, k in spans)
                found[row].sort(key=lambda s: (s[0], s[2]))
        return found


def _runs(data: np.ndarray, ends: np.ndarray, chars: bytes, least: int) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of the longest runs of chars within a row."""
    inside = np.zeros(256, dtype=bool)
    inside[list(chars)] = True
    hit = inside[data]
    if len(data) < least:
        return
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    # runs that go over a row's end are cut there
    for a, b in zip(start[end - start >= least].tolist(), end[end - start >= least].tolist(), strict=True):
        row = int(np.searchsorted(ends, a, side="right"))
        while a < b:
            stop = min(b, int(ends[row]))
            if stop - a >= least:
                yield row, a, stop
            a, row = stop, row + 1


_SCHEMA = pa.schema(
    [
        ("id", pa.int64()),
        ("kind", pa.list_(pa.string())),
        ("start", pa.list_(pa.int32())),
        ("end", pa.list_(pa.int32())),
    ]
)


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """One row per input row: the id and spans, an array of (kind, start, end) by start and then by rule.

    start and end are code points of the text, end exclusive. A null or empty text has no spans. Ids may repeat or be
    null. Other columns are ignored.
    """

    ship(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for part in split_batch(batch, 1):
                ids, (data, ends) = part.column(0), columns(part, 1)
                spans = scanner.scan(data, ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array([[scanner.rules[k][0].kind for _, _, k in s] for s in spans], _SCHEMA.field(1).type),
                        pa.array([[a for a, _, _ in s] for s in spans], _SCHEMA.field(2).type),
                        pa.array([[b for _, b, _ in s] for s in spans], _SCHEMA.field(3).type),
                    ],
                    names=_SCHEMA.names,
                )

    typed = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    found = typed.mapInArrow(scan, "id long, kind array<string>, start array<int>, end array<int>")
    return found.select(F.col("id").alias(id_col), F.arrays_zip("kind", "start", "end").alias("spans"))


def _listed(spans: str = "spans"):
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in BASE]
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    out = found.withColumn("base", F.filter("spans", lambda s: s["kind"].isin(*kinds)))
    return out.select(
        "doc_id", *[count(k) for k in kinds], F.sha2(_listed("base"), 256).alias("base_sha256"), _listed().alias("spans")
    )
