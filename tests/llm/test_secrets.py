import hashlib
import re

from pairloom.llm import secrets

from . import cases

BASE = [
    ("assign", re.compile(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def brute(text):
    out = []
    for k, (kind, regex, group, least) in enumerate(BASE):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in regex.finditer(text or "") if len(m[group]) >= least]
    return [x[2] for x in sorted(out)]


TEXTS = [
    "é password: hunter22 and PASSWD='abc' token=short", "api_key=\"AAAA-bbbb.cccc\" apikey: 123456", "AKIA" + "A1" * 8 + " AKIAX",
    "x" * 10 + "0123456789abcdef" * 2 + "deadbeef" * 3 + "g", "ſecret: abcdefgh toKen: abcdefgh", "secret:\nabcdefgh", "password password=abcdefg",
    "😀 token   =   'abcdef'", "", "a1" * 12, "a1" * 11, "tokentoken:abcdefg",
]


def test_base_spans(spark, sf_dir):
    rows = list(enumerate(TEXTS)) + [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = dict(rows)
    for r in secrets.find_secrets(cases.texts(spark, rows)).collect():
        base = [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in ("assign", "access", "hex")]
        assert base == brute(want[r.doc_id])


def test_query(spark, sf_dir):
    want = {r.doc_id: brute(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in secrets.op7_secrets(spark, sf_dir).collect():
        assert r.base_sha256 == hashlib.sha256(",".join(want[r.doc_id]).encode()).hexdigest()
        assert r.n_hex == sum(x.startswith("hex") for x in want[r.doc_id])


def test_more_kinds(spark):
    planted = {
        "private_key": "-----BEGIN RSA PRIVATE KEY-----", "github": "ghp_" + "a1B2" * 9, "slack": "xoxb-1234567890-abc", "google_key": "AIza" + "x" * 35,
        "stripe": "sk_live_" + "a" * 16, "jwt": "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefghij", "bearer": "Authorization: Bearer abcdefghijklmnop", "url_login": "https://user:pass@example.org",
    }
    rows = [(i, f"é {t} end") for i, t in enumerate(planted.values())]
    out = {r.doc_id: r.spans for r in secrets.find_secrets(cases.texts(spark, rows)).collect()}
    for i, (kind, t) in enumerate(planted.items()):
        assert (2, 2 + len(t)) in [(s.start, s.end) for s in out[i] if s.kind == kind], kind


def test_trigrams_are_mandatory():
    """A rule's query holds in every text that the rule matches; a rule without mandatory trigrams has none."""
    assert secrets.trigram_query(rb"[0-9a-f]+") is None
    assert secrets.trigram_query(rb"a?b*") is None
    assert secrets.trigram_query(rb"abcd") == frozenset({b"abc", b"bcd"})
    scanner = secrets.Scanner(secrets.RULES)
    assert [q is None for _, _, q in scanner.rules].count(True) <= 2


def test_odd_rows(spark):
    out = secrets.find_secrets(cases.odd(spark)).collect()
    assert len(out) == len(cases.ODD) and all(r.spans == [] for r in out)
    assert secrets.find_secrets(cases.none(spark)).collect() == []


def test_long_logins():
    """A login's user and password may have any length."""
    rule = next(r for r in secrets.MORE if r.kind == "url_login")
    for user, password in (("u" * 300, "p" * 5000), ("bob", "github_pat_" + "x" * 82)):
        text = f"see https://{user}:{password}@host.example/a".encode()
        assert re.search(rule.pattern, text).span() == (4, len(text) - 2)
