"""Secret scans against plain regular expressions over whole texts."""

import hashlib
import re

import pytest
from hypothesis import given, settings, strategies as st

from marginalia.llm import secret_scan as s

PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 32),
}
PARTS = ["password", "PassWD", "ſecret", "secret", "toKen", "toKen", "api_key", "ApiKey", '"', "'", " ", "  ", ":", "=", "\n", "AKIA", "ABCDEFGHIJ12", "deadbeef", "0123456789abcdef" * 2, "DEADBEEF", "x", "é😀", "ghp_" + "a1" * 18, "-----BEGIN RSA PRIVATE KEY-----", "AIza" + "b" * 35, "_", "hunter2hunter2"]


def base(text):
    found = []
    for n, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        found += [(m.start(), n, kind, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(found)


def row(text):
    found = base(text)
    listed = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)
    return (*(sum(f[2] == k for f in found) for k in PATTERNS), hashlib.sha256(listed.encode()).hexdigest())


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in s.digest(s.scan_secrets(df)).collect()}
    assert len(out) == len(texts)
    for i, text in enumerate(texts):
        r = out[i]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == row(text), text
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert [f"{kind}:{a}:{b}" for a, _, kind, b in base(text)] == [":".join(x) for x in spans if x[0] in PATTERNS]
        assert [int(x[1]) for x in spans] == sorted(int(x[1]) for x in spans)


def test_random_texts(spark):
    import random

    rng = random.Random(1)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(1, 14))) for _ in range(3000)]
    check(spark, [*texts, None, "", "é" * 10 + "password=12345678", "x" * 2_000_000 + " token: abcdefgh"])


def test_whole_documents(spark):
    check(spark, [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()])


def test_more_kinds(spark):
    text = "k -----BEGIN RSA PRIVATE KEY----- ghp_" + "z1" * 18 + " AIza" + "x" * 35
    out = s.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert [x.kind for x in out] == ["pem", "github", "google"] and text[out[1].start : out[1].end] == "ghp_" + "z1" * 18


def satisfied(query, text):
    if query is True:
        return True
    if isinstance(query, bytes):
        return query in text.encode("utf-8", "surrogatepass").lower()
    return (all if query[0] == "and" else any)(satisfied(q, text) for q in query[1])


@pytest.mark.parametrize("rule", s.RULES, ids=lambda r: r.kind)
@settings(max_examples=60, deadline=None)
@given(data=st.data())
def test_trigram_queries_miss_no_match(rule, data):
    text = data.draw(st.from_regex(rule.compiled()))
    assert satisfied(s.trigram_query(rule.pattern), text)


def test_rules_outside_ascii(spark):
    """Letters of two to four bytes in a rule, with and without case, next to what only looks alike."""
    rules = (s.Rule("cle", "clé=[a-z]+"), s.Rule("Cle", "CLÉ:[a-z]+", True), s.Rule("ja", "鍵[:=][0-9]{3,}"), s.Rule("e", "É"), s.Rule("smile", "[😀😁]x"))
    texts = ["clé=abc", "cle=abc", "clÉ:x CLÉ:yz clé:no", "鍵=123 鍵=12", "é É", "😀x 😂x 😁y", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: [(x.kind, x.start, x.end) for x in r.spans] for r in s.scan_secrets(df, rules=rules).collect()}
    want = {i: sorted((m.start(), n, r.kind, m.end()) for n, r in enumerate(rules) for m in r.compiled().finditer(t or "")) for i, t in enumerate(texts)}
    assert out == {i: [(kind, a, b) for a, _, kind, b in found] for i, found in want.items()}
    assert sum(map(len, out.values())) == 8


def test_very_long_texts_and_ties(spark):
    """Matches at both ends and across every inner boundary; several kinds that begin at one place come in rule order."""
    long = "password=abcdefgh " + "filler words " * 300_000 + "token=0123456789abcdef0123456789abcdef"
    tied = "0123456789abcdef" * 3
    rules = (*s.BASE, s.Rule("digits", "[0-9]{10}"), s.Rule("all", "[0-9a-f]{48}"))
    df = spark.createDataFrame([(1, long), (2, tied)], "doc_id long, text string")
    out = {r.doc_id: [(x.kind, x.start, x.end) for x in r.spans] for r in s.scan_secrets(df, rules=rules).collect()}
    n = len(long)
    assert out[1] == [("assign", 0, 17), ("assign", n - 38, n), ("hex", n - 32, n), ("digits", n - 32, n - 22), ("digits", n - 16, n - 6)]
    assert out[2] == [("hex", 0, 48), ("digits", 0, 10), ("all", 0, 48), ("digits", 16, 26), ("digits", 32, 42)]


def test_trigram_queries():
    assert s.trigram_query("abcd") == ("and", (b"abc", b"bcd"))
    assert s.trigram_query("abc|xyz") == ("or", (b"abc", b"xyz"))
    assert s.trigram_query("[0-9a-f]+") is True  # scans all
    assert s.trigram_query("abc.*xyz") == ("and", (b"abc", b"xyz"))
    assert s.trigram_query(s.BASE[0].pattern) is not True


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "token=abcdefgh", "s"), (1, "token=abcdefgh", "s"), (None, "plain", None), (3, None, None)], "doc_id long, text string, spans string")
    found = s.scan_secrets(df)
    assert sorted((str(r.doc_id), len(r.spans)) for r in found.collect()) == [("1", 1), ("1", 1), ("3", 0), ("None", 0)]
    assert sorted(str(r.doc_id) for r in s.without_secrets(df, found).collect()) == ["3", "None"]
    assert s.scan_secrets(df.limit(0)).collect() == []
