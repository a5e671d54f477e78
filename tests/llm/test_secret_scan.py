import hashlib
import re

from reviewloom.llm import secret_scan as ss

SCHEMA = "doc_id bigint, text string, findings string"
TEXTS = [
    None, "", "password = 'abc'", 'API_KEY: "abcdefgh" token=zzzzzz', "passwd:=secret=abcdef", "ſecret=abcdef",
    "AKIA" + "A" * 16 + " x AKIA123 AKIA" + "B" * 30, "f" * 24 + " " + "e" * 23 + " g" + "0" * 40,
    "é token=abcdef é " + "a1" * 14, "apikey=" + "Q" * 9, "secret = a" + "b" * 20000, "ghp_" + "a" * 36,
    "xoxb-12345678901", "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 8, "-----BEGIN RSA PRIVATE KEY-----",
    "sk_live_" + "a" * 20, "tok en=abcdef", "TOKEN=ABCDEF;Token=abcdefg", "secret:password=abcdef1",
]


def brute(text, rules=ss.BASE + ss.FURTHER):
    found = []
    for rank, rule in enumerate(rules):
        for m in rule.compiled().finditer(text or ""):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), rank, rule.kind, m.end()))
    return sorted(found)


def test_scan_equals_full_search(make):
    rows = [(k, t, "own") for k, t in enumerate(TEXTS * 2)]
    for r in ss.scan_secrets(make(rows, SCHEMA)).collect():
        assert [tuple(f) for f in r["findings"]] == brute(r["text"]), r["text"]
    assert ss.scan_secrets(make([], SCHEMA)).count() == 0


def test_hex_runs_equal_the_base_pattern():
    for text in TEXTS:
        want = [m.span() for m in re.finditer("[0-9a-f]+", text or "") if m.end() - m.start() >= 24]
        assert [(s, e) for s, _, kind, e in brute(text) if kind == "hex"] == want


def test_trigram_queries():
    assert ss.trigram_query("[0-9a-f]+") is None and ss.trigram_query("ab|abc") is None
    assert ss.trigram_query("abcd") == [frozenset({"abc", "bcd"})]
    assert ss.trigram_query("(abc|xyz)+q*") == [frozenset({"abc"}), frozenset({"xyz"})]
    assert ss.trigram_query("ab?cde") == [frozenset({"abc", "bcd", "cde"}), frozenset({"acd", "cde"})]
    for rule in ss.FURTHER:
        assert ss.trigram_query(rule.pattern)


def test_query_against_full_search(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    base = {r.kind for r in ss.BASE}
    for r in ss.op8_secret_scan(spark, folder).collect():
        found = brute(texts[r["doc_id"]])
        assert r["spans"] == ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)
        own = ",".join(f"{k}:{s}:{e}" for s, _, k, e in found if k in base)
        assert r["base_sha256"] == hashlib.sha256(own.encode()).hexdigest()
        for kind in base:
            assert r[f"n_{kind}"] == sum(k == kind for _, _, k, _ in found)
