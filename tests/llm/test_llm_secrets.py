import re

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from starloom.llm import secrets
from starloom.llm.arrow_text import texts_of

KEY = "AKIA" + "Z9" * 8
TEXTS = [None, "", "nothing here", f"é token = abcdefghijkl {KEY} x", "PASSWORD='short' secret: abcdefghijklmnop", "API_KEY:abcdefabcdefabcd0123",
         "ffffffffffffffff 0123456789abcde", KEY * 2, "ghp_" + "a" * 36, "x" * 50_000 + " apikey=" + "Q" * 20, "token=token=abcdefghijkl",
         "-----BEGIN RSA PRIVATE KEY-----", "ſecret=abcdefghijklmnop", "Bearer " + "t" * 30, "pass\nword=abcdefghijkl"]


def brute(text):
    out = []
    for k, rule in enumerate(secrets.RULES):
        flags = re.ASCII | (re.IGNORECASE if rule.ignore_case else 0)
        for m in re.finditer(rule.pattern.decode(), text, flags):
            if m.end(rule.group) - m.start(rule.group) >= rule.min_length:
                out.append((m.start(), k, m.end()))
    return [(secrets.RULES[k].kind, a, b) for a, k, b in sorted(out)]


def test_spans_equal_full_scans(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "y")], "doc_id int, text string, spans string")
    rows = secrets.find_secrets(df).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.spans] == brute(TEXTS[r.doc_id] or ""), TEXTS[r.doc_id]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="tokensecrPASWD_apikey:=\"' AKIAZ019-.\né", max_size=60), max_size=6))
def test_index_never_misses(texts):
    array = texts_of(pa.array(texts, pa.string()))
    found = secrets.Scanner(secrets.RULES).spans(array)
    for i, t in enumerate(texts):
        points = {len(t[:k].encode()): k for k in range(len(t) + 1)}
        assert [(secrets.RULES[k].kind, points[a], points[b]) for a, k, b in found.get(i, [])] == brute(t)


def test_trigram_queries():
    q = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert q["hex"] is True                      # no mandatory trigram: scanned fully
    assert q["access"] == ("and", [b"aki", b"kia"])
    assert {b"tok", b"oke", b"ken", b"pas"} <= secrets.trigrams_of(q["assign"])
    assert secrets.trigram_query(rb"a(bcd)?e") is True or b"bcd" not in secrets.trigrams_of(secrets.trigram_query(rb"a(bcd)?e"))
    assert secrets.trigram_query(rb"(?:abc|x*)def") == b"def" or b"def" in secrets.trigrams_of(secrets.trigram_query(rb"(?:abc|x*)def"))


def test_redaction_keeps_rows_and_columns(spark):
    df = spark.createDataFrame([(1, f"a {KEY} b", "k"), (2, None, None), (3, "", "z"), (4, "clean", "z")],
                               "doc_id long, text string, spans string")
    out = {r.doc_id: r for r in secrets.redact_secrets(df).collect()}
    assert out[1].text == "a [access] b" and out[1].spans == "k" and out[2].text is None and out[3].text == "" and out[4].text == "clean"
    assert secrets.redact_secrets(df).schema == df.schema
    assert secrets.redact_secrets(df.limit(0)).count() == 0 and secrets.find_secrets(df.limit(0)).count() == 0


def test_logins_of_any_length(spark):
    token = "github_pat_" + "A1b2" * 60
    rows = [(1, f"https://user:{token}@host/x"), (2, "redis://:password@cache:6379"), (3, "https://host:8080/a@b"), (4, "see http://a:b@c"), (5, "x://" + "u" * 500 + ":" + "p" * 500 + "@h")]
    out = {r.doc_id: [s["kind"] for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert "url_login" in out[1] and out[2] == ["url_login"] and out[3] == [] and out[4] == [] and out[5] == []
