"""Response parsing on literal answers."""

from reviewloom.operators import responses

TEXTS = [
    ('{"summary":"s","score":72.5,"issues":[]}', "s", 73, 0, None),
    ('{"score":"72"}', "", 50, 0, None),
    ('{"score":140}', "", 100, 0, None),
    ('{"score":-3}', "", 0, 0, None),
    ('```JSON\n{"summary":"f","score":1}\n```', "f", 1, 0, None),
    ('x {"score":1} y', "", 1, 0, None),
    ("no json", "no json", 50, 0, None),
    ("z" * 400, "z" * 300, 50, 0, None),
    ("[]", "", 50, 0, None),
    ('[{"score":3}]', "", 50, 0, None),
    ("null", "null", 50, 0, None),
    ("42", "42", 50, 0, None),
    ('"x {} y"', '"x {} y"', 50, 0, None),
    ('{"issues":[3]}', "", 50, 1, None),
    ('{"issues":[null]}', None, None, None, "INVALID_ISSUE"),
    ('{"issues":"x"}', "", 50, 0, None),
    ('{"score":1} tail {"score":2}', '{"score":1} tail {"score":2}', 50, 0, None),
    ('{"score":true,"summary":null}', "", 50, 0, None),
    ('{"score":5,"score":6}', "", 6, 0, None),
    ("", "", 50, 0, None),
]


def test_reviews(spark):
    frame = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TEXTS)], "review_id int, text string")
    got = {r["review_id"]: r for r in responses.parse_reviews(frame).collect()}
    for i, (text, summary, score, count, error) in enumerate(TEXTS):
        row = got[i]
        assert (row["summary"], row["score"], row["issue_count"], row["parse_error"]) == (
            summary, score, count, error
        ), text


def test_issue_coercion(spark):
    text = (
        '{"issues":[{"file":3,"line":"7","severity":"bad","category":"x"},3,'
        '{"file":"a","line":7,"severity":"error","category":"security","message":"m","suggestion":"s"}]}'
    )
    frame = spark.createDataFrame([(1, text), (2, '{"issues":[null,{"file":"a"}]}')], "review_id int, text string")
    rows = responses.parse_issues(frame, "review_id").orderBy("seq").collect()
    default = ("unknown", None, "info", "lint", "", "")
    assert [tuple(r)[2:] for r in rows] == [default, default, ("a", 7, "error", "security", "m", "s")]
    assert {r["review_id"] for r in rows} == {1}


def test_fixes(spark):
    texts = [
        '{"prTitle":"T","prBody":"B","fixes":[{"file":"a","newContent":"x"},{"file":"b"},7]}',
        "sorry", '{"fixes":{}}',
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "review_id int, text string")
    rows = responses.parse_fixes(frame).orderBy("review_id").collect()
    assert (rows[0]["pr_title"], rows[0]["pr_body"]) == ("T", "B")
    assert [tuple(f) for f in rows[0]["fixes"]] == [("a", "x", "")]
    for row in rows[1:]:
        assert row["pr_title"] == responses.DEFAULT_PR_TITLE and row["fixes"] == []


def test_provider_choice(spark):
    attempts = [
        ("a", "p", 0, " hi ", None, None), ("a", "f", 1, "later", None, None),
        ("b", "p", 0, None, "Error 429", None), ("b", "f", 1, "ok", None, None),
        ("c", "p", 0, "  ", None, None), ("c", "f", 1, None, "down", None),
    ]
    frame = spark.createDataFrame(
        attempts,
        "review_id string, provider string, attempt_pos int, text string, error string, status int",
    )
    got = {r["review_id"]: r for r in responses.choose_provider(frame).collect()}
    assert (got["a"]["text"], got["a"]["provider_used"], got["a"]["error_code"]) == ("hi", "p", None)
    assert (got["b"]["text"], got["b"]["rate_limited"]) == ("ok", True)
    assert got["c"]["error_code"] == "AI_UNAVAILABLE"
    assert got["c"]["first_error"] == "p returned an empty response"
    assert got["c"]["last_error"] == "down"


def test_documents_are_found_without_patterns(spark):
    """Brackets and the widest brace-to-brace span as the patterns gave them, on odd texts too."""
    from pyspark.sql import functions as F

    from reviewloom.functions import json_values as J
    from reviewloom.functions import text as X

    texts = [
        "", "{", "}", "{}", "}{", "} {a} b} c", "{a", "a}", "[", "[]", "[\n]", "{]", '"', '""', '"a"', "x{\n{é}\n}ü", "{a}\n", None,
        "  {a} ﻿", "   ", "a　", "\n", "é", "``` {a}\n```", "```json\n[1]```", "``` a ``` b", "`` a ``",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", J._bracketed(F.col("t")).alias("b"), F.col("t").rlike(r'(?s)^(?:\{.*\}|\[.*\]|".*")\z').alias("b0"),
        J._braces(F.col("t")).alias("s"), F.regexp_extract("t", r"\{[\s\S]*\}", 0).alias("s0"),
        X.trimmed_long(F.col("t")).alias("x"), X.trimmed(F.col("t")).alias("x0"),
        J.without_fences(F.col("t")).alias("f"),
        X.trimmed(F.regexp_replace(F.regexp_replace("t", r"(?i)^```(?:json)?\s*", ""), r"\s*```\z", "")).alias("f0"),
    ).collect()
    for r in rows:
        assert (r["b"], r["s"], r["x"], r["f"]) == (r["b0"], r["s0"], r["x0"], r["f0"]), r["t"]
