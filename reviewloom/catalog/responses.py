"""Model-response queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.catalog.views import oracle
from reviewloom.operators import responses
from reviewloom.sources.samples import Samples


def response_parse(spark, sf_dir):
    return responses.parse_reviews(Samples(spark, sf_dir).view("responses"))


def issue_list_summary(spark, sf_dir):
    """Score and issue count of responses with valid, odd and broken issue lists."""
    parsed = responses.parse_reviews(Samples(spark, sf_dir).view("issue_responses"))
    return parsed.groupBy("summary", "score", "issue_count", "parse_error").agg(
        F.count(F.lit(1)).alias("n")
    )


def response_issues(spark, sf_dir):
    return responses.parse_issues(Samples(spark, sf_dir).view("issue_responses"), "review_id")


def provider_fallback(spark, sf_dir):
    return responses.choose_provider(Samples(spark, sf_dir).attempts())


def fix_response_parse(spark, sf_dir):
    parsed = responses.parse_fixes(Samples(spark, sf_dir).view("fix_responses"))
    return parsed.select(
        "review_id", "pr_title", "pr_body", F.size("fixes").alias("fix_count"),
        F.array_join(F.transform("fixes", lambda f: F.concat_ws("|", f["file"], f["new_content"],
                                                                f["explanation"])), ";").alias("fixes"),
    )


# The text after fences are dropped, and the document the parser settles on.
_CLEAN = (
    "k AS (SELECT *, trim(regexp_replace(regexp_replace(text, '^```(json)?\\s*', ''), '\\s*```$', '')) "
    "AS clean FROM fx_responses), "
    "d AS (SELECT *, CASE WHEN json_valid(clean) THEN clean WHEN json_valid(regexp_extract(clean, "
    "'(?s)\\{.*\\}')) THEN regexp_extract(clean, '(?s)\\{.*\\}') END AS doc FROM k)"
)
_GOOD = (
    "concat('src/m', CAST(l_suppkey % 8 AS STRING), '.js') AS file, l_linenumber AS line, "
    "'error' AS severity, 'logic' AS category, concat('m', CAST(l_suppkey % 3 AS STRING)) AS message, "
    "'s' AS suggestion"
)
_ODD = (
    "'unknown' AS file, CAST(NULL AS INT) AS line, 'info' AS severity, 'lint' AS category, "
    "'' AS message, '' AS suggestion"
)

QUERIES = {
    "response_parse": response_parse,
    "issue_list_summary": issue_list_summary,
    "response_issues": response_issues,
    "provider_fallback": provider_fallback,
    "fix_response_parse": fix_response_parse,
}

ORACLES = {
    "response_parse": oracle(
        "SELECT response_id, CASE WHEN json_type(doc) IN ('OBJECT', 'ARRAY') THEN CASE WHEN "
        "json_type(doc, '$.summary') = 'VARCHAR' THEN doc->>'$.summary' ELSE '' END "
        "ELSE substr(text, 1, 300) END AS summary, CASE WHEN json_type(doc, '$.score') IN ('UBIGINT', "
        "'BIGINT', 'DOUBLE') THEN CAST(greatest(0, least(100, floor(CAST(doc->>'$.score' AS DOUBLE) + 0.5))) "
        "AS INT) ELSE 50 END AS score, CASE WHEN json_type(doc, '$.issues') = 'ARRAY' THEN "
        "CAST(json_array_length(doc, '$.issues') AS INT) ELSE 0 END AS issue_count, "
        "CAST(NULL AS STRING) AS parse_error FROM d", "responses", ctes=_CLEAN),
    "issue_list_summary": (
        "SELECT CASE l_partkey % 8 WHEN 0 THEN 'ok' WHEN 6 THEN NULL WHEN 7 THEN "
        "'{\"score\":1} tail {\"score\":2}' ELSE '' END AS summary, CAST(CASE l_partkey % 8 WHEN 0 THEN 73 "
        "WHEN 1 THEN 100 WHEN 2 THEN 0 WHEN 3 THEN 60 WHEN 6 THEN NULL ELSE 50 END AS INT) AS score, "
        "CAST(CASE l_partkey % 8 WHEN 0 THEN 2 WHEN 6 THEN NULL WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 "
        "ELSE 0 END AS INT) AS issue_count, CASE l_partkey % 8 WHEN 6 THEN 'INVALID_ISSUE' END AS "
        "parse_error, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4"
    ),
    "response_issues": (
        f"SELECT l_orderkey AS review_id, CAST(0 AS BIGINT) AS seq, {_GOOD} FROM lineitem "
        f"WHERE l_partkey % 8 IN (0, 1) UNION ALL SELECT l_orderkey, CASE l_partkey % 8 WHEN 0 THEN 1 "
        f"ELSE 0 END, {_ODD} FROM lineitem WHERE l_partkey % 8 IN (0, 2, 3)"
    ),
    "provider_fallback": oracle(
        "SELECT review_id, text, provider_used, CASE WHEN text IS NULL OR provider_used = 'fallback' "
        "THEN first_error WHEN bad2 THEN last_error END AS first_error, "
        "CASE WHEN bad2 THEN last_error WHEN bad1 THEN first_error END AS last_error, "
        "(bad1 AND (lower(coalesce(e1, '')) LIKE '%rate limit%' OR coalesce(s1, 0) = 429)) AS rate_limited, "
        "CASE WHEN text IS NULL THEN 'AI_UNAVAILABLE' END AS error_code FROM (SELECT a.review_id, "
        "coalesce(nullif(trim(a.text), ''), nullif(trim(b.text), '')) AS text, "
        "CASE WHEN trim(a.text) <> '' THEN 'primary' WHEN trim(b.text) <> '' THEN 'fallback' END "
        "AS provider_used, coalesce(trim(a.text), '') = '' AS bad1, coalesce(trim(b.text), '') = '' AS bad2, "
        "coalesce(a.error, 'primary returned an empty response') AS first_error, "
        "coalesce(b.error, 'fallback returned an empty response') AS last_error, a.error AS e1, "
        "a.status AS s1 FROM fx_first_attempts a JOIN fx_second_attempts b ON b.review_id = a.review_id) t",
        "attempts"),
    "fix_response_parse": (
        "SELECT o_orderkey AS review_id, CASE o_orderkey % 5 WHEN 0 THEN concat('Fix ', CAST(o_orderkey AS "
        "STRING)) ELSE 'Automated fixes from AI code review' END AS pr_title, CASE o_orderkey % 5 WHEN 0 "
        "THEN 'Body' WHEN 1 THEN 'B' ELSE '' END AS pr_body, CAST(CASE o_orderkey % 5 WHEN 0 THEN 2 WHEN 1 "
        "THEN 1 ELSE 0 END AS INT) AS fix_count, CASE o_orderkey % 5 WHEN 0 THEN concat('src/m', "
        "CAST(o_custkey % 8 AS STRING), '.js|x|why;src/b.js|y|') WHEN 1 THEN 'a.js|z|' ELSE '' END AS fixes "
        "FROM orders"
    ),
}
