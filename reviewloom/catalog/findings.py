"""Severity, ranking and scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.catalog.views import RANK, WEIGHT, oracle
from reviewloom.functions import severity as S
from reviewloom.operators import findings as fnd, history, scoring
from reviewloom.sources.samples import Samples

_WORD = (
    "CASE event_id % 10 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'e' WHEN 2 THEN 'Critical' "
    "WHEN 3 THEN 'Fatal' WHEN 4 THEN 'Warn' WHEN 5 THEN 'w' WHEN 6 THEN 'style' "
    "WHEN 7 THEN 'portability' WHEN 8 THEN '2' ELSE event_type END"
)


def severity_normalize(spark, sf_dir):
    rows = Samples(spark, sf_dir).table("events").selectExpr(
        "event_id", f"{_WORD} AS word", "CAST(event_id % 4 AS INT) AS level"
    )
    return rows.withColumn("severity", S.normalize_severity(F.col("word"))).withColumn(
        "level_severity", S.normalize_severity_number(F.col("level"))
    )


def severity_histogram(spark, sf_dir):
    counted = fnd.severity_counts(Samples(spark, sf_dir).issues())
    return counted.select(
        "severity", S.severity_rank(F.col("severity")).alias("rank"),
        S.severity_weight(F.col("severity")).alias("weight"), "n",
    )


def total_findings(spark, sf_dir):
    return fnd.total_findings(Samples(spark, sf_dir).issues(), "review_id")


def weighted_score(spark, sf_dir):
    return scoring.weighted_scores(Samples(spark, sf_dir).issues())


def pr_decision(spark, sf_dir):
    s = Samples(spark, sf_dir)
    reviews = s.reviews().select("review_id", "repo_id", "score")
    return scoring.pr_decisions(reviews, s.issues())


def score_band(spark, sf_dir):
    reviews = Samples(spark, sf_dir).reviews()
    return reviews.select(
        "review_id", "score", S.score_band(F.col("score")).alias("band"),
        S.score_tone(F.col("score")).alias("tone"),
    )


def score_carry_forward(spark, sf_dir):
    rows = history.with_carried_score(Samples(spark, sf_dir).reviews())
    return rows.select("review_id", "score", "stored_score")


def top_findings(spark, sf_dir):
    listed = fnd.findings_by_file(Samples(spark, sf_dir).lint_findings())
    return fnd.top_findings(listed, 3).select("review_id", "rank", "seq", "severity", "file")


def prompt_files(spark, sf_dir):
    rows = fnd.prompt_findings(Samples(spark, sf_dir).lint_findings(), issues=4, files=2)
    return rows.select("review_id", "file", "file_rank", "rank")


def fix_worklist(spark, sf_dir):
    return fnd.fix_files(Samples(spark, sf_dir).issues())


def findings_by_file(spark, sf_dir):
    rows = fnd.findings_by_file(Samples(spark, sf_dir).issues())
    return rows.select(
        "review_id", "file", "file_order", S.severity_rank(F.col("severity")).alias("severity_rank"),
        "seq",
    )


def distinct_files(spark, sf_dir):
    return fnd.distinct_files(Samples(spark, sf_dir).issues())


def files_with_findings(spark, sf_dir):
    return fnd.files_with_findings(Samples(spark, sf_dir).issues(), "review_id")


_DECIDED = (
    f"w AS (SELECT review_id, CAST(sum({WEIGHT}) AS BIGINT) AS weighted, "
    "bool_or(severity IN ('error', 'warning')) AS actionable FROM fx_findings GROUP BY review_id)"
)
_LISTED = (
    "o AS (SELECT review_id, file, min(seq) AS file_order FROM fx_findings GROUP BY review_id, file), "
    f"r AS (SELECT f.*, o.file_order, row_number() OVER (PARTITION BY f.review_id "
    f"ORDER BY {RANK}, o.file_order, f.file, f.seq) AS rank FROM fx_findings f "
    "JOIN o ON o.review_id = f.review_id AND o.file = f.file)"
)

QUERIES = {
    "severity_normalize": severity_normalize,
    "severity_histogram": severity_histogram,
    "total_findings": total_findings,
    "weighted_score": weighted_score,
    "pr_decision": pr_decision,
    "score_band": score_band,
    "score_carry_forward": score_carry_forward,
    "top_findings": top_findings,
    "prompt_files": prompt_files,
    "fix_worklist": fix_worklist,
    "findings_by_file": findings_by_file,
    "distinct_files": distinct_files,
    "files_with_findings": files_with_findings,
}

ORACLES = {
    "severity_normalize": (
        f"WITH e AS (SELECT event_id, {_WORD} AS word, CAST(event_id % 4 AS INT) AS level FROM events) "
        "SELECT event_id, word, level, CASE WHEN lower(word) IN ('error', 'e', 'critical', 'fatal') "
        "THEN 'error' WHEN lower(word) IN ('warning', 'warn', 'w', 'style', 'performance', "
        "'portability') THEN 'warning' ELSE 'info' END AS severity, "
        "CASE level WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS level_severity FROM e"
    ),
    "severity_histogram": oracle(
        f"SELECT severity, CAST({RANK} AS INT) AS rank, CAST({WEIGHT} AS INT) AS weight, "
        "count(*) AS n FROM fx_findings GROUP BY severity", "findings"),
    "total_findings": oracle(
        "SELECT review_id, count(*) AS total FROM fx_findings GROUP BY review_id", "findings"),
    "weighted_score": oracle("SELECT * FROM w", "findings", ctes=_DECIDED),
    "pr_decision": oracle(
        "SELECT v.review_id, v.repo_id, v.score, coalesce(weighted, 0) AS weighted, "
        "CASE WHEN score IS NULL OR NOT coalesce(actionable, false) THEN false "
        "ELSE score < 60 OR weighted >= 8 END AS should_open_pr, "
        "CASE WHEN NOT coalesce(actionable, false) THEN 'no error/warning-level issues found' "
        "WHEN score IS NULL THEN 'no score' "
        "WHEN score < 60 THEN concat('health score ', CAST(score AS STRING), ' is below threshold 60') "
        "WHEN weighted >= 8 THEN concat('weighted issue score ', CAST(weighted AS STRING), "
        "' is at/above threshold 8') ELSE 'issues present but under both thresholds' END AS reason "
        "FROM fx_reviews v LEFT JOIN w ON w.review_id = v.review_id",
        "reviews", "findings", ctes=_DECIDED),
    "score_band": oracle(
        "SELECT review_id, score, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 70 THEN 'Good' "
        "WHEN score >= 50 THEN 'Fair' WHEN score >= 30 THEN 'Poor' ELSE 'Critical' END AS band, "
        "CASE WHEN score >= 70 THEN 'ok' WHEN score >= 50 THEN 'warn' ELSE 'error' END AS tone "
        "FROM fx_reviews", "reviews"),
    "score_carry_forward": oracle(
        "SELECT review_id, score, coalesce(last_value(score IGNORE NULLS) OVER (PARTITION BY repo_id "
        "ORDER BY round_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS stored_score "
        "FROM fx_reviews", "reviews"),
    "top_findings": oracle(
        "SELECT review_id, CAST(rank AS INT) AS rank, seq, severity, file FROM r WHERE rank <= 3",
        "findings", ctes=_LISTED),
    "prompt_files": oracle(
        "SELECT review_id, file, CAST(file_rank AS INT) AS file_rank, CAST(rank AS INT) AS rank FROM "
        "(SELECT *, dense_rank() OVER (PARTITION BY review_id ORDER BY first_rank) AS file_rank FROM "
        "(SELECT *, min(rank) OVER (PARTITION BY review_id, file) AS first_rank FROM r "
        "WHERE rank <= 4) a) b WHERE file_rank <= 2", "findings", ctes=_LISTED),
    "fix_worklist": oracle(
        "SELECT review_id, file, CAST(file_rank AS INT) AS file_rank FROM (SELECT review_id, file, "
        "row_number() OVER (PARTITION BY review_id ORDER BY min(rank)) AS file_rank FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY {RANK}, seq) AS rank "
        "FROM fx_findings) a WHERE rank <= 10 GROUP BY review_id, file) b WHERE file_rank <= 6",
        "findings"),
    "findings_by_file": oracle(
        f"SELECT review_id, file, min(seq) OVER (PARTITION BY review_id, file) AS file_order, "
        f"CAST({RANK} AS INT) AS severity_rank, seq FROM fx_findings", "findings"),
    "distinct_files": oracle(
        "SELECT review_id, file, min(seq) AS file_order, count(*) AS n FROM fx_findings "
        "GROUP BY review_id, file", "findings"),
    "files_with_findings": oracle(
        "SELECT review_id, count(DISTINCT file) AS files FROM fx_findings GROUP BY review_id",
        "findings"),
}
